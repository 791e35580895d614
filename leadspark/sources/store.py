"""Tables that change, kept in hash buckets, with one manifest that names the files of all of them.

A row belongs to the bucket of its key's hash. A change reads and rewrites only the buckets whose keys it touches; all other buckets
keep their files. A version of the whole store is one manifest: a small table with a row for each bucket of each table and
the schema of each table. It is written last and counts once Spark's commit marker is in it, so the tables of a store change together: a job
lost between two tables leaves the version before in place, and a batch that is replayed finds its own version and is
skipped. Files that no kept manifest names are deleted after a commit.

One writer at a time; readers may read any kept version while it writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import schemas as S

BUCKETS = 64        # buckets of a table; one is the work of one task
KEEP = 2            # versions that stay readable
MANIFEST = "version bigint, batch bigint, name string, key string, ddl string, buckets int, bucket int, path string"


@dataclass(frozen=True)
class Table:
    """Schema and key of a stored table, and the folder of each bucket that has rows."""

    ddl: str
    key: str
    buckets: int
    paths: dict[int, str]


@dataclass(frozen=True)
class Version:
    number: int
    batch: int
    tables: dict[str, Table]


def additive(old: str, new: str) -> None:
    """Refuse a schema that lacks or retypes a column of the one before."""
    fields = {f.name: f.dataType for f in S.struct(new).fields}
    for f in S.struct(old).fields:
        if fields.get(f.name) != f.dataType:
            raise ValueError(f"column {f.name} was {f.dataType.simpleString()}; schemas only grow")


class Store:
    """``tables`` names each table with its schema and key: {name: (ddl, key)}."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.root, self.declared, self.buckets, self.keep = spark, root.rstrip("/"), tables, buckets, max(1, keep)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions ------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        try:
            return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
        except Py4JJavaError:       # no such folder yet
            return []

    def versions(self) -> list[int]:
        """Committed versions that are still there, oldest first."""
        folder = f"{self.root}/manifests"
        return sorted(int(n[2:]) for n in self._names(folder) if n.startswith("v=") and self._fs.exists(self._path(f"{folder}/{n}/_SUCCESS")))

    def version(self, number: int | None = None) -> Version:
        """A committed version, by default the last; version 0 is the empty store."""
        done = self.versions()
        if number is None:
            number = done[-1] if done else 0
        empty = {name: Table(ddl, key, self.buckets, {}) for name, (ddl, key) in self.declared.items()}
        if number == 0:
            return Version(0, -2, empty)
        if number not in done:
            raise ValueError(f"version {number} is not there")
        rows = self.spark.read.schema(S.struct(MANIFEST)).json(f"{self.root}/manifests/v={number}").collect()       # tables x buckets
        tables = dict(empty)
        for name in {r["name"] for r in rows}:
            own = [r for r in rows if r["name"] == name]
            tables[name] = Table(own[0]["ddl"], own[0]["key"], own[0]["buckets"], {r["bucket"]: r["path"] for r in own if r["path"] is not None})
        return Version(number, rows[0]["batch"], tables)

    def has(self, batch: int) -> bool:
        """A batch is done once a version of it or of a later batch is committed."""
        return self.version().batch >= batch

    # --- reading -------------------------------------------------------------
    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None, ddl: str | None = None) -> DataFrame:
        """The rows of a table, of all buckets or some, in the schema of that version or in ``ddl``.

        Files are read in the schema asked for: columns that a file lacks are null in its rows, so versions (and buckets of one version) from before
        a column was added read like the others.
        """
        table = self.version(version).tables[name]
        ddl = ddl or (self.declared[name][0] if version is None and name in self.declared else table.ddl)
        paths = [p for b, p in sorted(table.paths.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(S.struct(ddl)).parquet(*paths) if paths else S.empty(self.spark, ddl)

    def _bucket(self, table: Table) -> Column:
        return F.pmod(F.xxhash64(table.key), F.lit(table.buckets)).cast("int")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of the key values in ``keys``; at most as many numbers as there are buckets."""
        table = self.version().tables[name]
        return sorted(r[0] for r in keys.select(self._bucket(table)).distinct().collect())

    # --- writing -------------------------------------------------------------
    def _write(self, name: str, table: Table, rows: DataFrame, buckets: list[int]) -> dict[int, str]:
        """Write the new contents of some buckets beside the old files."""
        if not buckets:
            return {}
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        numbered = S.conform_exact(rows, table.ddl).withColumn("bucket_no", self._bucket(table))
        numbered.repartition(min(len(buckets), table.buckets), "bucket_no").write.partitionBy("bucket_no").parquet(folder)
        written = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket_no=")}
        stray = sorted(set(written) - set(buckets))
        if stray:
            raise ValueError(f"rows of {name} lie outside the buckets that are rewritten: {stray[:5]}")
        return written

    def commit(self, batch: int, changes: dict[str, tuple[DataFrame, list[int]]]) -> Version:
        """Replace the given buckets of the given tables and commit all of them as one version.

        A change is (whole new contents of the buckets, buckets). A table takes on its declared schema with its next change.
        """
        now = self.version()
        tables = dict(now.tables)
        for name, (rows, buckets) in changes.items():
            old = tables[name]
            additive(old.ddl, self.declared[name][0])
            table = Table(self.declared[name][0], old.key, old.buckets, old.paths)
            written = self._write(name, table, rows, buckets)
            kept = {b: p for b, p in old.paths.items() if b not in set(buckets)}
            tables[name] = Table(table.ddl, table.key, table.buckets, {**kept, **written})
        number = now.number + 1
        rows = [(number, batch, name, t.key, t.ddl, t.buckets, b, p) for name, t in tables.items() for b, p in [(-1, None), *sorted(t.paths.items())]]
        self.spark.createDataFrame(rows, S.struct(MANIFEST)).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifests/v={number}")
        self.expire()
        return Version(number, batch, tables)

    def load(self, tables: dict[str, DataFrame], batch: int = -1) -> Version:
        """Give whole tables their contents; batches of a stream count from 0, so a load comes before them."""
        return self.commit(batch, {name: (rows, list(range(self.version().tables[name].buckets))) for name, rows in tables.items()})

    def change(self, batch: int, name: str, keys: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> Version:
        """Commit ``merge`` over the buckets that hold ``keys``, and over nothing else."""
        buckets = self.touched(name, keys)
        return self.commit(batch, {name: (merge(self.read(name, buckets=buckets)), buckets)})

    def expire(self) -> list[str]:
        """Delete manifests beyond the kept ones, then all bucket files that no kept manifest names; returns the folders deleted."""
        done = self.versions()
        kept = [self.version(v) for v in done[-self.keep:]]
        gone = []
        for old in done[:-self.keep]:
            self._delete(f"{self.root}/manifests/v={old}", gone)
        used = {p for v in kept for t in v.tables.values() for p in t.paths.values()}
        for name in {*self.declared, *(n for v in kept for n in v.tables)}:
            for run in self._names(f"{self.root}/{name}"):
                folder = f"{self.root}/{name}/{run}"
                paths = {f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket_no=")}
                for path in sorted(paths - used) if paths & used else []:
                    self._delete(path, gone)
                if not paths & used:
                    self._delete(folder, gone)
        return gone

    def _delete(self, path: str, gone: list[str]) -> None:
        self._fs.delete(self._path(path), True)
        gone.append(path)
