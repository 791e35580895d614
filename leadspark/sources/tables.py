"""Readers and writers: raw hits, responses, replies, snapshots, exports."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from leadspark import schemas as S
from leadspark.operators.review import export_rows


def read_table(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    """A source table in the given schema: columns a file lacks are null, others are not read."""
    return spark.read.schema(S.struct(ddl)).format(fmt).load(path)


def read_raw_hits(spark, path, fmt="json"):
    return read_table(spark, path, S.RAW_HITS, fmt)


def read_result_pages(spark, path, fmt="json"):
    return read_table(spark, path, S.SERP_PAGES, fmt)


def read_responses(spark, path, fmt="parquet"):
    return read_table(spark, path, S.RESPONSES, fmt)


def read_replies(spark, path, fmt="json"):
    return read_table(spark, path, S.REPLIES, fmt)


def read_edited_csv(spark: SparkSession, path: str) -> DataFrame:
    """An edited export; all columns as text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def write_csv(candidates: DataFrame, path: str) -> None:
    """Header and text lists; written in parallel, without a byte order mark."""
    S.serialise(export_rows(candidates)).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(candidates: DataFrame, path: str) -> None:
    """One JSON object per line, times as text, nulls kept."""
    S.serialise(candidates).write.mode("overwrite").json(path, ignoreNullFields=False)


class Snapshots:
    """Versions of one table under a folder, each tagged with the batch that made it.

    A version is written to its own folder and counts once Spark's commit marker is in
    it, so a job lost half-way leaves the last good version in place, and a batch that is
    replayed finds its own version and is skipped. A folder is never overwritten while read.
    """

    def __init__(self, spark: SparkSession, root: str, ddl: str, label: str = "v"):
        self.spark, self.root, self.ddl, self.label = spark, root.rstrip("/"), ddl, label
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        try:
            listed = self._fs.listStatus(self._path(self.root))
        except Py4JJavaError:
            return []
        names = [s.getPath().getName() for s in listed]
        mark = f"{self.label}="
        return sorted(int(n[len(mark):]) for n in names if n.startswith(mark)
                      and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def has(self, version: int) -> bool:
        return version in self.versions()

    def read(self, before: int | None = None) -> DataFrame:
        """Latest version, or the latest one older than ``before``."""
        done = [v for v in self.versions() if before is None or v < before]
        if not done:
            return S.empty(self.spark, self.ddl)
        return self.spark.read.schema(S.struct(self.ddl)).parquet(f"{self.root}/{self.label}={done[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        S.conform_exact(df, self.ddl).write.mode("overwrite").parquet(f"{self.root}/{self.label}={version}")


@dataclass(frozen=True)
class Inputs:
    """The source tables of a batch, read in their declared schemas."""

    items: DataFrame
    responses: DataFrame
    replies: DataFrame
    robots: DataFrame | None


def read_inputs(spark: SparkSession, folder: str) -> Inputs:
    """Tables ``items``, ``responses``, ``replies`` (JSON) and, where it is there, ``robots`` below a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/robots")
    there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    return Inputs(read_table(spark, f"{folder}/items", S.ITEMS), read_responses(spark, f"{folder}/responses"), read_replies(spark, f"{folder}/replies"),
                  read_table(spark, f"{folder}/robots", S.ROBOTS) if there else None)
