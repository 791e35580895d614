"""Bucketed tables with one manifest: what is rewritten, what a lost job leaves, replays, expiry, growing schemas."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from leadspark.sources.store import Store
from leadspark.streaming import jobs as J

DDL = "k bigint, v string"


def files(root, name):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(os.path.join(root, name)) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def store(spark):
    s = Store(spark, tempfile.mkdtemp(prefix="store-"), {"a": (DDL, "k"), "b": (DDL, "k")}, 16)
    s.load({n: spark.range(200).selectExpr("id AS k", f"concat('{n}', id) AS v") for n in "ab"})
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_touched_keys_rewrite_their_buckets_only(spark, store):
    before = files(store.root, "a")
    old = store.version()
    keys = spark.createDataFrame([(3,), (77,), (1000,)], "k bigint")
    merge = lambda t: t.join(keys, "k", "left_anti").unionByName(keys.select("k", F.lit("new").alias("v")))
    buckets = store.touched("a", keys)
    now = store.change(0, "a", keys, merge)
    assert len(buckets) <= 3 and now.number == 2
    changed = {b for b, p in now.tables["a"].paths.items() if old.tables["a"].paths.get(b) != p}
    assert changed == set(buckets) and now.tables["b"] == old.tables["b"]
    assert len(files(store.root, "a") - before) <= 3
    want = [(k, "new" if k in (3, 77) else f"a{k}") for k in range(200)] + [(1000, "new")]
    assert rows(store.read("a")) == sorted(want) and rows(store.read("a", version=1)) == sorted((k, f"a{k}") for k in range(200))
    assert {r[0] for r in rows(store.read("a", buckets=buckets))} >= {3, 77, 1000}


def test_rows_outside_the_buckets_are_refused(spark, store):
    keys = spark.createDataFrame([(3,)], "k bigint")
    with pytest.raises(ValueError, match="outside"):
        store.change(0, "a", keys, lambda t: t.unionByName(spark.range(50).selectExpr("id + 500 AS k", "'x' AS v")))
    assert store.version().number == 1 and len(rows(store.read("a"))) == 200


def test_a_job_lost_between_two_tables_leaves_the_pair_before(spark, store, monkeypatch):
    """The first table of a batch is written, the second write fails, the batch is replayed."""
    write, calls = Store._write, []

    def failing(self, name, *rest):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return write(self, name, *rest)

    every = list(range(16))
    new = {n: (spark.range(5).selectExpr("id AS k", f"'{n}!' AS v"), every) for n in "ab"}
    monkeypatch.setattr(Store, "_write", failing)
    with pytest.raises(RuntimeError):
        store.commit(0, new)
    monkeypatch.setattr(Store, "_write", write)
    assert not store.has(0) and [len(rows(store.read(n))) for n in "ab"] == [200, 200]
    # Also a manifest without Spark's commit marker counts nothing.
    spark.createDataFrame([(2, 0)], "version bigint, batch bigint").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(f"{store.root}/manifests/v=2")
    assert store.version().number == 1
    again = Store(spark, store.root, store.declared, 16)
    again.commit(0, new)
    assert again.has(0) and not again.has(1) and [rows(again.read(n)) for n in "ab"] == [[(k, f"{n}!") for k in range(5)] for n in "ab"]


def test_expiry_keeps_what_kept_versions_name(spark, store):
    for batch in range(4):
        store.change(batch, "a", spark.createDataFrame([(batch,)], "k bigint"), lambda t, b=batch: t.withColumn("v", F.when(F.col("k") == b, "x").otherwise(F.col("v"))))
    assert store.versions() == [4, 5]
    named = {os.path.relpath(p, store.root) for v in (4, 5) for t in store.version(v).tables.values() for p in t.paths.values()}
    assert {os.path.dirname(f) for n in "ab" for f in files(store.root, n)} == named
    assert [v for _, v in rows(store.read("a"))].count("x") == 4 and [v for _, v in rows(store.read("a", version=4))].count("x") == 3
    with pytest.raises(ValueError):
        store.read("a", version=1)


def test_schemas_only_grow(spark, store):
    grown = Store(spark, store.root, {"a": (DDL + ", w int", "k"), "b": (DDL, "k")}, 99)
    keys = spark.createDataFrame([(3,)], "k bigint")
    grown.change(0, "a", keys, lambda t: t.withColumn("w", F.when(F.col("k") == 3, 7)))
    assert grown.version().tables["a"].buckets == 16                       # fixed when the table is first written
    assert grown.read("a").filter("w = 7").count() == 1 and grown.read("a").count() == 200
    assert grown.read("a", version=1).columns == ["k", "v"] and grown.read("a", version=1, ddl=DDL + ", w int").filter("w IS NOT NULL").count() == 0
    shrunk = Store(spark, store.root, {"a": (DDL, "k"), "b": (DDL, "k")}, 16)
    with pytest.raises(ValueError, match="only grow"):
        shrunk.change(1, "a", keys, lambda t: t)


def test_empty_store(spark):
    s = Store(spark, tempfile.mkdtemp(prefix="store-"), J.TABLES)
    assert s.read(J.LEDGER).count() == 0 and not s.has(-1) and s.versions() == []
    s.change(0, J.LEDGER, spark.createDataFrame([], "url string"), lambda t: t)
    assert s.has(0) and s.read(J.LEDGER).count() == 0
