"""Building blocks shared by the operators: first rows per key, exact row numbers, fences and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key.

    Spark turns the filter on the row number into a per-partition group limit below
    the shuffle, so at most one row per key and partition is moved.
    """
    return cap_per(df, keys, order, 1)


def cap_per(df: DataFrame, keys: list[str], order: list, n: int, keep_as: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, with their 1-based position when ``keep_as`` is set."""
    name = keep_as or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if keep_as else out.drop(name)


def with_ordinal(df: DataFrame, group: list[str], order: str, out: str, slices: int | None = None) -> DataFrame:
    """Exact 1-based position of each row inside its group, by a numeric unique ``order``.

    Rows are numbered inside (group, slice of the order range) and shifted by the
    counts of the slices before, so a group is never sorted as a whole. The cut points
    are a fixed small number of quantiles, taken once and used as literals; they only
    decide how even the slices are.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.01)))
    piece = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("_slice", piece)
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    shift = d.groupBy(*group, "_slice").agg(F.count("*").alias("_n")).select(
        *group, "_slice", F.coalesce(before, F.lit(0)).alias("_shift"))
    local = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(order))
    return d.join(shift, [*group, "_slice"]).withColumn(out, local + F.col("_shift")).drop("_slice", "_shift")


def fence(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element generator.

    The optimizer neither pushes filters below it nor inlines the columns above it, so a
    costly column is computed once, whatever uses it (a filter, or a lambda over an array).
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_f")).select("_f.*")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt over all tasks, by ``keys`` where given.

    A small file, or a shuffle of few bytes, is one task otherwise, however much work its rows are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder of the cluster and forget the lineage."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="leadspark-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
