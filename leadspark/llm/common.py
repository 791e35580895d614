"""Helpers shared by the corpus operators: scratch tables, row identity, exact numbering."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadspark.operators.keyed import cut


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; all machines of a cluster see it.

    Where it is unset (tests, local mode) Spark's own checkpoint folder is set up first.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1).toDF("x"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: read as often as needed, computed once.

    The table outlives lost executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of stages whose results are stored.

    Spark deletes them when the driver's collector finds that nothing refers to them any more; a
    driver with much free memory collects seldom, so a job with many stages asks for it between them.
    """
    gc.collect()
    spark._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_mark(column: str = "text") -> Column:
    """64-bit mark of the text. Together with doc_id it tells rows apart where doc_id repeats."""
    return F.xxhash64(whole_text(column))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def slices_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Exact 0-based number of each row in its group, without gaps.

    Each group is cut into slices by a hash of the order columns. Rows are numbered in
    (group, slice) and shifted by the counts of the slices before, so that a group with a
    third of all rows is spread over many tasks. Rows that are equal in all order
    columns get different numbers in any order.
    """
    n = slices_of(df.sparkSession)
    d = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    shift = d.groupBy(*group, "_slice").agg(F.count("*").alias("_n")).select(
        *group, "_slice", F.coalesce(before, F.lit(0)).alias("_shift"))
    local = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(*order))
    return (d.withColumn("_local", local).join(shift, [*group, "_slice"])
            .withColumn(out, F.col("_local") - 1 + F.col("_shift")).drop("_slice", "_shift", "_local"))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (_id, _mark) names, one row for each key, all columns unchanged.

    ``_mark`` is ``text_mark``. Only where keys name repeated rows is a second pass made, over those
    rows alone; which keys do is decided by a count over narrow columns.
    """
    id_, mark = fresh(docs, "_id", "_mark")
    marked = docs.withColumns({id_: F.col("doc_id"), mark: text_mark()})

    def named(by: DataFrame) -> list[Column]:
        return [marked[id_].eqNullSafe(by["_id"]), marked[mark] == by["_mark"]]

    keys = stored(keys.select("_id", "_mark").dropDuplicates())
    kept = marked.join(keys, named(keys), "left_semi")
    repeated = stored(docs.select(F.col("doc_id").alias("_id"), text_mark().alias("_mark")).groupBy("_id", "_mark")
                      .agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, named(repeated), "left_anti")
    return once.unionByName(kept.join(repeated, named(repeated), "left_semi").dropDuplicates([id_, mark])).select(*docs.columns)
