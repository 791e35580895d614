"""The URL ledger: which pages were handled, and how they ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import urls as U


def handled(as_of: Column) -> Column:
    """SQL truth table kept on purpose: a null status is handled while young, and the
    expression is null (so not handled) once it is older than an hour."""
    retry = F.coalesce("status", F.lit("")).isin(K.RETRYABLE_STATUSES)
    stale = (F.col("status") == "pending") & (F.col("scraped_at") < as_of - F.expr("INTERVAL 1 HOUR"))
    return ~(retry | stale)


def distinct_urls(urls: DataFrame) -> DataFrame:
    """(url, pos): distinct non-empty URLs with their first position."""
    return urls.filter(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.min("pos").alias("pos"))


def fresh_urls(urls: DataFrame, ledger: DataFrame, as_of: Column) -> DataFrame:
    """Distinct input URLs that no ledger row marks as handled; ``pos`` keeps the order."""
    return distinct_urls(urls).join(ledger.filter(handled(as_of)).select("url"), "url", "left_anti")


def record_urls(ledger: DataFrame, urls: DataFrame, as_of: Column) -> DataFrame:
    """New ledger with ``urls`` (url, wave_tag, and pos for repeats) marked pending.

    Known rows restart only from robots, quota or pending; all others stay as they are.
    """
    new = urls.filter(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(
        F.min_by("wave_tag", "pos").alias("_tag"), F.lit(True).alias("_new"))
    restart = F.col("_new") & (
        F.col("_known").isNull() | F.col("status").isin(*K.RETRYABLE_STATUSES, "pending"))
    pick = lambda name, value: F.when(restart, value).otherwise(F.col(name)).alias(name)
    return ledger.withColumn("_known", F.lit(True)).join(new, "url", "full_outer").select(
        "url",
        F.when(F.col("_known").isNull(), U.netloc(F.col("url"))).otherwise(F.col("domain")).alias("domain"),
        pick("wave_tag", F.col("_tag")), pick("status", F.lit("pending")), pick("scraped_at", as_of))


def set_status(ledger: DataFrame, statuses: DataFrame) -> DataFrame:
    """New ledger with the given (url, status); URLs the ledger does not know are ignored."""
    new = statuses.groupBy("url").agg(F.max("status").alias("_status"), F.lit(True).alias("_hit"))
    return ledger.join(new, "url", "left").withColumn(
        "status", F.when(F.col("_hit"), F.col("_status")).otherwise(F.col("status"))).drop("_status", "_hit")


def recorded_count(urls: DataFrame) -> DataFrame:
    return urls.filter(F.coalesce("url", F.lit("")) != "").agg(F.count_distinct("url").alias("recorded"))
