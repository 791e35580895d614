"""Clean-up of multi-wave search plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions import text as T
from leadspark.operators.keyed import cap_per


def cleaned_plan(plan: DataFrame) -> DataFrame:
    """Queries trimmed, placeholders and case-insensitive repeats dropped."""
    return plan.withColumn("queries", T.clean_list(F.col("queries")))


def planned_queries(plan: DataFrame, done: DataFrame, num_waves: int, queries_per_wave: int) -> DataFrame:
    """(wave_no, wave_name, platform, query_no, query) that still have to run.

    Empty waves go first, then waves are capped, then queries that ran before are
    taken out, then queries are capped. Fewer than ``num_waves`` waves may remain.
    """
    waves = plan.filter(F.size("queries") > 0).orderBy("wave_no").limit(num_waves)
    q = waves.select("wave_no", "wave_name", "platform", F.posexplode("queries").alias("_pos", "query"))
    key = F.lower(T.strip(F.col("query")))
    ran = done.select(key.alias("_key")).distinct()
    left = q.withColumn("_key", key).join(ran, "_key", "left_anti")
    return cap_per(left, ["wave_no"], ["_pos"], queries_per_wave, keep_as="query_no").drop("_pos", "_key")


def as_plan(queries: DataFrame) -> DataFrame:
    """Back to one row per wave; a wave holds at most its capped number of queries."""
    return queries.groupBy("wave_no", "wave_name", "platform").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("query_no", "query"))), lambda x: x["query"]).alias("queries"))
