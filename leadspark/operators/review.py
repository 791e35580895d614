"""Facets, filters and the editable export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions import text as T
from leadspark.operators.extraction import validated
from leadspark.schemas import LIST_FIELDS, RECORD, conform


def facet_values(candidates: DataFrame) -> DataFrame:
    """(facet, value, pos): sorted countries, skills sorted without case, known platforms."""
    values = F.explode(F.array(
        F.struct(F.lit("country").alias("facet"), F.col("target_countries").alias("vs")),
        F.struct(F.lit("skill").alias("facet"), F.col("skills").alias("vs")),
        F.struct(F.lit("platform").alias("facet"), F.array("platform").alias("vs"))))
    flat = candidates.select(values.alias("x")).select("x.facet", F.explode("x.vs").alias("value"))
    once = flat.filter(F.col("value").isNotNull()).distinct()
    key = F.when(F.col("facet") == "skill", F.lower("value")).otherwise(F.col("value"))
    return once.orderBy("facet", key, "value")


def facet_filter(candidates: DataFrame, countries=(), skills=(), role: str = "", platforms=()) -> DataFrame:
    """Rows that meet every given facet."""
    d = candidates
    for column, wanted in (("target_countries", countries), ("skills", skills)):
        if wanted:
            low = [w.lower() for w in wanted]
            d = d.filter(F.exists(column, lambda x: F.lower(x).isin(low)))
    if role:
        d = d.filter(F.lower(F.coalesce("current_role", F.lit(""))).contains(role.lower()))
    if platforms:
        d = d.filter(F.col("platform").isin(list(platforms)))
    return d


def export_rows(candidates: DataFrame) -> DataFrame:
    """Flat text rows: lists joined, the rest as it is."""
    return candidates.select(*[T.join_list(F.col(c)).alias(c) if c in LIST_FIELDS else F.col(c)
                               for c in candidates.columns])


def reimported(rows: DataFrame, extras: bool = False) -> DataFrame:
    """Edited flat rows back to validated records (with the ``valid`` flag); ``extras`` keeps further columns."""
    split = rows.select(*[T.split_list(F.col(c)).alias(c) if c in LIST_FIELDS else F.col(c) for c in rows.columns])
    return validated(conform(split, RECORD, extras))
