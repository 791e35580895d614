"""Counters over batches, waves and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["found", "duplicates", "fresh", "crawled", "blocked", "failed", "records", "dropped"]
TOTALS = ["found", "duplicates", "crawled", "blocked", "records"]


def outcome_counts(outcomes: DataFrame, by: list[str] = (), proxy: str = "scrape.do") -> DataFrame:
    crawled, blocked = F.count_if("ok"), F.count_if("blocked")
    return outcomes.groupBy(*by).agg(
        crawled.alias("crawled"), blocked.alias("blocked"), (F.count("*") - crawled - blocked).alias("failed"),
        F.count_if(F.col("ok") & F.col("via").eqNullSafe(proxy)).alias("via_proxy"))


def record_counts(records: DataFrame, by: list[str] = ()) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(c, F.lit("")) != "")
    return records.groupBy(*by).agg(F.count("*").alias("records"), filled("phone").alias("with_phone"),
                                    filled("email").alias("with_email"))


def one_row(*counts: DataFrame) -> DataFrame:
    """One-row counter tables side by side, without a join."""
    d = counts[0]
    for c in counts[1:]:
        d = d.unionByName(c, allowMissingColumns=True)
    return d.agg(*[F.max(c).alias(c) for c in d.columns])


def _wave_counters() -> list[Column]:
    fetched = F.col("ok").isNotNull()
    return [
        F.count("*").alias("found"), F.count_if(~F.col("is_fresh")).alias("duplicates"),
        F.count_if("is_taken").alias("fresh"), F.count_if("ok").alias("crawled"),
        F.count_if("blocked").alias("blocked"),
        F.count_if(fetched & ~F.col("ok") & ~F.col("blocked")).alias("failed"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")]


def wave_stats(urls: DataFrame) -> DataFrame:
    """Per wave from one row per found URL: (wave, is_fresh, is_taken, ok, blocked, records, dropped).

    Duplicates are counted before the cap; ok / blocked are null for pages not fetched.
    """
    return urls.groupBy("wave").agg(*_wave_counters())


def wave_report(urls: DataFrame) -> DataFrame:
    """Counters of each wave and of the whole run, in one pass: the run is the row with ``is_total``.

    A wave may itself be null, so the grouping tells the total, not the null.
    """
    return urls.rollup("wave").agg((F.grouping("wave") == 1).alias("is_total"), *_wave_counters())


def run_totals(waves: DataFrame) -> DataFrame:
    return waves.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])


def folded_stats(events: DataFrame) -> DataFrame:
    """Latest value of each counter per wave; ``seq`` breaks ties between equal times.

    Only stats-bearing kinds count, and a started wave shows up even without stats.
    """
    bearing = F.col("kind").isin("dedup", "wave_end", "saved")
    rows = events.filter(F.col("wave").isNotNull() & (bearing | (F.col("kind") == "wave_start")))
    when = F.struct("ts", "seq")
    return rows.groupBy("wave").agg(*[
        F.coalesce(F.max_by(F.col("data")[c], F.when(bearing & F.col("data")[c].isNotNull(), when)), F.lit(0)).alias(c)
        for c in COUNTERS])


ICONS = {
    # fixed values: marks of the log lines
    "plan": "🧭", "wave_start": "🌊", "query": "🔍", "dedup": "🧹", "crawl": "🕷️", "saved": "💾",
    "wave_end": "✅", "info": "ℹ️", "warning": "⚠️", "error": "❌", "done": "🏁",
}


def recent_lines(events: DataFrame, n: int = 250) -> DataFrame:
    """The last ``n`` log lines, oldest first."""
    icon = F.coalesce(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])[F.col("kind")], F.lit("•"))
    wave = F.when(F.coalesce("wave", F.lit("")) != "", F.concat(F.lit("["), "wave", F.lit("] "))).otherwise("")
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq").select(
        "seq", F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" "), icon, F.lit(" "), wave,
                        F.coalesce("message", F.lit(""))).alias("line"))
