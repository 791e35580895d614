"""Whole jobs: from hits to the URLs worth fetching, and from responses to saved records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import html as H
from leadspark.functions import text as T
from leadspark.operators import candidates as C
from leadspark.operators import extraction as X
from leadspark.operators import hits as HT
from leadspark.operators import ledger as L
from leadspark.operators import pages as P
from leadspark.operators import resolve as R
from leadspark.operators import review as RV
from leadspark.operators import searchplan as SP
from leadspark.operators import stats as S
from leadspark.operators.keyed import cut, fence, first_per, spread, with_ordinal
from leadspark.sources.tables import read_inputs


@dataclass(frozen=True)
class Settings:
    """Knobs of a run; the defaults are the usual ones."""

    num_waves: int = 3
    queries_per_wave: int = 5
    max_results: int = 10
    max_urls_per_wave: int = 30
    batch_size: int = 5
    respect_robots: bool = True
    snippet_fallback: bool = True
    legacy: bool = False


def wave_urls(hits: DataFrame, ledger: DataFrame, as_of: Column, s: Settings = Settings()) -> DataFrame:
    """(wave_no, url, pos, wave_pos, batch_no): what each wave has to fetch.

    Waves are independent as data: the wave number is a column and the whole run is one job.
    ``hits`` holds (wave_no, pos, url) with canonical URLs.
    """
    fresh = HT.first_wave(hits.select("wave_no", "pos", "url")).join(
        ledger.filter(L.handled(as_of)).select("url"), "url", "left_anti")
    return HT.capped_batches(fresh, s.max_urls_per_wave, s.batch_size)


def outcomes_of(items: DataFrame, responses: DataFrame, robots: DataFrame | None, s: Settings) -> DataFrame:
    """One outcome per item: robots decision, classified responses, fallback resolution."""
    asked = items.select("url")
    if robots is not None and s.respect_robots:
        asked = P.with_robots(asked, robots)
        refused = asked.filter("NOT allowed").select(
            "url", F.lit("direct").alias("via"), F.lit(False).alias("ok"), F.lit(True).alias("blocked"),
            F.lit(K.ROBOTS_ERROR).alias("error"), F.lit("").alias("markdown"))
        asked = asked.filter("allowed").select("url")
    else:
        refused = None
    fetched = responses.join(asked, "url", "left_semi")
    outcomes = legacy_outcomes(fetched) if s.legacy else page_outcomes(fetched)
    attempts = outcomes.withColumn("attempt_no", F.when(F.col("via") == "direct", 1).otherwise(2))
    resolved = P.resolve_attempts(attempts)
    missing = asked.join(resolved, "url", "left").select(
        "url", F.coalesce("via", F.lit("direct")).alias("via"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.when(F.col("ok").isNull(), "no response").otherwise(F.col("error")).alias("error"),
        F.coalesce("markdown", F.lit("")).alias("markdown"))
    return missing if refused is None else missing.unionByName(refused)


def page_outcomes(responses: DataFrame) -> DataFrame:
    """(url, via, markdown, ok, blocked, error). Address, status and type decide first; only pages that have to be read are tokenised."""
    wanted = fence(responses.withColumn("_early", P.early_outcome(F.col("final_url"), F.col("status"), F.col("ctype"))))
    text = H.with_page_text(wanted.filter("_early IS NULL"), "html", ["url", "via"], "markdown")
    read = P.with_outcome(text, P.page_outcome(F.col("markdown"), F.col("parse_error")), ["url", "via", "markdown"])
    unread = wanted.filter("_early IS NOT NULL").select("url", "via", F.lit("").alias("markdown"), "_early.*")
    return read.unionByName(unread)


def legacy_outcomes(responses: DataFrame) -> DataFrame:
    """The same of browser-crawled pages, which come as markdown with the crawler's own verdict: (url, via, success, status, error, markdown)."""
    tidy = fence(responses.withColumn("markdown", T.clean_markdown(F.coalesce("markdown", F.lit("")))))
    return P.with_outcome(tidy.withColumnRenamed("error", "_error"), P.classify_legacy(F.col("success"), F.col("status"), F.col("_error"), F.col("markdown")),
                          ["url", "via", "markdown"])


def numbered_records(records: DataFrame, items: DataFrame, batch_size: int) -> DataFrame:
    """``records`` with seq, unique and in order of (page position, URL, person), and batch, so many pages each.

    Page positions may repeat: pages are numbered by (pos, url).
    """
    pages = cut(items.select("url", F.col("pos").alias("_pos")).orderBy("_pos", "url").withColumn("_page", F.monotonically_increasing_id()))
    order = with_ordinal(pages, [], "_page", "_nth").select("url", F.floor((F.col("_nth") - 1) / batch_size).alias("batch"), "_page")
    return cut(records.join(order, "url").orderBy("_page", "pos")).withColumn("seq", F.monotonically_increasing_id()).drop("_page")


@dataclass(frozen=True)
class BatchResult:
    outcomes: DataFrame
    jobs: DataFrame
    records: DataFrame
    statuses: DataFrame
    dropped: DataFrame
    warnings: DataFrame
    ledger: DataFrame
    people: DataFrame
    candidates: DataFrame
    stats: DataFrame
    reasons: DataFrame


def process(items: DataFrame, responses: DataFrame, replies: DataFrame, ledger: DataFrame, candidates: DataFrame,
            as_of: Column, robots: DataFrame | None = None, s: Settings = Settings()) -> BatchResult:
    """Record, classify, select jobs, check replies, resolve people, save, set status.

    ``items`` holds (url, title, snippet, wave_tag, pos). Results that feed several others
    are written once to the checkpoint folder instead of being computed again.
    """
    items = cut(items.filter(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(
        F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in ("title", "snippet", "wave_tag")]))
    recorded = L.record_urls(ledger, items, as_of)
    outcomes = cut(outcomes_of(items, responses, robots, s))
    jobs = cut(X.extraction_jobs(outcomes, items, s.snippet_fallback, s.legacy))
    results = cut(X.parse_replies(replies.join(jobs.select("url"), "url", "left_semi")))
    readable, failed = X.routed(results)
    checked_pages = cut(X.verified_people(readable.join(jobs, "url").select("url", "content", "people")))
    rows = cut(X.validated(X.page_records(checked_pages)))
    records = cut(numbered_records(X.accepted(rows), items, s.batch_size))
    people = cut(C.last_per_source(R.resolve(records, candidates)))
    saved = C.upsert(candidates, people, as_of)
    statuses = P.url_status(outcomes, results)
    dropped = X.dropped_per_page(checked_pages, rows)
    stats = S.one_row(
        S.outcome_counts(outcomes), S.record_counts(records), jobs.agg(F.count("*").alias("jobs")),
        dropped.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")))
    return BatchResult(outcomes, jobs, records, statuses, dropped, failed,
                       L.set_status(recorded, statuses), people, saved, stats, P.block_reasons(outcomes))


def tagged(items: DataFrame) -> DataFrame:
    """Wave tag of (wave_no, platform) rows."""
    return items.withColumn("wave_tag", T.wave_tag(F.col("wave_no"), F.col("platform")))


@dataclass(frozen=True)
class Saved:
    candidates: DataFrame
    rejected: DataFrame


def saved_records(rows: DataFrame, candidates: DataFrame, as_of: Column, order: str = "pos", batch_size: int = 2_000) -> Saved:
    """Edited export rows back into the candidate table: split, validate, resolve people, upsert.

    ``order`` is a unique number that gives the order of the rows; so many numbers each are one batch of the ordered fold.
    """
    checked = cut(RV.reimported(spread(rows, order), extras=True))
    records = X.accepted(checked).withColumn("seq", F.col(order).cast("bigint")).withColumn("batch", F.floor(F.col("seq") / batch_size))
    people = R.resolve(records, candidates)
    return Saved(C.upsert(candidates, C.last_per_source(people), as_of), X.rejected(checked))


@dataclass(frozen=True)
class Run:
    todo: DataFrame
    report: DataFrame
    summary: DataFrame


def run_waves(plan: DataFrame, done: DataFrame, primary: DataFrame, secondary: DataFrame, log: DataFrame, ledger: DataFrame, as_of: Column,
              s: Settings = Settings(), backend: str = "auto") -> Run:
    """From a search plan to the batches of pages that each wave has to fetch.

    Planned queries that ran before are left out; both engines' hits of a query are topped up and capped; a URL counts in the first place
    where a wave finds it, and in the first wave; what the ledger holds is a duplicate; a wave takes a capped number of fresh URLs in batches.
    ``todo`` has (wave_no, url, wave_pos, batch_no, platform, wave_tag), ``report`` the counters of waves and run, ``summary`` a row for each query.
    """
    queries = cut(SP.planned_queries(SP.cleaned_plan(plan), done, s.num_waves, s.queries_per_wave))
    asked = queries.select("query").distinct()
    own = lambda hits: hits.join(asked, "query", "left_semi")
    first = cut(own(primary))
    hits = cut(HT.topped_up(asked, first, own(secondary), s.max_results, backend))
    place = F.struct("query_no", "engine_seq", "rank")
    found = cut(first_per(hits.join(queries.select("wave_no", "query_no", "query"), "query").withColumn("pos", place), ["wave_no", "url"], ["pos"])
                .select("wave_no", "pos", "url"))
    fresh = cut(HT.first_wave(found).join(ledger.filter(L.handled(as_of)).select("url"), "url", "left_anti"))
    taken = HT.capped_batches(fresh, s.max_urls_per_wave, s.batch_size)
    todo = tagged(taken.join(queries.select("wave_no", "platform").distinct(), "wave_no")).drop("pos")
    unknown = F.lit(None)
    marked = found.select("wave_no", "url").join(fresh.select("wave_no", "url", F.lit(True).alias("is_fresh")), ["wave_no", "url"], "left").join(
        taken.select("wave_no", "url", F.lit(True).alias("is_taken")), ["wave_no", "url"], "left").select(
        F.col("wave_no").alias("wave"), F.coalesce("is_fresh", F.lit(False)).alias("is_fresh"), F.coalesce("is_taken", F.lit(False)).alias("is_taken"),
        unknown.cast("boolean").alias("ok"), unknown.cast("boolean").alias("blocked"), unknown.cast("bigint").alias("records"), unknown.cast("bigint").alias("dropped"))
    used = HT.engines_used(asked, first, backend)
    return Run(todo, S.wave_report(marked).select("wave", "is_total", "found", "duplicates", "fresh"), HT.query_summary(used, log, hits))


def process_folder(spark: SparkSession, folder: str, ledger: DataFrame, candidates: DataFrame, as_of: Column, s: Settings = Settings()) -> BatchResult:
    """``process`` over the source tables below a folder (items, responses, replies, robots)."""
    given = read_inputs(spark, folder)
    return process(given.items, given.responses, given.replies, ledger, candidates, as_of, given.robots, s)
