"""Search hits: engine sources, union and top-up, de-duplication, waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import text as T
from leadspark.functions import urls as U
from leadspark.operators.keyed import cap_per, cut, first_per, with_ordinal

HIT = ["query", "query_seq", "engine", "engine_seq", "rank", "url", "title", "snippet"]


def _filled(*names: str) -> Column:
    """First column that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def primary_hits(raw: DataFrame, engine: str = "ddg") -> DataFrame:
    """Rows of the primary engine: any of three link fields, title, body or snippet."""
    have = set(raw.columns)
    links = [c for c in ("href", "url", "link") if c in have]
    bodies = [c for c in ("body", "snippet") if c in have]
    picked = raw.select("query", "query_seq", "rank", _filled(*links).alias("_href"),
                        T.strip(_filled("title")).alias("title"), T.strip(_filled(*bodies)).alias("snippet"))
    return _canonical(picked, engine, 0)


def secondary_hits(pages: DataFrame, max_results: int = 10, engine: str = "google", depth: int = 30) -> DataFrame:
    """JSON result pages of the secondary engine.

    Pages are read in order until one has fewer than ten results or enough useful
    hits were seen; then the first ``max_results`` remain. Result pages behind rank ``depth`` (what the
    engine answers at most, usually 30) or ``max_results`` are not read.
    """
    items = F.from_json("payload", "organic_results array<struct<link:string,title:string,snippet:string>>")
    wanted = max(1, min(max_results, depth))
    d = pages.filter(F.col("page_no") * 10 < wanted).select(
        "query", "query_seq", "page_no", F.coalesce(items["organic_results"], F.array()).alias("_items"))
    # a page is read only when all pages before it were full
    full = d.groupBy("query", "query_seq").agg(
        F.coalesce(F.min(F.when(F.size("_items") < 10, F.col("page_no"))), F.lit(wanted)).alias("_last"))
    read = d.join(full, ["query", "query_seq"]).filter(F.col("page_no") <= F.col("_last")).select(
        "query", "query_seq", F.col("page_no"), F.posexplode("_items").alias("_pos", "_i"))
    flat = read.select("query", "query_seq", (F.col("page_no") * 10 + F.col("_pos")).alias("rank"),
                       F.coalesce("_i.link", F.lit("")).alias("_href"),
                       T.strip(F.coalesce("_i.title", F.lit(""))).alias("title"),
                       T.strip(F.coalesce("_i.snippet", F.lit(""))).alias("snippet"))
    # stopping after the page that fills the quota and cutting at the quota keep the same rows
    return cap_per(_canonical(flat, engine, 1), ["query"], ["rank"], max_results)


def _canonical(df: DataFrame, engine: str, engine_seq: int) -> DataFrame:
    """Useful canonical hits, first per query and URL."""
    d = U.with_canonical_url(df, "_href", "url", ["query", "query_seq", "rank", "title", "snippet"])
    d = d.filter(F.col("url").isNotNull()).filter(U.is_useful(F.col("url")))
    d = d.withColumn("engine", F.lit(engine)).withColumn("engine_seq", F.lit(engine_seq))
    return first_per(d.select(*HIT), ["query", "url"], ["rank"])


def first_hits(hits: DataFrame, keys: list[str] = ("url",)) -> DataFrame:
    """First hit of each URL over queries, engines and ranks."""
    return first_per(hits, list(keys), ["query_seq", "engine_seq", "rank"])


def engines_used(queries: DataFrame, primary: DataFrame, backend: str = "auto",
                 has_secondary: bool = True, thin: int = 3) -> DataFrame:
    """(query, engine_seq, engine): the primary engine unless the secondary alone was
    asked for, the secondary where asked for or where the primary was thin."""
    if backend not in ("auto", "duckduckgo", "google"):
        backend = "auto"
    label = lambda d, seq, name: d.select("query", F.lit(seq).alias("engine_seq"), F.lit(name).alias("engine"))
    used = label(queries, 0, "ddg") if backend != "google" or not has_secondary else None
    if has_secondary and backend != "duckduckgo":
        wanting = queries
        if backend == "auto":
            enough = primary.groupBy("query").agg(F.count("*").alias("_n")).filter(F.col("_n") >= thin)
            wanting = queries.join(enough, "query", "left_anti")
        second = label(wanting, 1, "google")
        used = second if used is None else used.unionByName(second)
    return used


def topped_up(queries: DataFrame, primary: DataFrame, secondary: DataFrame, max_results: int = 10,
              backend: str = "auto", has_secondary: bool = True) -> DataFrame:
    """Union of both engines per query, first hit per URL, cut at twice ``max_results``."""
    used = engines_used(queries, primary, backend, has_secondary)
    hits = primary.unionByName(secondary).join(used.select("query", "engine_seq"), ["query", "engine_seq"], "left_semi")
    once = first_per(hits, ["query", "url"], ["engine_seq", "rank"])
    return cap_per(once, ["query"], ["engine_seq", "rank"], 2 * max_results)


def query_summary(used: DataFrame, log: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: engines in order, joined errors when nothing was found, any rate limit, hit count."""
    n = hits.groupBy("query").agg(F.count("*").alias("hits"))
    per = used.join(log, ["query", "engine"], "left").groupBy("query").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("engine_seq", "engine"))),
                                 lambda x: x["engine"]), ", ").alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.coalesce("error", F.lit("")) != "", F.struct(
            "engine_seq", F.concat("engine", F.lit(": "), "error").alias("e"))))), lambda x: x["e"]), "; ").alias("_err"),
        F.coalesce(F.bool_or("rate_limited"), F.lit(False)).alias("rate_limited"))
    return per.join(n, "query", "left").select(
        "query", "sources", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when((F.col("_err") != "") & F.col("hits").isNull(), F.col("_err")).alias("error"), "rate_limited")


def new_hits_per_query(hits: DataFrame) -> DataFrame:
    """Per query: results, and how many of its URLs no earlier query of the wave had."""
    marked = first_hits(hits).select("query", F.col("url").alias("u"))
    new = marked.groupBy("query").agg(F.count("*").alias("new"))
    return hits.groupBy("query").agg(F.count("*").alias("results")).join(new, "query", "left").select(
        "query", "results", F.coalesce("new", F.lit(0)).alias("new"))


# --- waves ---------------------------------------------------------------------
def first_wave(hits: DataFrame) -> DataFrame:
    """Each URL only in the first wave that found it; ``pos`` orders a wave."""
    return first_per(hits, ["url"], ["wave_no", "pos"])


def capped_batches(fresh: DataFrame, cap: int = 30, batch_size: int = 5) -> DataFrame:
    """First ``cap`` URLs of each wave with their 1-based batch number."""
    d = cap_per(fresh, ["wave_no"], ["pos"], cap, keep_as="wave_pos")
    return d.withColumn("batch_no", _batch(batch_size))


def all_batches(fresh: DataFrame, batch_size: int = 5) -> DataFrame:
    """Batch numbers for a wave of any size. The input is read several times, so it is stored first."""
    return with_ordinal(cut(fresh), ["wave_no"], "pos", "wave_pos").withColumn("batch_no", _batch(batch_size))


def _batch(size: int) -> Column:
    return (F.floor((F.col("wave_pos") - 1) / size) + 1).cast("int")


def recent_queries(queries: DataFrame, n: int = 120) -> DataFrame:
    """The last ``n`` queries that were run, oldest first."""
    return queries.orderBy(F.desc("seq")).limit(n).orderBy("seq")
