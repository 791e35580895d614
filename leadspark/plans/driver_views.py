"""The synthetic driver tables seen as hits, ledger, people, replies and events.

All views keep every row of their tables; remainders only choose attribute values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions import html as H
from leadspark.functions import urls as U
from leadspark.schemas import CANDIDATES, conform

AS_OF = "2024-01-31 00:00:00"
LETTERS = ("0123456789", "abcdefghij")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def text_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def page_hits(spark, sf) -> DataFrame:
    """Canonical hits: 25 queries, one engine, the page number as rank."""
    p = table(spark, sf, "pages").select(
        "page_id", "url", (F.col("page_id") % 25).cast("int").alias("query_seq"), H.title_fast(F.col("html")).alias("title"))
    d = U.with_canonical_url(p, "url", "canon")
    return d.filter("canon IS NOT NULL").select(
        F.concat(F.lit("q"), "query_seq").alias("query"), "query_seq", F.lit("ddg").alias("engine"),
        F.lit(0).alias("engine_seq"), F.col("page_id").alias("rank"), F.col("canon").alias("url"), "title",
        F.lit("").alias("snippet"))


def _result_query() -> Column:
    """Thirty pages make the results of one query."""
    return F.floor(F.col("page_id") / 30).cast("int")


def raw_primary(spark, sf) -> DataFrame:
    """Raw engine rows. Of three queries one has no hits, one has two, and the third has those as well."""
    k = _result_query()
    own = (k % 3 == 2) | ((k % 3 == 1) & (F.col("page_id") % 30 < 2))
    seq = F.when(own, k).otherwise(k - k % 3 + 2).cast("int")
    return table(spark, sf, "pages").select(
        F.concat(F.lit("q"), seq).alias("query"), seq.alias("query_seq"), F.col("page_id").cast("int").alias("rank"),
        F.lit("").alias("href"), F.col("url").alias("link"),
        F.concat(F.lit("  hit "), "page_id", F.lit(" ")).alias("title"), F.lit(None).cast("string").alias("body"),
        F.concat(F.lit(" snippet "), "page_id").alias("snippet"))


def raw_secondary(spark, sf) -> DataFrame:
    """Three JSON result pages of ten items for each query."""
    rank, seq = (F.col("page_id") % 30).cast("int"), _result_query()
    d = table(spark, sf, "pages").select(
        F.concat(F.lit("q"), seq).alias("query"), seq.alias("query_seq"), (rank / 10).cast("int").alias("page_no"),
        rank.alias("r"), F.struct(
            F.col("url").alias("link"), F.concat(F.lit("result "), "page_id").alias("title"),
            F.concat(F.lit("text "), "page_id").alias("snippet")).alias("item"))
    # one result page holds ten items by construction
    return d.groupBy("query", "query_seq", "page_no").agg(F.to_json(F.struct(F.transform(
        F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias("organic_results"))).alias("payload"))


def result_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(_result_query().alias("query_seq")).distinct().select(
        F.concat(F.lit("q"), "query_seq").alias("query"), "query_seq")


def queries25(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select((F.col("page_id") % 25).cast("int").alias("query_seq")).distinct().select(
        F.concat(F.lit("q"), "query_seq").alias("query"), "query_seq")


def query_log(spark, sf) -> DataFrame:
    q = result_queries(spark, sf)
    failed = F.col("query_seq") % 4 == 3
    return q.select("query", F.lit("ddg").alias("engine"), F.when(failed, "timeout: 15s").alias("error"),
                    (F.col("query_seq") % 5 == 0).alias("rate_limited")).unionByName(
        q.select("query", F.lit("google").alias("engine"), F.when(failed, "HTTP 500").alias("error"),
                 F.lit(False).alias("rate_limited")))


def wave_hits(spark, sf) -> DataFrame:
    """(wave_no, pos, url): three waves that find the same pages again one position later."""
    p = U.with_canonical_url(table(spark, sf, "pages").select("page_id", "url"), "url", "canon")
    d = p.select("page_id", F.col("canon").alias("url"))
    twice = d.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return twice.select((F.col("page_id") % 3 + 1 + F.col("k")).cast("int").alias("wave_no"),
                        (F.col("page_id") * 2 + F.col("k")).alias("pos"), "url")


def ledger(spark, sf) -> DataFrame:
    """Latest event per page as its ledger row; some statuses are null on purpose."""
    n = table(spark, sf, "pages").count()
    status = F.when(F.col("event_id") % 10 == 7, F.lit(None).cast("string")).otherwise(F.element_at(F.create_map(*[
        F.lit(x) for x in ("purchase", "ok", "view", "snippet", "click", "pending", "error", "failed",
                           "signup", "quota")]), F.col("event_type")))
    e = events(spark, sf).select((F.col("event_id") % n).alias("page_id"), "ts", "event_id", status.alias("status"),
                                 F.concat(F.lit("W"), F.col("user_id") % 3, F.lit(":seed")).alias("wave_tag"))
    d = e.join(table(spark, sf, "pages").select("page_id", "url"), "page_id")
    return d.groupBy("url").agg(F.max_by(F.struct("wave_tag", "status", "ts"), F.struct("ts", "event_id")).alias("x")).select(
        "url", U.netloc(F.col("url")).alias("domain"), "x.wave_tag", "x.status", F.col("x.ts").alias("scraped_at"))


def page_urls(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("url", F.col("page_id").alias("pos"),
                                            F.concat(F.lit("N"), F.col("page_id") % 2).alias("wave_tag"))


def letters(c: Column) -> Column:
    return F.translate(c.cast("string"), *LETTERS)


def people(spark, sf) -> DataFrame:
    """One extracted person per order; a customer's orders are the same person's records."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, who = F.col("o_orderkey"), letters(F.col("c_custkey"))
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "7")
    return o.select(
        k.cast("bigint").alias("seq"), F.concat(who, F.lit(" "), F.lower("c_mktsegment")).alias("name"),
        F.when(k % 5 != 0, F.initcap("c_mktsegment")).alias("current_role"),
        F.array("o_orderpriority", "c_mktsegment").alias("skills"),
        F.when(k % 7 == 0, F.concat(F.lit("Port "), "n_name")).when(k % 6 != 0, F.concat(
            F.col("n_name"), F.lit(", east"))).alias("current_location"),
        F.array("o_orderstatus").alias("target_countries"),
        F.concat(F.lit("order "), k).alias("evidence_snippet"),
        F.when(k % 9 == 0, F.concat(F.lit("alt."), who, F.lit("@example.org")))
        .when(k % 3 == 0, F.concat(who, F.lit("@example.com"))).alias("email"),
        F.when(k % 20 == 0, F.concat(F.lit("+92"), number)).when(k % 4 == 0, F.concat(F.lit("+91"), number)).alias("phone"),
        F.concat(F.lit("https://people.example.org/"), k).alias("source_url"),
        F.when(k % 2 == 0, "forum").otherwise("linkedin").alias("platform"))


def stored(spark, sf) -> DataFrame:
    """One stored candidate per customer; every other one under another name."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, who = F.col("c_custkey"), letters(F.col("c_custkey"))
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 1000).cast("int"))
    d = c.select(
        F.concat(F.lit("c"), k).alias("id"),
        F.concat(who, F.lit(" "), F.when(k % 2 == 0, F.lower("c_mktsegment")).otherwise("other")).alias("name"),
        F.initcap("c_mktsegment").alias("current_role"), F.array("c_mktsegment").alias("skills"),
        F.when(k % 3 != 0, F.col("n_name")).alias("current_location"), F.array(F.lit("F")).alias("target_countries"),
        F.concat(F.lit("customer "), k).alias("evidence_snippet"),
        F.when(k % 4 == 0, F.concat(who, F.lit("@example.com"))).alias("email"),
        F.when(k % 5 == 0, F.concat(F.lit("+91"), F.lpad(k.cast("string"), 8, "7"))).alias("phone"),
        F.concat(F.lit("https://stored.example.org/"), k).alias("source_url"),
        F.when(k % 10 != 0, F.lower("c_mktsegment")).alias("platform"), seen.alias("discovered_at"),
        F.when(k % 6 == 0, "posted_on_page").alias("contact_source"),
        F.when(k % 8 != 0, "new").alias("outreach_status"))
    return conform(d, CANDIDATES)


def doc_responses(spark, sf) -> DataFrame:
    """Documents as fetched page texts with status codes, types and final URLs."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("https://docs.example.org/"), k).alias("url"),
        F.concat(F.lit("https://docs.example.org/"), F.when(k % 17 == 3, F.lit("login/")).otherwise(""), k).alias("final_url"),
        F.when(k % 11 == 1, 403).when(k % 13 == 2, 404).when(k % 19 == 4, 500).otherwise(200).alias("status"),
        F.when(k % 23 == 5, "application/pdf").when(k % 7 == 6, "").otherwise("text/html; charset=utf-8").alias("ctype"),
        F.when(k % 3 == 0, "scrape.do").otherwise("direct").alias("via"), "text")


def run_events(spark, sf) -> DataFrame:
    return run_events_of(events(spark, sf))


def run_events_of(events: DataFrame) -> DataFrame:
    """Counter events of five waves."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in (
        "purchase", "saved", "view", "dedup", "click", "wave_end", "error", "warning", "signup", "wave_start")]),
        F.col("event_type"))
    n = (F.col("value") * 100).cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"), "ts", kind.alias("kind"),
        F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("wave "), F.col("user_id") % 5)).alias("wave"),
        F.concat("event_type", F.lit(" by "), "user_id").alias("message"),
        F.when(kind == "dedup", F.create_map(F.lit("found"), n, F.lit("duplicates"), n % 7, F.lit("fresh"), n % 30))
        .when(kind.isin("saved", "wave_end"), F.create_map(
            F.lit("crawled"), n % 11, F.lit("blocked"), n % 5, F.lit("failed"), n % 3, F.lit("records"), n % 13,
            F.lit("dropped"), n % 2)).alias("data"))


def outreach_events(spark, sf) -> DataFrame:
    return outreach_events_of(events(spark, sf))


def outreach_events_of(events: DataFrame) -> DataFrame:
    """Outreach steps on stored candidates (and on some ids nobody has)."""
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.when(k % 3 == 0, "draft").when(k % 3 == 1, "status").otherwise("reply")
    return events.select(
        F.concat(F.lit("c"), u).alias("candidate_id"), k.alias("seq"), kind.alias("kind"),
        F.element_at(F.array(*[F.lit(x) for x in ("new", "drafted", "sent", "replied", "not_interested")]),
                     (F.floor(k / 3) % 5 + 1).cast("int")).alias("status"),
        F.when(kind == "draft", F.concat(F.lit("hello "), k)).when(k % 2 == 0, F.concat(F.lit("note "), k)).alias("message"),
        F.when(kind == "reply", F.concat(F.lit("my mail is r"), k, F.lit("@example.net"))).alias("reply_text"),
        F.when(k % 4 == 0, F.lit(False)).when(k % 4 == 1, F.lit(True)).alias("interested"),
        F.when(k % 5 == 0, F.concat(F.lit("r"), k, F.lit("@example.net"))).alias("email"),
        F.when(k % 7 == 0, F.concat(F.lit("+9199"), F.lpad(k.cast("string"), 8, "0"))).alias("phone"), "ts")


def plan(spark, sf) -> DataFrame:
    """A search plan from the parts: one wave per size, one query per part name of that size."""
    p = table(spark, sf, "part").select((F.col("p_size") + 1).alias("wave_no"), "p_name", "p_partkey")
    first = p.groupBy("wave_no", "p_name").agg(F.min("p_partkey").alias("at"))
    # a wave lists each distinct name once, so the list is bounded by the name vocabulary
    return first.groupBy("wave_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p_name"))),
                                                    lambda x: x["p_name"]).alias("queries")).select(
        F.col("wave_no").cast("int"), F.concat(F.lit("Wave "), "wave_no").alias("wave_name"),
        F.concat(F.lit("p"), F.col("wave_no") % 3).alias("platform"),
        F.when(F.col("wave_no") % 5 != 0, F.col("queries")).otherwise(F.array().cast("array<string>")).alias("queries"))


def done_queries(spark, sf) -> DataFrame:
    """Queries that ran before: the part names of one kind, spelled differently."""
    return table(spark, sf, "part").select(
        F.when(F.col("p_name").startswith("red"), F.concat(F.lit("  "), F.upper("p_name"))).otherwise(
            F.concat(F.lit("x "), "p_name")).alias("query"), F.col("p_partkey").alias("seq"))

