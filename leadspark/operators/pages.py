"""Fetched responses to outcomes, robots decisions and final URL status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadspark import constants as K
from leadspark.functions import text as T
from leadspark.functions import urls as U
from leadspark.operators.keyed import fence


def early_outcome(final_url: Column, status: Column, ctype: Column) -> Column:
    """struct(ok, blocked, error) where address, status or type decide; null where the page itself has to be read."""
    low_type = F.coalesce(ctype, F.lit(""))
    http = F.concat(F.lit("HTTP "), status.cast("string"))
    return (F.when(status.isin(K.BLOCKED_STATUSES) | U.is_wall_url(final_url),
                   _outcome(False, True, F.when(status >= 400, http).otherwise("login wall")))
            .when(status >= 400, _outcome(False, False, http))
            .when((low_type != "") & ~low_type.contains("html") & ~low_type.contains("text"),
                  _outcome(False, False, F.concat(F.lit("unsupported content-type "), F.substring(ctype, 1, 40)))))


def page_outcome(text: Column, parse_error: Column | None = None) -> Column:
    """struct(ok, blocked, error) of a page that was read."""
    head = F.substring(text, 1, K.WALL_SCAN_CHARS)
    walled = (F.length(text) < K.MIN_USEFUL_CHARS) | (
        (F.length(text) < K.WALL_MAX_CHARS) & ~text.contains(K.THREAD_HEADING) & head.rlike(K.WALL_PHRASES_RX))
    read = F.when(walled, _outcome(False, True, F.lit(K.WALL_ERROR))).otherwise(_outcome(True, False, F.lit(None).cast("string")))
    if parse_error is None:
        return read
    return F.when(parse_error.isNotNull(), _outcome(False, False, F.concat(F.lit(K.PARSE_ERROR), parse_error))).otherwise(read)


def classify(final_url: Column, status: Column, ctype: Column, text: Column, parse_error: Column | None = None) -> Column:
    """struct(ok, blocked, error) of one response."""
    return F.coalesce(early_outcome(final_url, status, ctype), page_outcome(text, parse_error))


def classify_legacy(success: Column, status: Column, error: Column, text: Column) -> Column:
    """The same ladder with the thresholds of browser-crawled pages."""
    message = T.strip(F.when(F.coalesce(error, F.lit("")) == "", "crawl failed").otherwise(error))
    refused = F.lower(message).rlike("robots|anti-bot|blocked|captcha") | F.coalesce(
        status.isin(K.BLOCKED_STATUSES_LEGACY), F.lit(False))
    code = F.when(F.coalesce(status, F.lit(0)) == 0, 200).otherwise(status)
    http = F.concat(F.lit("HTTP "), code.cast("string"))
    walled = (F.length(text) < K.MIN_USEFUL_CHARS) | (
        (F.length(text) < K.WALL_MAX_CHARS_LEGACY)
        & F.substring(text, 1, K.WALL_SCAN_CHARS).rlike(K.WALL_PHRASES_RX))
    return (F.when(~F.coalesce(success, F.lit(False)), F.struct(
                F.lit(False).alias("ok"), refused.alias("blocked"), F.substring(message, 1, 200).alias("error")))
            .when(code.isin(K.BLOCKED_STATUSES_LEGACY), _outcome(False, True, http))
            .when(code >= 400, _outcome(False, False, http))
            .when(walled, _outcome(False, True, F.lit(K.WALL_ERROR)))
            .otherwise(_outcome(True, False, F.lit(None).cast("string"))))


def _outcome(ok: bool, blocked: bool, error: Column) -> Column:
    return F.struct(F.lit(ok).alias("ok"), F.lit(blocked).alias("blocked"), error.alias("error"))


def with_outcome(df: DataFrame, outcome: Column, keep: list[str]) -> DataFrame:
    d = fence(df.select(*keep, outcome.alias("_o")))
    return d.select(*keep, "_o.ok", "_o.blocked", "_o.error")


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """One outcome per URL from its direct attempt (1) and its fallback attempt (2).

    The direct result stands when it is ok or alone. A failed fallback carries both errors.
    """
    fields = ["via", "ok", "blocked", "error", "markdown"]
    row = F.struct(*fields)
    both = attempts.groupBy("url").agg(
        F.min_by(row, F.when(F.col("attempt_no") == 1, 1)).alias("a"),
        F.min_by(row, F.when(F.col("attempt_no") == 2, 1)).alias("b"))
    first = F.col("a").isNotNull() & (F.col("a.ok") | F.col("b").isNull())
    joined = F.when(F.col("b.ok") | (F.coalesce(F.col("a.error"), F.lit("")) == ""), F.col("b.error")).otherwise(
        F.concat(F.col("a.error"), F.lit("; "), F.coalesce(F.col("b.error"), F.lit("None"))))
    return both.select("url", *[
        F.when(first, F.col(f"a.{f}")).otherwise(joined if f == "error" else F.col(f"b.{f}")).alias(f)
        for f in fields])


def ok_pages(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("ok").select("url", F.col("markdown").alias("text"))


# --- robots ------------------------------------------------------------------
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_RULES = ("disallow", "allow")
_TIMING = ("crawl-delay", "request-rate")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(base, rules): the rules for any agent (``*``) of each robots text of (base, body), in order; texts without such rules have no row.

    Lines become rows. A line names an agent, is a rule (or a timing, which only counts as one), or is blank. Agents that stand together open a
    group; a rule belongs to the last group opened unless a blank line closed it; a group without rules counts nothing. Of the
    groups that name ``*`` the first one counts; a group that names an empty agent comes before it.
    """
    line = robots.select("base", F.posexplode(F.split("body", _LINE_ENDS)).alias("pos", "raw"))
    text = line.withColumn("_t", T.strip(F.substring_index("raw", "#", 1)))
    named = text.withColumns({"_k": F.when(F.col("_t").contains(":"), F.lower(T.strip(F.substring_index("_t", ":", 1)))),
                              "_v": T.strip(F.expr("substring(_t, instr(_t, ':') + 1)"))})
    kind = F.when(F.col("raw") == "", "blank").when(F.col("_k") == "user-agent", "agent").when(F.col("_k").isin(*_RULES, *_TIMING), "rule")
    events = fence(named.select("base", "pos", kind.alias("kind"), F.col("_k").alias("key"), U.percent_decode(F.col("_v")).alias("value"))).filter("kind IS NOT NULL")
    # One text's lines are numbered together: a group is as large as one robots file.
    place = W.partitionBy("base").orderBy("pos")
    opens = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(place), F.lit("")) != "agent")
    numbered = events.withColumns({"_opens": opens.cast("int"), "_blank": (F.col("kind") == "blank").cast("int")}).withColumns(
        {"entry": F.sum("_opens").over(place), "blanks": F.sum("_blank").over(place)})
    opened = F.min(F.when(F.col("kind") == "agent", F.col("blanks"))).over(W.partitionBy("base", "entry"))
    own = numbered.withColumn("_own", (F.col("kind") == "rule") & (F.col("entry") > 0) & (F.col("blanks") == opened))
    ruled = F.col("_own") & F.col("key").isin(*_RULES)
    rule = F.struct("pos", ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"), _rule_path(F.col("value")).alias("path"))
    entries = own.groupBy("base", "entry").agg(
        F.collect_set(F.when(F.col("kind") == "agent", F.col("value"))).alias("agents"), F.count_if("_own").alias("n"),
        F.array_sort(F.collect_list(F.when(ruled, rule))).alias("rules")).filter("entry > 0 AND n > 0")
    rank = F.when(F.array_contains("agents", "*"), 1).when(F.exists("agents", lambda a: F.substring_index(a, "/", 1) == ""), 0)
    chosen = entries.withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy("base").agg(F.min_by("rules", F.struct("_rank", "entry")).alias("rules"))
    return chosen.select("base", F.transform("rules", lambda r: F.struct(r["allow"].alias("allow"), r["path"].alias("path"))).alias("rules"))


def _quoted_path(rest: Column) -> Column:
    """Empty queries and fragments dropped, percent-encoded the way rule paths are."""
    bare = F.regexp_replace(F.regexp_replace(rest, "#$", ""), r"\?(?=#|$)", "")
    q = F.url_encode(bare)
    for old, new in [("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")]:
        q = F.replace(q, F.lit(old), F.lit(new))
    return q


def _rule_path(value: Column) -> Column:
    return _quoted_path(F.regexp_replace(value, r"(^|/)([^/;?#]*);(?=[?#]|$)", "$1$2"))


def _robots_path(url: Column) -> Column:
    """Decoded rest of the URL after the host, quoted the way rule paths are."""
    rest = F.regexp_extract(U.percent_decode(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?(.*)$", 1)
    return T.let(_quoted_path(rest), lambda q: F.when(q == "", "/").otherwise(q))


def with_robots(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed``. Hosts without a robots row are allowed; the first rule that fits decides.

    Only (base, rules) is joined, one row per host, so a host with a third of all URLs
    is a skewed left side that adaptive execution can split freely.
    """
    rules = robots_rules(robots).withColumnRenamed("base", "_base")
    d = urls.withColumn("_base", U.origin(F.col(url))).join(rules, "_base", "left")
    path = _robots_path(F.col(url))
    hit = F.get(F.filter("rules", lambda r: F.col("_path").startswith(r["path"])), F.lit(0))
    return d.withColumn("_path", path).withColumn(
        "allowed", F.coalesce(hit["allow"], F.lit(True))).drop("_base", "rules", "_path")


# --- final status ---------------------------------------------------------------
def url_status(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """(url, status): quota beats robots beats ok beats snippet beats walled / failed.

    ``results`` holds (url, error_kind) per page sent for extraction; null = extracted.
    """
    r = results.groupBy("url").agg(
        F.bool_or(F.col("error_kind").eqNullSafe("quota")).alias("_quota"),
        F.bool_or(F.col("error_kind").isNull()).alias("_extracted"))
    return outcomes.join(r, "url", "left").select("url", (
        F.when(F.col("_quota"), "quota")
        .when(F.col("error") == K.ROBOTS_ERROR, "robots")
        .when(F.col("ok"), "ok")
        .when(F.col("_extracted"), "snippet")
        .when(F.col("blocked"), "walled").otherwise("failed")).alias("status"))


def block_reasons(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.coalesce("error", F.lit("")) != "").groupBy(
        T.reason_key(F.col("error")).alias("reason")).agg(F.count("*").alias("n"))
