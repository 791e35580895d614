"""Extraction jobs, model replies, and the checks on the people they name.

A page and its reply are one row, and the people of a reply are an array in it. The
checks therefore run inside the row, without a shuffle, and rows are exploded last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.functions import evidence as E
from leadspark.functions import text as T
from leadspark.functions import urls as U
from leadspark.operators.keyed import fence
from leadspark.schemas import LIST_FIELDS, PERSON, PERSON_FIELDS, RECORD_FIELDS

PEOPLE = f"array<struct<{PERSON.replace(' ', ':').replace(',:', ',')}>>"


# --- jobs ------------------------------------------------------------------------
def extraction_jobs(outcomes: DataFrame, hits: DataFrame, snippet_fallback: bool = True,
                    legacy: bool = False) -> DataFrame:
    """(url, content, snippet_only): readable pages, else the hit's snippet when it looks personal."""
    pages = outcomes.join(hits.select("url", "title", "snippet"), "url", "left")
    gate = F.length(F.coalesce("snippet", F.lit(""))) > K.MIN_SNIPPET_CHARS if legacy else E.looks_personal(
        F.col("title"), F.col("snippet"))
    content = F.when(F.col("ok"), F.col("markdown"))
    if snippet_fallback:
        content = content.when(gate, T.snippet_text(F.col("title"), F.col("snippet")))
    return pages.select("url", content.alias("content"), (~F.col("ok")).alias("snippet_only")).filter(
        F.col("content").isNotNull())


def prompts(jobs: DataFrame, intent: str, legacy: bool = False) -> DataFrame:
    """(url, prompt) rows for an external model step."""
    d = jobs.withColumn("_host", U.host(F.col("url")))
    d = d.withColumn("_platform", U.platform(F.col("url"), F.col("_host")))
    return d.select("url", "snippet_only", T.extraction_prompt(
        F.lit(intent), F.col("url"), F.col("_platform"), F.col("content"), F.col("snippet_only"), legacy).alias("prompt"))


# --- replies -----------------------------------------------------------------------
def parse_replies(replies: DataFrame) -> DataFrame:
    """Add ``people`` and ``error_kind``.

    A reply is JSON as a whole, or from its first to its last brace. Empty replies name
    nobody. Replies that are no JSON or break the schema get error_kind 'invalid'.
    """
    body = T.strip(F.coalesce("reply", F.lit("")))
    d = replies.withColumn("_text", body)
    d = d.withColumn("_whole", F.try_parse_json("_text"))
    d = d.withColumn("_json", F.when(F.col("_whole").isNotNull(), F.col("_text")).otherwise(
        F.regexp_extract("_text", r"(?s)\{.*\}", 0)))
    d = d.withColumn("_doc", F.coalesce("_whole", F.try_parse_json("_json")))
    d = d.withColumn("_list", F.try_variant_get("_doc", "$.candidates", "variant"))
    d = d.withColumn("_items", F.try_variant_get("_list", "$", "array<variant>"))
    is_object = F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False))
    valid = is_object & (F.col("_list").isNull() | F.coalesce(F.forall("_items", _well_typed), F.lit(False)))
    parsed = F.from_json("_json", f"candidates {PEOPLE}")["candidates"]
    usable = F.col("error_kind").isNull() & (F.col("_text") != "") & valid
    kind = F.when(F.col("error_kind").isNotNull(), F.col("error_kind")).when(
        (F.col("_text") != "") & ~valid, "invalid")
    people = F.coalesce(F.when(usable, parsed), F.array().cast(PEOPLE))
    # a list left out is an empty list
    people = F.transform(people, lambda p: F.struct(*[
        (F.coalesce(p[f], F.array().cast("array<string>")) if f in LIST_FIELDS else p[f]).alias(f)
        for f in PERSON_FIELDS]))
    keep = [c for c in replies.columns if c not in ("reply", "error_kind")]
    return fence(d.select(*keep, people.alias("people"), kind.alias("error_kind")))


def _well_typed(item: Column) -> Column:
    """Texts are strings or null, lists are lists of strings."""
    ok = F.schema_of_variant(item).startswith("OBJECT")
    for f in PERSON_FIELDS:
        kind = F.schema_of_variant(F.try_variant_get(item, f"$.{f}", "variant"))
        fits = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") if f in LIST_FIELDS else kind.isin("STRING", "VOID")
        ok = ok & F.coalesce(fits, F.lit(True))
    return ok


def routed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable results, failed ones as (url, error_kind))."""
    return (results.filter("error_kind IS NULL").drop("error_kind"),
            results.filter("error_kind IS NOT NULL").select("url", "error_kind"))


# --- checks on the people of a page ---------------------------------------------------
def verified_people(pages: DataFrame) -> DataFrame:
    """(url, people, n_people, n_ungrounded) from (url, content, people).

    People whose quote is not on the page are dropped; e-mail and phone become null
    unless they are on the page and the person's own. Everything taken from the page is
    prepared once per page, not once per person.
    """
    content, text = F.col("content"), F.array().cast("array<string>")
    filled = lambda v: F.coalesce(v, F.lit("")) != ""
    has = lambda f: F.exists("people", lambda p: filled(p[f]))
    d = fence(pages.select("url", "content", "people", F.lower(content).alias("_low")))
    # what only contacts need is left out on pages whose people have none
    spelled = F.exists("people", lambda p: filled(p["email"]) & ~F.col("_low").contains(F.lower(T.strip(p["email"]))))
    lines = F.transform(F.regexp_extract_all(content, F.lit(K.THREAD_LINE_RX), F.lit(0)), lambda x: F.struct(
        F.regexp_extract(x, K.THREAD_LINE_RX, 1).alias("a"), F.regexp_extract(x, K.THREAD_LINE_RX, 2).alias("b")))
    lines = F.transform(lines, lambda x: F.struct(
        F.lower(T.strip(x["a"])).alias("who"), x["b"].alias("text"), F.lower(x["b"]).alias("low"),
        T.compact(x["b"]).alias("compact")))
    d = fence(d.select(
        "url", "people", "_low", F.when(spelled, T.compact(content)).otherwise("").alias("_compact"),
        F.array_distinct(F.split("_low", "[^a-z0-9]+")).alias("_words"),
        F.when(has("phone"), E.page_phone_keys(content)).otherwise(text).alias("_phones"),
        F.when(has("email") | has("phone"), lines).otherwise(F.array().cast(
            "array<struct<who:string,text:string,low:string,compact:string>>")).alias("_lines")))
    share = lambda p: E.words_share(E.words(p["evidence_snippet"]), F.col("_words"))
    kept = d.withColumn("_kept", F.filter("people", lambda p: F.coalesce(
        share(p) >= K.GROUNDING_MIN_OVERLAP, F.lit(False))))
    return kept.select(
        "url", F.transform("_kept", _own_contacts).alias("people"), F.size("people").alias("n_people"),
        (F.size("people") - F.size("_kept")).alias("n_ungrounded"))


def _own_contacts(p: Column) -> Column:
    who = F.lower(T.strip(F.coalesce(p["name"], F.lit(""))))
    mine = lambda x: (who != "") & (x["who"] == who)
    filled = lambda v: F.coalesce(v, F.lit("")) != ""
    has_any = lambda test: F.exists("_lines", test)
    joined = lambda part, keep, sep: F.array_join(
        F.transform(F.filter("_lines", keep), lambda x: x[part]), sep)
    mail = F.lower(T.strip(p["email"]))
    mail_in = lambda keep: joined("low", keep, "\n").contains(mail) | joined("compact", keep, "").contains(mail)
    phone_in = lambda keep: E.phone_on_page(p["phone"], joined("text", keep, "\n"))
    d = T.digits(F.coalesce(p["phone"], F.lit("")))
    other = lambda x: ~mine(x)
    mail_ok = filled(p["email"]) & (F.col("_low").contains(mail) | F.col("_compact").contains(mail)) & (
        (has_any(mine) & mail_in(mine)) | ~(has_any(other) & mail_in(other)))
    phone_ok = (F.length(d) >= 8) & F.array_contains("_phones", F.right(d, F.lit(10))) & (
        (has_any(mine) & phone_in(mine)) | ~(has_any(other) & phone_in(other)))
    return F.struct(*[
        (F.when(mail_ok, p["email"]) if f == "email" else F.when(phone_ok, p["phone"]) if f == "phone" else p[f]).alias(f)
        for f in PERSON_FIELDS])


def assigned_urls(url: Column, names: Column) -> Column:
    """Source URL of each person of a page, by position in ``names``.

    The first keeps the page URL, the others get its name fragment, repeats -2, -3, ...
    """
    slugs = F.transform(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), T.slug)
    base = lambda s: F.concat(url, F.lit("#candidate-"), s)

    def by_count(ss: Column) -> Column:
        return F.zip_with(ss, T.occurrence(ss), lambda s, n: F.when(n == 1, base(s)).otherwise(
            F.concat(base(s), F.lit("-"), n.cast("string"))))

    def by_fold(ss: Column) -> Column:
        # a name such as x-2 may meet a numbered x: take the first free number each time
        free = lambda acc, s: F.when(~F.array_contains(acc, base(s)), base(s)).otherwise(F.get(F.filter(
            F.transform(F.sequence(F.lit(2), F.size(acc) + 2),
                        lambda n: F.concat(base(s), F.lit("-"), n.cast("string"))),
            lambda c: ~F.array_contains(acc, c)), F.lit(0)))
        return F.aggregate(ss, F.array().cast("array<string>"), lambda acc, s: F.array_append(acc, free(acc, s)))

    def numbered(ss: Column) -> Column:
        clash = F.exists(ss, lambda s: s.rlike("-[0-9]+$") & F.array_contains(
            ss, F.regexp_replace(s, "-[0-9]+$", "")))
        return F.when(clash, by_fold(ss)).otherwise(by_count(ss))

    return F.when(F.size(names) > 0, F.concat(F.array(url), T.let(slugs, numbered))).otherwise(
        F.array().cast("array<string>"))


def page_records(verified: DataFrame) -> DataFrame:
    """One row per person kept, with position, source URL and platform; not validated yet."""
    d = verified.withColumn("_host", U.host(F.col("url")))
    d = d.withColumn("platform", U.platform(F.col("url"), F.col("_host"))).withColumn(
        "_src", assigned_urls(F.col("url"), F.transform("people", lambda p: p["name"])))
    d = d.select("url", "platform", F.posexplode(F.arrays_zip(
        F.col("people").alias("p"), F.col("_src").alias("s"))).alias("pos", "x"))
    return d.select("url", "pos", *[f"x.p.{f}" for f in PERSON_FIELDS], F.col("x.s").alias("source_url"), "platform")


def validated(rows: DataFrame) -> DataFrame:
    """Clean every record field; ``valid`` is false where there is no absolute source URL."""
    c = F.col
    clean = {f: T.clean_str(c(f)) for f in ("name", "current_role", "current_location", "platform")}
    clean |= {f: T.clean_list(c(f)) for f in LIST_FIELDS}
    clean |= {"email": T.clean_email(c("email")), "phone": T.clean_phone(c("phone")),
              "evidence_snippet": T.cap_evidence(c("evidence_snippet")), "source_url": T.absolute_url(c("source_url"))}
    extras = [x for x in rows.columns if x not in RECORD_FIELDS]
    return fence(rows.select(*extras, *[clean[f].alias(f) for f in RECORD_FIELDS])).withColumn(
        "valid", c("source_url").isNotNull())


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("valid").drop("valid")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT valid").drop("valid")


def dropped_per_page(verified: DataFrame, checked: DataFrame) -> DataFrame:
    """(url, dropped): ungrounded people plus records that did not validate."""
    invalid = checked.groupBy("url").agg(F.count_if(~F.col("valid")).alias("_bad"))
    return verified.join(invalid, "url", "left").select(
        "url", (F.col("n_ungrounded") + F.coalesce("_bad", F.lit(0))).alias("dropped"))


def reply_contacts(replies: DataFrame) -> DataFrame:
    """Contacts read from a reply count only when they are in it; then they are cleaned."""
    text = F.coalesce("reply_text", F.lit(""))
    return replies.withColumn("email", F.when(E.email_on_page(F.col("email"), text), T.clean_email(F.col("email")))) \
        .withColumn("phone", F.when(E.phone_on_page(F.col("phone"), text), T.clean_phone(F.col("phone"))))
