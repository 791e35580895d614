"""The candidate table: upsert, listing, outreach updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import constants as K
from leadspark.operators import extraction as X
from leadspark.operators.keyed import first_per
from leadspark.schemas import CANDIDATES, LIST_FIELDS, OUTREACH_FIELDS, RECORD_FIELDS, conform, struct


def last_per_source(records: DataFrame, seq: str = "seq") -> DataFrame:
    return first_per(records, ["source_url"], [F.desc(seq)])


def upsert(stored: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """New candidate snapshot: records merged on source_url, one row per source_url on both sides.

    Scalars prefer the new value, lists become the sorted distinct union, and a touched
    row counts as discovered at ``as_of``. Contacts without a source were posted on the page.
    """
    scalars = [f for f in RECORD_FIELDS if f not in LIST_FIELDS and f != "source_url"]
    new = records.select("source_url", *[F.col(f).alias(f"_n_{f}") for f in scalars + LIST_FIELDS],
                         F.lit(True).alias("_new"))
    old = conform(stored, CANDIDATES).withColumn("_old", F.lit(True))
    j = old.join(new, "source_url", "full_outer")
    inserted, touched = F.col("_old").isNull(), F.col("_new").isNotNull()
    empty = F.array().cast("array<string>")
    cols = {}
    for f in struct(CANDIDATES).fieldNames():
        cols[f] = F.col(f)
    for f in scalars:
        cols[f] = F.coalesce(f"_n_{f}", f)
    for f in LIST_FIELDS:
        old_list, new_list = F.coalesce(f, empty), F.coalesce(f"_n_{f}", empty)
        cols[f] = F.when(inserted, new_list).when(
            touched, F.array_sort(F.array_distinct(F.concat(old_list, new_list)))).otherwise(F.col(f))
    cols["id"] = F.when(inserted, F.sha2("source_url", 256)).otherwise(F.col("id"))
    cols["discovered_at"] = F.when(touched, as_of).otherwise(F.col("discovered_at"))
    cols["outreach_status"] = F.when(inserted, "new").otherwise(F.col("outreach_status"))
    return backfilled(j.select(*[v.alias(k) for k, v in cols.items()]))


def _unsourced() -> Column:
    return F.col("contact_source").isNull() & (F.col("email").isNotNull() | F.col("phone").isNotNull())


def unsourced(candidates: DataFrame) -> DataFrame:
    """Keys of the rows that a back-fill changes."""
    return candidates.filter(_unsourced()).select("source_url")


def backfilled(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("_fill", _unsourced()).withColumn(
        "contact_source", F.when(F.col("_fill"), K.POSTED_ON_PAGE).otherwise(F.col("contact_source"))).withColumn(
        "contact_shared_at", F.when(F.col("_fill"), F.col("discovered_at")).otherwise(F.col("contact_shared_at"))
    ).drop("_fill")


def newest_first(candidates: DataFrame) -> DataFrame:
    d = candidates.withColumn("outreach_status", F.coalesce("outreach_status", F.lit("new")))
    return d.orderBy(F.desc("discovered_at"), "source_url")


def by_ids(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    return candidates.join(ids.select("id").distinct(), "id", "left_semi").withColumn(
        "outreach_status", F.coalesce("outreach_status", F.lit("new")))


def table_counts(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    one = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    return one(candidates, "candidates").unionByName(one(ledger, "scraped_urls"))


# --- outreach -----------------------------------------------------------------------
def checked_events(events: DataFrame) -> DataFrame:
    """Events that may change a candidate: known statuses only, and of a reply only contacts that stand in its text."""
    known = events.filter((F.col("kind") != "status") | F.coalesce(F.col("status").isin(K.OUTREACH_STATUSES), F.lit(False)))
    checked = X.reply_contacts(known.withColumns({"_email": F.col("email"), "_phone": F.col("phone")}))
    reply = F.col("kind") == "reply"
    return checked.withColumns({c: F.when(reply, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("email", "phone")}).drop("_email", "_phone")


def outreach_changes(events: DataFrame) -> DataFrame:
    """One row per candidate: the last value each event kind sets, field by field.

    Kinds: draft (message), status (status, optional message), reply (text, interested,
    optional contacts). ``set_<field>`` tells an untouched field from one set to null.
    """
    kind = lambda k: F.col("kind") == k
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    status = (F.when(kind("draft"), "drafted").when(kind("status"), F.col("status"))
              .when(F.col("interested").eqNullSafe(False), "not_interested").otherwise("replied"))
    shared = kind("reply") & (filled("email") | filled("phone"))
    rules = {
        "outreach_status": (kind("draft") | kind("status") | kind("reply"), status),
        "outreach_message": (kind("draft") | (kind("status") & F.col("message").isNotNull()), F.col("message")),
        "outreach_sent_at": (kind("status") & (F.col("status") == "sent"), F.col("ts")),
        "reply_text": (kind("reply"), F.col("reply_text")),
        "replied_at": (kind("reply"), F.col("ts")),
        "email": (kind("reply") & filled("email"), F.col("email")),
        "phone": (kind("reply") & filled("phone"), F.col("phone")),
        "contact_source": (shared, F.lit(K.SHARED_IN_REPLY)),
        "contact_shared_at": (shared, F.col("ts")),
    }
    aggs = []
    for field in OUTREACH_FIELDS:
        when, value = rules[field]
        aggs += [F.max_by(value, F.when(when, F.col("seq"))).alias(field),
                 F.bool_or(F.coalesce(when, F.lit(False))).alias(f"set_{field}")]
    return events.groupBy(F.col("candidate_id").alias("id")).agg(*aggs)


def apply_changes(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """New snapshot with the whitelisted fields of ``changes`` written."""
    present = [f for f in OUTREACH_FIELDS if f in changes.columns]
    new = changes.select("id", *[F.col(f).alias(f"_n_{f}") for f in present],
                         *[(F.col(f"set_{f}") if f"set_{f}" in changes.columns else F.lit(True)).alias(f"_s_{f}")
                           for f in present])
    j = candidates.join(new, "id", "left")
    return j.select(*[
        (F.when(F.col(f"_s_{f}"), F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) if f in present else F.col(f))
        for f in candidates.columns])


def unknown_ids(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.select("id").join(candidates.select("id"), "id", "left_anti")


def facts(candidates: DataFrame, recruiter: str, agency: str, role: str, place: str = "", extra: str = "") -> DataFrame:
    """(id, facts): what a first message may build on, one fact per line."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    skills = F.coalesce(F.nullif(F.array_join("skills", ", "), F.lit("")), F.lit("-"))
    lines = [
        F.lit(f"{K.FACT_RECRUITER}{recruiter}, {agency}"),
        F.lit(K.FACT_ROLE + role + (f" in {place}" if place else "")),
        *([F.lit(K.FACT_EXTRA + extra)] if extra else []),
        F.concat(F.lit(K.FACT_NAME), text("name", "unknown")),
        F.concat(F.lit(K.FACT_SKILLS), text("current_role", "-"), F.lit("; "), skills),
        F.concat(F.lit(K.FACT_PLACE), text("platform", K.FACT_NO_PLATFORM), F.lit(K.FACT_WORDS),
                 F.substring(F.coalesce("evidence_snippet", F.lit("")), 1, K.MAX_FACT_QUOTE_CHARS), F.lit("\"")),
    ]
    return candidates.select("id", F.concat_ws("\n", *lines).alias("facts"))
