"""Table schemas, as DDL strings and as typed empty-column defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER = "url string, domain string, wave_tag string, status string, scraped_at timestamp"

PERSON = ("name string, current_role string, skills array<string>, current_location string, "
          "target_countries array<string>, evidence_snippet string, email string, phone string")

RECORD = PERSON + ", source_url string, platform string"

CANDIDATES = (
    "id string, " + RECORD + ", discovered_at timestamp, contact_source string, contact_shared_at timestamp, "
    "outreach_status string, outreach_message string, outreach_sent_at timestamp, reply_text string, "
    "replied_at timestamp")

RAW_HITS = ("query string, query_seq int, engine string, rank int, href string, url string, link string, "
            "title string, body string, snippet string")
SERP_PAGES = "query string, query_seq int, page_no int, payload string"
QUERY_LOG = "query string, engine string, error string, rate_limited boolean"
PLAN = "wave_no int, wave_name string, platform string, queries array<string>"
ITEMS = "url string, title string, snippet string, wave_tag string, pos bigint"
RESPONSES = "url string, final_url string, status int, ctype string, html string, via string"
ATTEMPTS = "url string, attempt_no int, via string, ok boolean, blocked boolean, error string, markdown string"
ROBOTS = "base string, body string"
REPLIES = "url string, reply string, error_kind string"
RUN_EVENTS = "kind string, message string, wave string, data map<string,bigint>, ts timestamp"
OUTREACH_EVENTS = ("candidate_id string, seq bigint, kind string, status string, message string, "
                   "reply_text string, interested boolean, email string, phone string, ts timestamp")

PERSON_FIELDS = ["name", "current_role", "skills", "current_location", "target_countries",
                 "evidence_snippet", "email", "phone"]
RECORD_FIELDS = PERSON_FIELDS + ["source_url", "platform"]
LIST_FIELDS = ["skills", "target_countries"]
OUTREACH_FIELDS = ["outreach_status", "outreach_message", "outreach_sent_at", "reply_text", "replied_at",
                   "email", "phone", "contact_source", "contact_shared_at"]


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], struct(ddl))


def conform(df: DataFrame, ddl: str, extras: bool = False) -> DataFrame:
    """The columns of ``ddl`` in order; missing ones as null, list columns never null.

    A scalar given for a list column becomes a one-item list. ``extras`` keeps
    further columns behind the known ones.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in struct(ddl).fields:
        is_list = f.dataType.typeName() == "array"
        if f.name not in have:
            value = F.lit(None)
        elif is_list and have[f.name].typeName() != "array":
            value = F.when(F.col(f.name).isNotNull(), F.array(F.col(f.name).cast("string")))
        else:
            value = F.col(f.name)
        value = value.cast(f.dataType)
        cols.append((F.coalesce(value, F.array().cast(f.dataType)) if is_list else value).alias(f.name))
    known = {f.name for f in struct(ddl).fields}
    return df.select(*cols, *([c for c in df.columns if c not in known] if extras else []))


def conform_exact(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ``ddl`` in order and type, null lists kept null; missing ones as null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in struct(ddl).fields])


def serialise(df: DataFrame) -> DataFrame:
    """Plain text rows: timestamps as ISO strings, null lists as empty ones."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            out.append(iso(F.col(f.name)).alias(f.name))
        elif f.name in LIST_FIELDS:
            out.append(F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def iso(ts):
    """ISO 8601 in UTC; a fraction is shown only when there is one."""
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))
