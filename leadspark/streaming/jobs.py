"""The incremental forms of the jobs, as Structured Streaming queries.

State is Spark's own (aggregation, de-duplication and keyed state); tables that change are kept in a bucketed store, of which a
micro-batch rewrites the buckets it touches, and all tables of a batch are committed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadspark.operators import candidates as C
from leadspark.operators import ledger as L
from leadspark.operators import stats as S
from leadspark.operators.keyed import spread
from leadspark.plans.batch import Settings, process
from leadspark.schemas import CANDIDATES, struct
from leadspark.schemas import LEDGER as LEDGER_DDL
from leadspark.sources.store import Store

LEDGER, PEOPLE = "ledger", "candidates"
TABLES = {LEDGER: (LEDGER_DDL, "url"), PEOPLE: (CANDIDATES, "source_url")}
ARRIVALS = ("url string, title string, snippet string, wave_tag string, pos bigint, final_url string, status int, "
            "ctype string, html string, via string, reply string, error_kind string, arrived_at timestamp")


def read_stream(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet", files_per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(struct(ddl)).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def start(df: DataFrame, write_batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(write_batch).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(arrivals: DataFrame, store: Store, checkpoint: str, robots: DataFrame | None = None, s: Settings = Settings()) -> StreamingQuery:
    """Each micro-batch drops handled URLs, processes the rest, and commits ledger and candidates as one version of ``store``.

    Of the ledger only the buckets of the batch's URLs are read and rewritten, of the candidates only those of the people it saves are
    rewritten. A replayed batch starts again from the version before it, so it ends in the same state.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if store.has(batch_id) or batch.isEmpty():
            return
        batch = spread(batch, "url").persist()     # one file may be one task, however many pages it has
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    def step(batch: DataFrame, batch_id: int) -> None:
        as_of = F.lit(batch.agg(F.max("arrived_at")).first()[0])
        pages = store.touched(LEDGER, batch)
        ledger = store.read(LEDGER, buckets=pages)
        fresh = L.fresh_urls(batch, ledger, as_of).select("url")
        todo = batch.join(fresh, "url", "left_semi")
        done = process(
            todo.select("url", "title", "snippet", "wave_tag", "pos"),
            todo.filter("status IS NOT NULL").select("url", "final_url", "status", "ctype", "html", "via"),
            todo.filter("reply IS NOT NULL OR error_kind IS NOT NULL").select("url", "reply", "error_kind"),
            ledger, store.read(PEOPLE), as_of, robots, s)
        # The back-fill is for all candidates: buckets that need it are rewritten too, which only the first batch over a loaded table finds.
        sources = store.touched(PEOPLE, done.people.select("source_url").unionByName(C.unsourced(store.read(PEOPLE))))
        saved = C.upsert(store.read(PEOPLE, buckets=sources), done.people, as_of)
        store.commit(batch_id, {LEDGER: (done.ledger, pages), PEOPLE: (saved, sources)})

    return start(arrivals, run, checkpoint)


def deduplicated(hits: DataFrame, time: str, horizon: str, ledger: DataFrame, as_of: Column) -> DataFrame:
    """First occurrence of each URL within the horizon that the full ledger does not hold.

    State is bounded by the watermark; anything older is the ledger's business.
    """
    once = hits.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["url"])
    return once.join(ledger.filter(L.handled(as_of)).select("url"), "url", "left_anti")


def expired(events: DataFrame, time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """(url, pending_since) of pages left pending for an hour without another event.

    A session with a one-hour gap per URL closes exactly then, so no timer code is needed.
    """
    return expired_sessions(events.withWatermark(time, delay), time)


def expired_sessions(events: DataFrame, time: str = "ts") -> DataFrame:
    last = events.groupBy(F.session_window(time, "1 hour").alias("w"), "url").agg(
        F.max_by("status", time).alias("status"), F.max(time).alias("pending_since"))
    return last.filter(F.col("status") == "pending").select("url", "pending_since")


def live_wave_stats(events: DataFrame) -> DataFrame:
    """Running counters per wave (complete or update mode)."""
    return S.folded_stats(events)


def outreach(events: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Candidates that follow an outreach event stream.

    Unknown statuses and contacts that are not in a reply's text change nothing. The state holds the last value per field, and each micro-batch emits the candidates it
    changed with all their fields, so writing them again is harmless. Ids and source URLs of all candidates are read to find the buckets
    of the changed ones; only those are rewritten.
    """
    def run(changes: DataFrame, batch_id: int) -> None:
        if store.has(batch_id):
            return
        changes = changes.persist()
        try:
            hit = store.read(PEOPLE).select("id", "source_url").join(changes.select("id"), "id", "left_semi")
            store.change(batch_id, PEOPLE, hit, lambda old: C.apply_changes(old, changes))
        finally:
            changes.unpersist()

    return start(C.outreach_changes(C.checked_events(events)), run, checkpoint, "update")
