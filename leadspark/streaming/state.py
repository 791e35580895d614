"""Keyed state with timers: pages that stay pending, and URLs that were seen.

Both keep one small value for each URL in the state store (RocksDB, so state may exceed memory), start from a ledger table, and go on from
their checkpoint after a restart. A call into the store is a message to the JVM, so the rows of a batch are gone through on plain values: the
store is read once and written once for each URL and batch, not for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadspark import constants as K

HOUR_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(df: DataFrame) -> None:
    """Keyed state with timers needs the RocksDB store; the setting counts when the query starts."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)



class PendingTimers(StatefulProcessor):
    """Keeps the time since which a URL is pending, with a timer one hour later; any other event clears both.

    Rows hold (url, status, ms). The state has an entry for pending URLs only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "ms bigint")

    def _set(self, ms: int | None) -> None:
        if self.since.exists():
            self.handle.deleteTimer(self.since.get()[0] + HOUR_MS - 1)
            self.since.clear()
        if ms is not None:
            self.since.update((ms,))
            # A timer fires once the watermark is past it, so this one fires when the hour is full.
            self.handle.registerTimer(ms + HOUR_MS - 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState["status"] == "pending":
            self._set(initialState["ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, before = [], self.since.get()[0] if self.since.exists() else None
        since = before
        for row in sorted(rows, key=lambda r: (r["ms"], r["status"] != "pending")):
            if since is not None and row["ms"] >= since + HOUR_MS:
                out.append(Row(url=key[0], pending_ms=since))       # the hour was full before this event
            since = row["ms"] if row["status"] == "pending" else None
        if since != before:
            self._set(since)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = self.since.get()[0]
        self.since.clear()
        return iter([Row(url=key[0], pending_ms=ms)])

    def close(self) -> None:
        pass


def pending_timers(events: DataFrame, ledger: DataFrame | None = None, time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """(url, pending_since) of pages left pending for an hour without another event, by a timer for each URL.

    ``events`` holds url, status and the event time. ``ledger`` (url, status, scraped_at) gives the pages that were pending when the stream first started.
    """
    use_state_store(events)
    rows = events.withWatermark(time, delay).select("url", "status", F.unix_millis(time).alias("ms"), time)
    first = None if ledger is None else ledger.filter("status = 'pending'").select("url", "status", F.unix_millis("scraped_at").alias("ms")).groupBy("url")
    out = rows.groupBy("url").transformWithState(PendingTimers(), "url string, pending_ms bigint", "Append", "EventTime", initialState=first)
    return out.select("url", F.timestamp_millis("pending_ms").alias("pending_since"))


class FirstSights(StatefulProcessor):
    """Lets a URL pass unless the ledger, as it stands by then, counts it as handled.

    Rows hold (url, kind, status, ms): hits, and what the ledger records while the stream runs. A URL that passes is pending from then on, so
    it may pass again an hour later unless a final status is recorded. ``now`` fixes the time that the hour is counted to.
    """

    def __init__(self, now: int | None = None):
        self.now = now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "status string, ms bigint")

    def _handled(self, entry: tuple | None, now: int) -> bool:
        """The ledger's rule with its three-valued logic: without a status a URL is handled while young."""
        if entry is None:
            return False
        status, ms = entry
        young = ms >= now - HOUR_MS
        return young if status is None or status == "pending" else status not in K.RETRYABLE_STATUSES

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.entry.update((initialState["status"], initialState["ms"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, before = [], tuple(self.entry.get()) if self.entry.exists() else None
        entry = before
        for row in sorted(rows, key=lambda r: (r["ms"], r["kind"] == "hit")):
            now = self.now if self.now is not None else row["ms"]
            if row["kind"] == "recorded":
                entry = (row["status"], row["ms"])
            elif not self._handled(entry, now):
                entry = ("pending", now)
                out.append(Row(url=key[0], ms=row["ms"]))
        if entry != before:
            self.entry.update(entry)
        return iter(out)

    def close(self) -> None:
        pass


def first_sights(hits: DataFrame, recorded: DataFrame | None = None, ledger: DataFrame | None = None, now: datetime | None = None, time: str = "ts") -> DataFrame:
    """(url, seen_at) of hits (url, time) that the ledger does not hold as handled when they arrive.

    ``ledger`` (url, status, scraped_at) is what is known at the first start; ``recorded`` is a stream (url, status, time) of what the ledger
    records afterwards, so a page recorded while the stream runs is refused from then on.
    """
    use_state_store(hits)
    rows = hits.select("url", F.lit("hit").alias("kind"), F.lit(None).cast("string").alias("status"), F.unix_millis(time).alias("ms"))
    if recorded is not None:
        rows = rows.unionByName(recorded.select("url", F.lit("recorded").alias("kind"), "status", F.unix_millis(time).alias("ms")))
    first = None if ledger is None else ledger.select("url", "status", F.unix_millis("scraped_at").alias("ms")).groupBy("url")
    fixed = None if now is None else int(now.replace(tzinfo=timezone.utc).timestamp() * 1000)
    out = rows.groupBy("url").transformWithState(FirstSights(fixed), "url string, ms bigint", "Append", "None", initialState=first)
    return out.select("url", F.timestamp_millis("ms").alias("seen_at"))
