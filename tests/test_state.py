"""Timers and keyed state: restarts, ledgers that move."""

import tempfile
from datetime import datetime


from leadspark.streaming import jobs as J
from leadspark.streaming import state as ST

EVENT = "url string, status string, ts timestamp"
LEDGER = "url string, status string, scraped_at timestamp"


def at(text):
    return datetime.fromisoformat(f"2024-01-01 {text}")


def add(spark, folder, rows, ddl=EVENT):
    """One more file of a stream, with one row for each event."""
    spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], ddl).coalesce(1).write.mode("append").parquet(folder)


def run(spark, df, root):
    q = J.start(df, lambda b, i: b.write.mode("overwrite").parquet(f"{root}/out/b={i}"), f"{root}/ck")
    q.awaitTermination()
    assert not q.exception()
    return sorted(map(tuple, spark.read.parquet(f"{root}/out").drop("b").collect()))


def test_timers_survive_a_restart(spark):
    root = tempfile.mkdtemp(prefix="timers-")
    ledger = spark.createDataFrame([("old", "pending", at("00:10:00")), ("done", "ok", at("00:10:00")), ("soon", "pending", at("00:30:00"))], LEDGER)
    add(spark, f"{root}/in", [("a", "pending", "01:00:00"), ("b", "pending", "01:00:00"), ("b", "ok", "01:20:00"), ("soon", "ok", "01:05:00")])
    start = lambda: ST.pending_timers(J.read_stream(spark, f"{root}/in", EVENT), ledger)
    first = run(spark, start(), root)
    assert first == [("old", at("00:10:00"))]               # the watermark is at 01:20
    add(spark, f"{root}/in", [("c", "pending", "02:00:00"), ("d", "ok", "02:00:00")])
    second = run(spark, start(), root)
    assert second == [("a", at("01:00:00")), ("old", at("00:10:00"))]
    add(spark, f"{root}/in", [("c", "pending", "03:30:00"), ("x", "ok", "09:00:00")])
    assert run(spark, start(), root) == [("a", at("01:00:00")), ("c", at("02:00:00")), ("c", at("03:30:00")), ("old", at("00:10:00"))]


def test_timers_equal_sessions(spark):
    root = tempfile.mkdtemp(prefix="timers-")
    rows = [(f"u{i % 5}", "pending" if i * 7 % 3 else "ok", f"{(i * 37 % 600) // 60 + 1:02d}:{i * 37 % 60:02d}:00") for i in range(60)]
    add(spark, f"{root}/in", sorted(set(rows), key=lambda r: r[2]))
    timers = run(spark, ST.pending_timers(J.read_stream(spark, f"{root}/in", EVENT)), root)
    other = tempfile.mkdtemp(prefix="sessions-")
    assert timers == run(spark, J.expired(J.read_stream(spark, f"{root}/in", EVENT)), other) and len(timers) > 3


def test_a_url_recorded_while_the_stream_runs_is_refused(spark):
    root = tempfile.mkdtemp(prefix="sights-")
    ledger = spark.createDataFrame([("known", "ok", at("00:00:00")), ("retry", "quota", at("00:00:00")), ("stale", "pending", at("00:00:00")),
                                    ("young", None, at("00:30:00"))], LEDGER)
    hit = "url string, ts timestamp"
    add(spark, f"{root}/hits", [(u, "01:10:00") for u in ("new", "known", "retry", "stale", "young", "later")], hit)
    add(spark, f"{root}/ledger", [("nobody", "ok", "01:00:00")])
    start = lambda: ST.first_sights(J.read_stream(spark, f"{root}/hits", hit), J.read_stream(spark, f"{root}/ledger", EVENT), ledger)
    assert [u for u, _ in run(spark, start(), root)] == ["later", "new", "retry", "stale"]
    add(spark, f"{root}/ledger", [("new", "ok", "01:20:00"), ("unseen", "walled", "01:20:00"), ("later", "robots", "01:20:00")])
    add(spark, f"{root}/hits", [(u, "05:00:00") for u in ("new", "unseen", "later", "stale", "young")], hit)
    seen = run(spark, start(), root)
    # final statuses are refused; robots may be tried again; an hour-old pending page and one without a status too
    assert [u for u, t in seen if t == at("05:00:00")] == ["later", "stale", "young"]


def test_a_hit_repeated_within_the_hour_passes_once(spark):
    root = tempfile.mkdtemp(prefix="sights-")
    add(spark, f"{root}/hits", [("a", "01:00:00"), ("a", "01:59:59"), ("a", "02:00:01"), ("a", "02:30:00")], "url string, ts timestamp")
    got = run(spark, ST.first_sights(J.read_stream(spark, f"{root}/hits", "url string, ts timestamp")), root)
    assert got == [("a", at("01:00:00")), ("a", at("02:00:01"))]


def test_state_from_a_fixed_time(spark):
    root = tempfile.mkdtemp(prefix="sights-")
    add(spark, f"{root}/hits", [("a", "01:00:00"), ("a", "09:00:00")], "url string, ts timestamp")
    got = run(spark, ST.first_sights(J.read_stream(spark, f"{root}/hits", "url string, ts timestamp"), now=at("10:00:00")), root)
    assert [u for u, _ in got] == ["a"]


class _Counted:
    """A value state and its timers that count the calls made to them."""

    def __init__(self, value=None):
        self.value, self.calls, self.timers = value, 0, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


def test_the_store_is_not_called_for_each_row():
    hour = ST.HOUR_MS
    store, timers = _Counted(), ST.PendingTimers()
    timers.init(store)
    rows = [{"status": "pending", "ms": k * hour // 2} for k in range(1000)] + [{"status": "pending", "ms": 1001 * hour}]
    assert [r.pending_ms for r in timers.handleInputRows(("u",), iter(rows), None)] == [999 * hour // 2]
    assert store.value == (1001 * hour,) and store.timers == {1002 * hour - 1} and store.calls < 10
    assert [r.pending_ms for r in timers.handleInputRows(("u",), iter([{"status": "ok", "ms": 1003 * hour}]), None)] == [1001 * hour]
    assert store.value is None and not store.timers
    store, sights = _Counted(("ok", 0)), ST.FirstSights()
    sights.init(store)
    hits = [{"kind": "hit", "status": None, "ms": k} for k in range(1000)]
    assert not list(sights.handleInputRows(("u",), iter(hits), None)) and store.calls < 10
    late = [{"kind": "recorded", "status": "quota", "ms": 2000}] + [{"kind": "hit", "status": None, "ms": 2000 + k} for k in range(3)]
    assert [r.ms for r in sights.handleInputRows(("u",), iter(late), None)] == [2000] and store.value == ("pending", 2000)
