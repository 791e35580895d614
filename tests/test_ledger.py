import datetime as dt

from pyspark.sql import functions as F

from leadspark.operators import ledger as L
from leadspark.schemas import LEDGER

NOW = dt.datetime(2024, 1, 31)


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def ledger(spark):
    rows = [("http://h/%s%d" % (s, age), "h", "W0:x", None if s == "null" else s, NOW - dt.timedelta(minutes=age))
            for s in ("ok", "snippet", "walled", "failed", "robots", "quota", "pending", "null") for age in (30, 61)]
    return spark.createDataFrame(rows, LEDGER)


def test_freshness(spark):
    old = ledger(spark)
    urls = old.select("url", F.lit(1).alias("pos")).unionByName(spark.createDataFrame(
        [("http://h/new", 2), ("http://h/new", 3), ("", 4), (None, 5)], "url string, pos int"))
    fresh = {r.url.removeprefix("http://h/"): r.pos for r in L.fresh_urls(urls, old, as_of()).collect()}
    assert fresh == {"new": 2, **{k: 1 for k in ("robots30", "robots61", "quota30", "quota61", "pending61", "null61")}}


def test_record_and_status(spark):
    old = ledger(spark)
    urls = old.select("url", F.lit("W1:y").alias("wave_tag"), F.lit(1).alias("pos")).unionByName(
        spark.createDataFrame([("http://u@N:8/x", "W1:y", 2)], "url string, wave_tag string, pos int"))
    new = L.record_urls(old, urls, as_of())
    reset = {r.url.removeprefix("http://h/") for r in new.filter("wave_tag = 'W1:y'").collect()}
    assert reset == {f"{s}{a}" for s in ("robots", "quota", "pending") for a in (30, 61)} | {"http://u@N:8/x"}
    assert new.filter("url = 'http://u@N:8/x'").first().domain == "u@n:8"
    key = ["url", "status", "wave_tag", "scraped_at"]
    assert L.record_urls(new, urls, as_of()).select(key).exceptAll(new.select(key)).count() == 0     # same again
    done = L.set_status(new, spark.createDataFrame([("http://h/null30", "ok"), ("http://gone", "ok")], "url string, status string"))
    assert done.count() == 17 and done.filter("url = 'http://h/null30'").first().status == "ok"
