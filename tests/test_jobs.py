"""Whole jobs, snapshots, streams, exports."""

import tempfile

from pyspark.sql import functions as F

from leadspark import schemas as S
from leadspark.operators import candidates as C
from leadspark.operators import hits as HT
from leadspark.operators import review as RV
from leadspark.plans import catalog_people as CP
from leadspark.plans import driver_views as V
from leadspark.sources import tables as TB

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stream_ingest_equals_batch(spark):
    batch, stream = rows(CP.process_batch(spark, SF)), rows(CP.stream_ingest(spark, SF))
    assert [r[:2] for r in batch] == [r[:2] for r in stream]     # same pages, same final status
    assert {r[1] for r in batch} >= {"ok", "quota"} and sum(r[2] for r in stream) > 0


def test_an_arriving_file_is_many_tasks(spark, monkeypatch):
    from leadspark.streaming import jobs as J

    parts, fresh = [], J.L.fresh_urls

    def counted(batch, *others):
        parts.append(batch.rdd.getNumPartitions())
        return fresh(batch, *others)

    monkeypatch.setattr(J.L, "fresh_urls", counted)
    CP.stream_ingest(spark, SF)
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2


def test_upsert_with_own_output_changes_no_scalar(spark):
    stored = V.stored(spark, SF)
    once = C.upsert(stored, stored.select(*S.RECORD_FIELDS), V.as_of())
    for f in ("name", "email", "phone", "platform", "id", "outreach_status"):
        assert once.select("source_url", f).exceptAll(stored.select("source_url", f)).count() == 0


def test_snapshots_skip_unfinished_versions(spark):
    store = TB.Snapshots(spark, tempfile.mkdtemp(prefix="snap-"), S.LEDGER)
    assert store.read().count() == 0
    store.write(V.ledger(spark, SF), 1)
    n = store.read().count()
    V.ledger(spark, SF).limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.root}/v=2")
    assert store.versions() == [1] and store.read().count() == n and store.read(before=1).count() == 0


def test_export_and_reimport(spark):
    out = tempfile.mkdtemp(prefix="export-")
    stored = V.stored(spark, SF).withColumn("evidence_snippet", F.concat(F.lit("said \"yes\";\n, "), "evidence_snippet"))
    TB.write_csv(stored, out + "/csv")
    back = RV.reimported(TB.read_edited_csv(spark, out + "/csv"))
    assert back.filter("valid").count() == stored.count()
    key = ["source_url", "name", "skills", "email", "phone"]
    assert back.select(key).exceptAll(stored.select(key)).count() == 0
    TB.write_json(stored, out + "/json")
    assert spark.read.json(out + "/json").count() == stored.count()


def test_top_up_takes_the_secondary_only_where_thin(spark):
    hit = "query string, query_seq int, engine string, engine_seq int, rank int, url string, title string, snippet string"
    prim = spark.createDataFrame([("a", 0, "ddg", 0, i, f"u{i}", "", "") for i in range(3)] + [("b", 1, "ddg", 0, 0, "u0", "", "")], hit)
    sec = spark.createDataFrame([(q, s, "google", 1, i, f"u{i}", "", "") for q, s in (("a", 0), ("b", 1)) for i in range(5)], hit)
    queries = spark.createDataFrame([("a", 0), ("b", 1)], "query string, query_seq int")
    count = lambda **kw: {r.query: r["count"] for r in HT.topped_up(queries, prim, sec, 2, **kw).groupBy("query").count().collect()}
    assert count() == {"a": 3, "b": 4}
    assert count(backend="duckduckgo") == {"a": 3, "b": 1} == count(backend="google", has_secondary=False)
    assert count(backend="google") == {"a": 4, "b": 4}


def test_process_reads_its_source_tables(spark, tmp_path):
    """The same batch from tables in files, with columns in another order and without robots, and from frames."""
    from leadspark.plans import batch as B

    items, responses, replies = CP._batch_inputs(spark, SF)
    items.select("pos", "url", "wave_tag", "title", "snippet").write.parquet(str(tmp_path / "items"))
    responses.drop("via").withColumn("via", F.lit("direct")).write.parquet(str(tmp_path / "responses"))
    replies.write.json(str(tmp_path / "replies"))
    none = S.empty(spark, S.LEDGER), S.empty(spark, S.CANDIDATES), V.as_of()
    got = B.process_folder(spark, str(tmp_path), *none)
    want = B.process(items, responses, replies, *none)
    assert rows(got.ledger) == rows(want.ledger) and rows(got.candidates.select("name", "source_url")) == rows(want.candidates.select("name", "source_url"))
    spark.createDataFrame([("https://none.example", "User-agent: *\nDisallow: /")], "base string, body string").write.parquet(str(tmp_path / "robots"))
    assert TB.read_inputs(spark, str(tmp_path)).robots.count() == 1


def test_exported_files_hold_what_was_exported(spark, tmp_path):
    import json

    stored = V.stored(spark, SF).withColumn("evidence_snippet", F.concat(F.lit("é \"q\" "), "evidence_snippet"))
    TB.write_json(stored, str(tmp_path / "json"))
    lines = [json.loads(line) for f in (tmp_path / "json").glob("part-*") for line in f.read_text(encoding="utf-8").splitlines()]
    want = {r["id"]: r.asDict() for r in S.serialise(stored).collect()}
    assert {x["id"]: x for x in lines} == want
    assert any("é" in f.read_text(encoding="utf-8") for f in (tmp_path / "json").glob("part-*"))


def test_rejected_edits_are_told(spark):
    from leadspark.plans import batch as B

    stored = V.stored(spark, SF).limit(5)
    edits = RV.export_rows(stored.select(*S.RECORD_FIELDS)).withColumn("pos", F.monotonically_increasing_id()).withColumn(
        "source_url", F.when(F.col("pos") == 0, "no url").otherwise(F.col("source_url")))
    saved = B.saved_records(edits, stored, V.as_of())
    assert saved.rejected.count() == 1 and saved.candidates.count() == 5
