"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from leadspark.llm import (decontaminate, exact_dedup, licenses, packing, pii, sharding, simhash, suffix_dedup, toxicity,
                           url_filter)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, _mark string, _text string, _items string, "
          "_score string, row string, digest string, fp string, mark string, doc string")
LONG = " ".join(f"w{i * i % 9973}x" for i in range(60_000))
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (5, "one  two three"), (5, "one two three"), (4, "one two three"),
         (None, "one two three"), (None, None), (6, LONG), (7, LONG), (8, "é" * 150), (9, "Licensed under CC BY-NC 4.0."),
         (10, "mail a.b@c-d.example.org or +1 (017) 555-7713"), (4, None)]


def table(spark, rows):
    filler = ["x", "y", None, *["clash"] * 10]
    return spark.createDataFrame([(i, t, *filler[:2], None, *filler[3:]) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 11)] + [(None, 1, 1), (3, None, None), (4, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tests_(spark):
    return spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def test_packing(spark, docs, nothing):
    got = packing.pack(docs, packing.public_vocabulary()).collect()
    assert {r.doc_id for r in got} == {i for i, _ in TEXTS}
    assert sum(r.length == 1 for r in got if r.doc_id in (1, 2, 3)) == 3          # no text: the end id alone
    assert [r.piece for r in sorted((r for r in got if r.doc_id == 6), key=lambda r: r.start)] == list(range(sum(r.doc_id == 6 for r in got)))
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = {}
    for sequence, offset, length in places:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= packing.CAPACITY
    assert packing.pack(nothing, packing.public_vocabulary()).count() == 0


def test_sharding(spark, docs, nothing):
    got = sharding.shard(docs, 3).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(nothing).count() == 0


def test_exact_dedup(spark, docs, nothing):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(TEXTS)
    norm = {i: "".join((t or "").split(" ")).replace("\t", "").replace("\n", "") for i, t in enumerate(t for _, t in TEXTS)}
    sizes = {hashlib.sha256(n.encode()).hexdigest(): sum(m == n for m in norm.values()) for n in norm.values()}
    assert {r.text_sha256: r.group_size for r in got} == sizes
    for digest in sizes:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1
    three = hashlib.sha256(b"onetwothree").hexdigest()
    assert {r.keep_id for r in got if r.text_sha256 == three} == {5}              # most code points, then smallest doc_id
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(sizes)
    assert exact_dedup.exact_groups(nothing).count() == exact_dedup.drop_copies(nothing).count() == 0


def test_simhash(spark, docs, nothing):
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r.fingerprint for r in got if r.doc_id in (2, 3)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in got})
    assert simhash.near_groups(nothing).count() == simhash.drop_near_copies(nothing).count() == 0


def test_decontamination(spark, docs, nothing, tests_):
    got = decontaminate.contamination(docs, tests_).collect()
    assert len(got) == len(TEXTS)
    assert sum(r.contaminated for r in got) == sum(t is not None and t.split() == ["one", "two", "three"] for _, t in TEXTS)
    kept = decontaminate.drop_contaminated(docs, tests_)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate.contamination(nothing, tests_).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, tests_.limit(0)).collect())


def test_toxicity(spark, docs, nothing, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_licenses(spark, docs, nothing):
    got = licenses.scan(docs).collect()
    assert len(got) == len(TEXTS)
    assert [(r.text_license, r.line_licenses, r.n_license_lines) for r in got if r.doc_id == 9] == [("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1)]
    assert {(r.text_license, r.line_licenses) for r in got if r.doc_id != 9} == {(None, "")}
    assert licenses.scan(nothing).count() == 0


def test_pii(spark, docs, nothing):
    got = pii.find(docs).collect()
    assert len(got) == len(TEXTS)
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in got if r.doc_id == 10] == [(1, 0, 0, 1, "email:5:24,phone:28:45")]
    assert {r.base_sha256 for r in got if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(nothing).count() == 0


def test_suffix_dedup(spark, docs, nothing):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(TEXTS)
    n = len(LONG.encode())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id == 7] == [(n, n, 1, hashlib.sha256(b"").hexdigest())]
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id == 8] == [(300, 298, 1)]     # all strings but the first two
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_url_filter(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?y"), (4, "HTTP://WWW.Example.COM/en/x?y"),
            (None, "http://a.net/fr/#z"), (5, "http://Ä.example.com/en/"), (6, "http://com"), (7, "http://com/"), (8, "x://" + "a." * 5000 + "net/es/")]
    pages = spark.createDataFrame([(i, u, "host", "rule") for i, u in urls], "page_id long, url string, host string, rule string")
    got = sorted(((r.page_id or 0, r.host[:20], r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()), key=str)
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), *[(4, "www.example.com", "/en/x", "www.example.com/en/", "allow")] * 2,
        (0, "a.net", "/fr/", "net/fr/", "block"), (5, "Ä.example.com", "/en/", "example.com/en/", "block"), (6, "com", "", None, "allow"),
        (7, "com", "/", "com/", "allow"), (8, "a." * 10, "/es/", "net/es/", "block")], key=str)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert now.count() > 0
