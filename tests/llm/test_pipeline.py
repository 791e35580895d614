"""The pipeline against its stages by brute force."""

import hashlib
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from test_near_copies import jaccard, shingles

import corpus_pipeline
from leadspark.llm import packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append((name, docs.collect()))
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_every_stage_by_brute_force(spark, stages):
    rows = {name: [r.asDict() for r in part] for name, part in stages}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    now = [r for r in rows["documents"] if r["doc_id"] not in rejected]
    key = lambda r: r["doc_id"]
    assert sorted(rows["toxicity"], key=key) == sorted(now, key=key)
    best = {}
    for r in now:
        digest = hashlib.sha256("".join(r["text"].split()).encode()).digest()      # the tables hold ASCII white space only
        rank = (-len(r["text"]), r["doc_id"])
        best[digest] = min(best.get(digest, (rank, r)), (rank, r), key=lambda x: x[0])
    now = sorted((r for _, r in best.values()), key=key)
    assert sorted(rows["exact_dedup"], key=key) == now
    sets, root = [shingles(r["text"].lower()) for r in now], list(range(len(now)))
    for i in range(len(now)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert len(set(root)) < len(root)
    now = [r for i, r in enumerate(now) if root[i] == i]
    assert sorted(rows["near_dedup"], key=key) == now
    items = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    assert any(t in r["text"] for t in items for r in now)
    now = [r for r in now if not any(t in r["text"] for t in items)]
    assert sorted(rows["decontamination"], key=key) == now
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.public_vocabulary()), []
    for r in now:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((r["doc_id"], piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows["packing"]) == sorted(want)
    ends = {}
    for r in sorted(rows["packing"], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_equals_the_stages(spark, stages):
    places = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert places == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stages[-1][1])
