"""Repeated word passages against brute force, and the edge cases."""

import hashlib
import random
import re

import pytest

from leadspark.llm import substring_dedup

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(rows, length):
    """(doc_id, words, removed, sha) of each row; null doc_ids are one last document."""
    order = lambda i: float("inf") if i is None else i
    words = [_WORD.findall((t or "").encode()) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - length + 1):
            key = tuple(w[p:p + length])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] < order(i):
                gone.update(range(p, p + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, length=substring_dedup.LENGTH):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, mark string, gram int, doc string")
    got = substring_dedup.remove_repeats(docs, length)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("length", [8, 50, 97])
def test_against_brute_force(spark, length):
    """Few different words, passages of every length around the window, shared in parts, with other words around them."""
    rng = random.Random(length)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (length - 1, length, length + 1, 2 * length, 5 * length, length, 12)]
    passages.append(["same"] * (3 * length))
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            lo, hi = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            text += rng.choice([p, p, p[lo:hi], [word() for _ in range(rng.randrange(2 * length))]])
        rows.append((rng.choice([i, i, i, 3, None]), rng.choice([" ", "\n", "\t  "]).join(text)))
    got = found(spark, rows, length)
    assert got == plain(rows, length)
    assert sum(r[2] for r in got) > 0


def test_edges(spark, monkeypatch):
    long = " ".join(f"w{i * i % 99991}x" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, long), (6, long), (6, long), (None, long), (None, "é " * 60), (7, "é " * 60),
            (8, "é\x0b" * 60), (9, long.replace("w25x", "changed"))]
    want = plain(rows, 50)
    assert found(spark, rows) == want
    assert {r[2] for r in want if r[0] == 6} == {30_000}
    assert found(spark, []) == []


def test_pieces_and_chunks_do_not_show(monkeypatch):
    text = ("  ab c\n" * 50 + "x" * 200 + " ").encode() * 4
    whole = substring_dedup.word_hashes(text)
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    assert (substring_dedup.word_hashes(text) == whole).all()
    monkeypatch.setattr(substring_dedup, "CHUNK", 7)
    starts = [start + p for start, s in substring_dedup._runs(text, 50) for at, lo, hi in zip(*s.segments()) for p in range(lo, hi + 1)]
    assert sorted(starts) == list(range(len(whole) - 49))


def test_cleaned_texts(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"a  {passage}\nb"), (2, f"c  {passage}\nd e"), (3, "f  g"), (4, None)], "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.cleaned(docs).collect())) == [(1, f"a  {passage}\nb"), (2, "c d e"), (3, "f  g"), (4, "")]
