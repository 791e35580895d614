"""Removal of repeated word passages by level-wise doubling of window lengths.

A word goes when a window of ``LENGTH`` = 50 consecutive words that covers it also starts in a document with a smaller doc_id. Windows
are compared at doubling lengths, and only what repeats across documents at one length is extended to the next (16 -> 32 -> 50 words):

1. *16 words.* Of the 35 stretches of 16 words in a window the one with the smallest hash is its anchor. Equal windows have equal
   anchors, so anchors alone (one position in 18) stand for all windows. Windows of one anchor form a segment. Segments whose
   anchor occurs in one document only leave.
2. *Whole segments.* Segments with the same words hold the same windows: those of later documents are covered as a whole, and
   only those of the first document go on.
3. *32 words.* A window holds the 32 words from its anchor on, or the 32 words that end with the anchor, or both. What
   does not occur in two documents rules its windows out.
4. *50 words.* Windows that are left are compared one by one; those of later documents are covered.

Words count by their bytes. Stretches are compared by hashes: two different windows around an anchor of equal words are taken for equal
with probability 2^-64, two different anchors with 2^-64 again. Groups are never gathered: each level is a partial
aggregation (smallest and largest document) and a join back, which adaptive execution splits where one key is hot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, release, stored, text_mark, whole_text

LENGTH = 50
SHORTEST = 8                # least window length
PIECE = 1 << 22             # bytes of a text split into words at a time
CHUNK = 1 << 18             # words of a text whose stretches are hashed at a time
LAST = (1 << 63) - 1        # stands for a null doc_id: it comes last

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def levels(length: int) -> tuple[int, int, int]:
    """(anchor, extended, half): window lengths of the levels, all powers of two; two halves cover a window of ``length``.

    For each place of the anchor in a window, the extended stretch after it or before it lies in the window.
    """
    if length < SHORTEST:
        raise ValueError(f"windows have at least {SHORTEST} words")
    half = 1 << (length.bit_length() - 1)
    anchor = half // 2 if length >= 3 * half // 2 - 1 else half // 4
    return anchor, 2 * anchor, half


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded piece at a time."""
    lo = 0
    while lo < len(text):
        cut = _SPACE.search(text, lo + PIECE) if lo + PIECE < len(text) else None
        hi = cut.start() if cut else len(text)
        yield text[lo:hi].split()
        lo = hi


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) for words in word_pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The hash of two stretches, one behind the other."""
    with np.errstate(over="ignore"):
        out = (a ^ (a >> np.uint64(31))) * _FACTORS[salt] + b
        return (out ^ (out >> np.uint64(29))) * _FACTORS[(salt + 7) % 16]


class Stretches:
    """Hashes of all stretches of the levels' lengths in a run of words."""

    def __init__(self, words: np.ndarray, length: int):
        self.length = length
        self.anchor, self.extended, self.half = levels(length)
        self.by = {1: words}
        size = 1
        while size < self.half:
            h = self.by[size]
            self.by[2 * size] = _joined(h[:-size], h[size:], size.bit_length())
            if size not in (self.anchor, self.extended):
                del self.by[size]
            size *= 2

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window) of each segment."""
        h, reach = self.by[self.anchor], self.length - self.anchor + 1
        least, size = h, 1
        while 2 * size <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:len(h) - reach + 1], least[reach - size:])
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        hi = np.append(lo[1:], len(least)) - 1
        parts = []
        while len(lo):      # the smallest hash may repeat: windows behind its first place belong to the next one
            at = lo + np.lib.stride_tricks.sliding_window_view(h, reach)[lo].argmin(axis=1)
            parts.append((at, lo, np.minimum(hi, at)))
            lo, hi = at[hi > at] + 1, hi[hi > at]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def whole(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of a segment: all its words, its number of windows and the place of its anchor."""
        h, end = self.by[self.anchor], hi + self.length - self.anchor
        out = _joined(h[lo], ((hi - lo) * 4096 + (at - lo)).astype(np.uint64), 9)
        for step in range(self.anchor, 2 * self.length, self.anchor):
            out = _joined(out, h[np.minimum(lo + step, end)], 10)
        return out

    def window(self, lo: np.ndarray) -> np.ndarray:
        h = self.by[self.half]
        return _joined(h[lo], h[lo + self.length - self.half], 12)


def _runs(text: bytes, length: int) -> Iterator[tuple[int, Stretches]]:
    """(start, stretches) of runs of words that hold each window of a text once."""
    words = word_hashes(text)
    for start in range(0, len(words) - length + 1, CHUNK):
        yield start, Stretches(words[start:start + CHUNK + length - 1], length)


_SEGMENT = "gram long, seg long, after long, before long, doc long, mark long, lo int, at int, hi int"


def _segments(length: int):
    """Arrow mapper from (doc, mark, text) to segments; ``at`` and ``hi`` count from ``lo``.

    ``after`` and ``before`` are the extended stretches; null where no window of the segment holds them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, extended, _ = levels(length)
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in ("u8", "u8", "u8", "u8", "i8", "i8", "i8", "i8")]
            for row, text in enumerate(batch.column(2)):
                for start, s in _runs(text.as_buffer().to_pybytes(), length):
                    at, lo, hi = s.segments()
                    long = s.by[extended]
                    after, before = long[np.minimum(at, len(long) - 1)], long[np.maximum(at - anchor, 0)]
                    for column, values in zip(out, (s.by[anchor][at], s.whole(lo, hi, at), after, before, np.full(len(at), row), lo + start, at - lo, hi - lo)):
                        column.append(values)
            gram, seg, after, before, row, lo, at, hi = (np.concatenate(c) for c in out)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(after.view(np.int64), mask=at - hi > length - extended),
                 pa.array(before.view(np.int64), mask=at < anchor), batch.column(0).take(row), batch.column(1).take(row),
                 *[pa.array(c.astype(np.int32)) for c in (lo, at, hi)]],
                ["gram", "seg", "after", "before", "doc", "mark", "lo", "at", "hi"])
    return run


def _windows(length: int):
    """Arrow mapper from (doc, mark, runs, text) to (gram, whole, doc, mark, lo) of the asked windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, whole, row, place = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (runs, text) in enumerate(zip(batch.column(2), batch.column(3))):
                grams, first, last = (runs.values.field(k).to_numpy().astype(np.int64) for k in range(3))
                for start, s in _runs(text.as_buffer().to_pybytes(), length):
                    lo, hi = np.maximum(first, start), np.minimum(last, start + CHUNK - 1)
                    n = np.maximum(hi - lo + 1, 0)
                    p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    gram.append(np.repeat(grams, n))
                    whole.append(s.window(p - start))
                    row.append(np.full(len(p), i))
                    place.append(p)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(gram)), pa.array(np.concatenate(whole).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(np.concatenate(place).astype(np.int32))], ["gram", "whole", "doc", "mark", "lo"])
    return run


def kept_words(text: bytes, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, words that stay) of each piece of a text; words in the ranges go."""
    change: np.ndarray | None = None
    if len(first):
        change = np.cumsum(np.bincount(first, minlength=last.max() + 1) - np.bincount(last, minlength=last.max() + 1)) > 0
    start = 0
    for words in word_pieces(text):
        stay = words
        if change is not None and start < len(change):
            gone = change[start:start + len(words)].tolist()
            stay = [w for w, g in zip(words, gone + [False] * (len(words) - len(gone))) if not g]
        yield len(words), stay
        start += len(words)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper from (doc_id, text, runs) to the report."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, runs in zip(batch.column(1), batch.column(2)):
            first, last = (runs.values.field(k).to_numpy().astype(np.int64) if runs.is_valid else np.zeros(0, np.int64) for k in range(2))
            words = kept = 0
            digest = hashlib.sha256()
            for n, stay in kept_words(text.as_buffer().to_pybytes(), first, last):
                if stay:
                    digest.update((b" " if kept else b"") + b" ".join(stay))
                words, kept = words + n, kept + len(stay)
            for column, value in zip(out, (words, words - kept, digest.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper from (doc_id, text, runs) to (doc_id, text) without the words that go; other texts stay as they are."""
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes()
            if runs.is_valid:
                first, last = (runs.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                data = b" ".join(w for _, stay in kept_words(data, first, last) for w in stay)
            texts.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def _placed(docs: DataFrame) -> DataFrame:
    """doc, mark, text of each row; the mark tells rows apart where doc_id repeats or is null."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    mark = F.lit(0).cast("long") if odd.isEmpty() else text_mark()
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), mark.alias("mark"), whole_text().alias("text"))


def _across(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur in two documents at least, with their smallest document.

    Stored, so that a join with them reads two plain exchanges, which is what adaptive execution can split where a key is hot.
    """
    return stored(df.groupBy(*keys).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).filter("first_doc < last_doc").drop("last_doc"))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, mark, first, last): ranges of words that go, as they are found; they overlap. Each level is stored, files of the one before it go."""
    spark = texts.sparkSession
    anchor, extended, _ = levels(length)
    long = texts.filter(F.octet_length("text") >= 2 * length - 1).select("doc", "mark", "text")
    every = stored(long.mapInArrow(_segments(length), _SEGMENT))
    several = _across(every, ["gram"])
    segments = stored(every.join(several.select("gram"), "gram", "left_semi"))
    discard(every)
    discard(several)
    release(spark)

    several = _across(segments, ["gram", "seg"])
    marked = stored(segments.join(several, ["gram", "seg"], "left").drop("seg"))
    discard(segments)
    discard(several)
    release(spark)
    later = stored(marked.filter("doc > first_doc").select("doc", "mark", F.col("lo").alias("first"), (F.col("lo") + F.col("hi") + length).alias("last")))
    firsts = stored(marked.filter("first_doc IS NULL OR doc = first_doc").drop("first_doc"))
    discard(marked)

    sides = {side: _across(firsts.filter(F.col(side).isNotNull()), ["gram", side]) for side in ("after", "before")}
    left = firsts
    for side, several in sides.items():
        left = left.join(several.select("gram", side, F.lit(True).alias(f"{side}_again")), ["gram", side], "left")
    # Windows that start ``anchor`` words or more before the anchor hold the stretch before it, those that start at most length - extended before it the one after.
    first = F.when(F.col("before_again").isNull(), F.greatest(F.lit(0), F.col("at") - anchor + 1)).otherwise(0)
    last = F.when(F.col("after_again").isNull(), F.least(F.col("hi"), F.col("at") - (length - extended) - 1)).otherwise(F.col("hi"))
    runs = left.filter("after_again IS NOT NULL OR before_again IS NOT NULL").select(
        "doc", "mark", "gram", (F.col("lo") + first).alias("first"), (F.col("lo") + last).alias("last")).filter("first <= last")
    asked = stored(runs.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "first", "last")).alias("runs")))
    for used in (firsts, *sides.values()):
        discard(used)
    release(spark)

    windows = stored(asked.join(long, ["doc", "mark"]).select("doc", "mark", "runs", "text").mapInArrow(
        _windows(length), "gram long, whole long, doc long, mark long, lo int"))
    release(spark)
    several = _across(windows, ["gram", "whole"])
    single = stored(windows.join(several, ["gram", "whole"]).filter("doc > first_doc").select(
        "doc", "mark", F.col("lo").alias("first"), (F.col("lo") + length).alias("last")))
    discard(windows)
    discard(several)
    discard(asked)
    release(spark)
    return later.unionByName(single)


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    texts = _placed(docs)
    ranges = repeats(texts, length).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(ranges, ["doc", "mark"], "left").select("doc_id", "text", "runs")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words; texts of fewer than ``length`` words keep all. A null doc_id comes after all others. Rows that share a doc_id, or have
    none, are one document here: they do not remove each other's words. Texts of any length are read in pieces. Other
    columns are not read. An empty table gives an empty result.
    """
    return _with_runs(docs, length).mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) of each row of ``docs`` without the repeated words; the other words of such a text are joined by single spaces.

    Rows as in ``remove_repeats``; a text of which nothing goes stays as it is, null becomes empty.
    """
    return _with_runs(docs, length).mapInArrow(_cleaned, "doc_id long, text string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 48, 1))) AS i, words FROM d),
windows AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS doc FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE doc_id > doc),
spots AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN spots USING (doc_id)
"""
