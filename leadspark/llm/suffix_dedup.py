"""Removal of repeated byte strings by prefix doubling over sparse suffixes.

A byte goes when a string of ``LENGTH`` = 100 bytes that covers it also starts earlier (smaller doc_id, or earlier in the same document).
The rank of a suffix is a 64-bit value that equal prefixes share. Ranks of 32 bytes come from five doublings inside a task; from there
on Spark sorts positions by pairs of ranks at growing offsets (32 -> 64 -> 100 bytes), and what is unique leaves:

1. *Sparse suffixes.* Of the 69 ranks of 32 bytes in a window of 100 bytes the smallest is its anchor. Equal windows have
   equal anchors. About one position in 35 is an anchor, and the windows of one anchor form a segment.
2. *64 bytes.* A window holds the 64 bytes after its anchor or the 64 bytes that end with it. Pairs of ranks at offset 32 are
   ranked over all documents, and windows whose pair occurs once leave before anything else is sent.
3. *Whole segments.* Segments with the same bytes hold the same windows: all but the first segment are covered, and only first
   segments go on. Among these the pairs are ranked again.
4. *100 bytes.* What is left is ranked window by window by pairs at offset 36; all but the first of equal windows are covered.

Pairs that occur once are most of all, so the second scan asks a bit table of fixed size whether a pair can repeat; its false
hits only travel on to step 3 and leave there. On a corpus for which the table is too small the result is the same.
Two windows around one anchor count as equal by a 64-bit rank of their 100 bytes besides half of the anchor's rank: different ones
do with probability 2^-64. No group is gathered: each step is a partial aggregation and a join back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, release, stored, text_mark, whole_text

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
CHUNK = 1 << 21             # most bytes of one text ranked at a time
BLOCK = 1 << 18             # bytes of several texts ranked together
TABLE_BITS = 27             # the bit table has 2^27 bits, 16 MB
LAST = (1 << 63) - 1        # stands for a null doc_id: it comes last

_BYTES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """The rank of a pair of ranks."""
    with np.errstate(over="ignore"):
        out = a * _ODD[level % 5] + b
        out ^= out >> np.uint64(29 + level % 3)
        return out


def _mixed(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a ^ (a >> np.uint64(32))) * _ODD[3]


def ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of all prefixes of GRAM bytes, by doubling."""
    h = _BYTES[data]
    for level in range(5):
        step = 1 << level
        h = _pair(h[:-step], h[step:], level)
    return _mixed(h)


class Block:
    """Pieces of several texts side by side, so that one array operation serves many short texts.

    ``row`` and ``start`` tell the text of a piece in its batch and where the piece begins there; ``begin`` and ``end`` where it lies in the block.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.row, self.start = (np.array([p[k] for p in pieces], dtype=np.int64) for k in range(2))
        self.end = np.cumsum([len(p[2]) for p in pieces])
        self.begin = self.end - np.array([len(p[2]) for p in pieces], dtype=np.int64)
        self.ranks = ranks(np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first window, last window, piece) of each segment; windows do not cross pieces."""
        h = self.ranks
        least, reach = h, 1
        while 2 * reach <= WINDOW:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:len(h) - WINDOW + 1], least[WINDOW - reach:])
        change = np.zeros(len(least) + 1, dtype=np.int8)
        change[self.begin] += 1
        change[self.end - LENGTH + 1] -= 1
        inside = np.cumsum(change[:-1]) > 0
        new = least[1:] != least[:-1]
        new |= ~inside[:-1]
        lo = np.flatnonzero(inside & np.concatenate(([True], new)))
        piece = np.searchsorted(self.begin, lo, "right") - 1
        hi = np.minimum(np.append(lo[1:], len(least)) - 1, self.end[piece] - LENGTH)
        parts = []
        while len(lo):      # a rank may repeat inside its run: the run goes on behind its first anchor
            at = lo + np.lib.stride_tricks.sliding_window_view(h, WINDOW)[lo].argmin(axis=1)
            parts.append((at, lo, np.minimum(hi, at), piece))
            more = hi > at
            lo, hi, piece = at[more] + 1, hi[more], piece[more]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def place(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Positions in the texts."""
        return at - self.begin[piece] + self.start[piece]


def _blocks(texts: pa.Array) -> Iterator[Block]:
    """The texts of a batch in blocks; a text above ``CHUNK`` comes in pieces that hold each of its windows once."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        data = text.as_buffer().to_pybytes()
        for start in range(0, len(data) - LENGTH + 1, CHUNK):
            pieces.append((row, start, data[start:start + CHUNK + LENGTH - 1]))
            size += len(pieces[-1][2])
            if size >= BLOCK:
                yield Block(pieces)
                pieces, size = [], 0
    if pieces:
        yield Block(pieces)


def _sides(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(after, has after, around, has around): ranks of the 64 bytes from the anchor on and of those that end with it, where a window holds them."""
    after = _mixed(_pair(h[at], h[np.minimum(at + GRAM, len(h) - 1)], 0))
    around = _mixed(_pair(h[np.maximum(at - GRAM, 0)], h[at], 1))
    return after, at - hi <= LENGTH - 2 * GRAM, around, at - lo >= GRAM


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper from texts to the ranks of 64 bytes at their anchors."""
    for batch in batches:
        for block in _blocks(batch.column(0)):
            at, lo, hi, _ = block.anchors()
            after, some_after, around, some_around = _sides(block.ranks, at, lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([after[some_after], around[some_around]]).view(np.int64))], ["gram"])


def bit_table(ranks_: DataFrame) -> np.ndarray:
    """A bit for each value of the column ``gram``; at most 2^TABLE_BITS / 64 rows come to the driver, whatever the corpus."""
    word = F.shiftrightunsigned("gram", 64 - TABLE_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - TABLE_BITS}) & 63 as int))")
    got = ranks_.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def _marked(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit set."""
    bit = values >> np.uint64(64 - TABLE_BITS)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def _short(rank: np.ndarray) -> np.ndarray:
    return (rank >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SEGMENT = "gram int, seg long, after int, around int, doc long, mark long, lo int, at int, hi int"


def _segments(table):
    """Arrow mapper from (doc, mark, text) to segments without the windows that cannot repeat; ``at`` and ``hi`` count from ``lo``.

    ``after`` and ``around`` only rule windows out, and ``gram`` only backs the 64 bits of ``seg``: half a rank is enough.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        for batch in batches:
            for block in _blocks(batch.column(2)):
                h = block.ranks
                at, lo, hi, piece = block.anchors()
                after, some_after, around, some_around = _sides(h, at, lo, hi)
                # A window d bytes before its anchor holds the 64 bytes after the anchor if d <= 36, those around it if d >= 32.
                lo = np.where(some_around & ~_marked(words, around), np.maximum(lo, at - GRAM + 1), lo)
                hi = np.where(some_after & ~_marked(words, after), np.minimum(hi, at - (LENGTH - 2 * GRAM) - 1), hi)
                keep = lo <= hi
                at, lo, hi, piece, after, around = (x[keep] for x in (at, lo, hi, piece, after, around))
                end = hi + LENGTH - GRAM
                seg = h[lo] ^ ((hi - lo) * 1000 + (at - lo)).astype(np.uint64)
                for level, step in enumerate((32, 64, 96, 128, 160)):
                    seg = _pair(seg, h[np.minimum(lo + step, end)], level)
                row = pa.array(block.row[piece])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_short(h[at])), pa.array(_mixed(seg).view(np.int64)), pa.array(_short(after), mask=at - hi > LENGTH - 2 * GRAM),
                     pa.array(_short(around), mask=at - lo < GRAM), batch.column(0).take(row), batch.column(1).take(row),
                     *[pa.array(c.astype(np.int32)) for c in (block.place(lo, piece), at - lo, hi - lo)]],
                    ["gram", "seg", "after", "around", "doc", "mark", "lo", "at", "hi"])
    return run


def _asked(table):
    """Arrow mapper over (doc, mark, text, tag): the documents that can have windows to look at, without the tag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        for batch in batches:
            yield batch.filter(pa.array(_marked(words, batch.column(3).to_numpy().view(np.uint64)))).select([0, 1, 2])
    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper from (doc, mark, runs, text) to (gram, whole, doc, mark, lo): ranks of 100 bytes of the asked windows."""
    for batch in batches:
        offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
        grams, firsts, lasts = (batch.column(2).values.field(k).to_numpy().astype(t) for k, t in enumerate((np.int32, np.int64, np.int64)))
        for block in _blocks(batch.column(3)):
            # the runs of each piece's text, cut to the piece
            n_runs = offsets[block.row + 1] - offsets[block.row]
            piece = np.repeat(np.arange(len(block.row)), n_runs)
            run = np.repeat(offsets[block.row] - np.cumsum(n_runs) + n_runs, n_runs) + np.arange(n_runs.sum())
            lo = np.maximum(firsts[run], block.start[piece]) - block.start[piece] + block.begin[piece]
            hi = np.minimum(lasts[run] - block.start[piece] + block.begin[piece], block.end[piece] - LENGTH)
            n = np.maximum(hi - lo + 1, 0)
            p = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            h, of = block.ranks, np.repeat(piece, n)
            whole = _mixed(_pair(_pair(h[p], h[p + 32], 2), _pair(h[p + 36], h[p + 68], 2), 3))
            row = pa.array(block.row[of])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(grams[run], n)), pa.array(whole.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row),
                 pa.array(block.place(p, of).astype(np.int32))], ["gram", "whole", "doc", "mark", "lo"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper from (doc_id, text, runs) to the report; runs are byte ranges that go."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, runs in zip(batch.column(1), batch.column(2)):
            data = text.as_buffer().to_pybytes()
            removed = spans = 0
            digest = hashlib.sha256()
            if runs.is_valid and len(runs.values):
                first, last = (runs.values.field(k).to_numpy() for k in range(2))
                change = np.bincount(first, minlength=len(data) + 1) - np.bincount(last, minlength=len(data) + 1)
                gone = np.cumsum(change[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                digest.update(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes())
            else:
                digest.update(data)
            for column, value in zip(out, (len(data), removed, spans, digest.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _placed(docs: DataFrame) -> DataFrame:
    """doc, mark, text of each row. ``doc`` and ``mark`` order the documents; the mark is only needed where doc_id repeats or is null."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    mark = F.lit(0).cast("long") if odd.isEmpty() else text_mark()
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), mark.alias("mark"), whole_text().alias("text"))


def repeats(texts: DataFrame) -> DataFrame:
    """(doc, mark, first, last): byte ranges that go, as they are found; they overlap.

    Each step is stored, so that files of the steps before it can go.
    """
    spark = texts.sparkSession
    long = texts.filter(F.octet_length("text") >= LENGTH).select("doc", "mark", "text")
    share = spark.sparkContext.broadcast
    twice = long.select("text").mapInArrow(_pairs, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    segments = stored(long.mapInArrow(_segments(share(bit_table(twice))), _SEGMENT))
    release(spark)

    place = F.min(F.struct("doc", "mark", "lo", "at", "hi", "after", "around")).alias("first")
    firsts = stored(segments.groupBy("gram", "seg").agg(place, F.count("*").alias("n")).select("gram", "seg", "first.*", "n"))
    release(spark)
    start = firsts.filter("n > 1").select("gram", "seg", F.struct("doc", "mark", "lo").alias("start"))
    later = stored(segments.select("gram", "seg", "doc", "mark", "lo", "hi").join(start, ["gram", "seg"]).filter(
        F.struct("doc", "mark", "lo") != F.col("start")).select("doc", "mark", F.col("lo").alias("first"), (F.col("lo") + F.col("hi") + LENGTH).alias("last")))
    discard(segments)
    release(spark)

    # Counts are stored, so that a join with them reads two plain exchanges, which adaptive execution can split where a key is hot.
    sides = {rank: stored(firsts.filter(F.col(rank).isNotNull()).groupBy("gram", rank).agg(F.count("*").alias("n")).filter("n > 1").select(
        "gram", rank, F.lit(True).alias(f"{rank}_again"))) for rank in ("after", "around")}
    left = firsts.drop("seg", "n")
    for rank, several in sides.items():
        left = left.join(several, ["gram", rank], "left")
    # A window d bytes before its anchor holds the 64 bytes after the anchor if d <= 36, those around it if d >= 32.
    farthest = F.when(F.col("around_again").isNull(), F.greatest(F.lit(0), F.col("at") - 31)).otherwise(0)
    nearest = F.when(F.col("after_again").isNull(), F.least(F.col("hi"), F.col("at") - 37)).otherwise(F.col("hi"))
    runs = left.filter("after_again IS NOT NULL OR around_again IS NOT NULL").select(
        "doc", "mark", "gram", (F.col("lo") + farthest).alias("first"), (F.col("lo") + nearest).alias("last")).filter("first <= last")
    asked = stored(runs.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "first", "last")).alias("runs")))
    for used in (firsts, *sides.values()):
        discard(used)
    release(spark)
    tag = F.xxhash64("doc", "mark")
    few = long.withColumn("tag", tag).mapInArrow(_asked(share(bit_table(asked.select(tag.alias("gram"))))), "doc long, mark long, text string")
    windows = asked.join(few, ["doc", "mark"]).select("doc", "mark", "runs", "text").mapInArrow(
        _windows, "gram int, whole long, doc long, mark long, lo int")
    windows = stored(windows)
    discard(asked)
    release(spark)
    spot = F.struct("doc", "mark", "lo")
    several = stored(windows.groupBy("gram", "whole").agg(F.min(spot).alias("start"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    single = stored(windows.join(several, ["gram", "whole"]).filter(spot != F.col("start")).select(
        "doc", "mark", F.col("lo").alias("first"), (F.col("lo") + LENGTH).alias("last")))
    discard(windows)
    discard(several)
    release(spark)
    return later.unionByName(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty; texts under 100 bytes keep all bytes. A null doc_id comes after all others. Rows that repeat (same doc_id and
    text) stand at one place and do not remove each other; rows that share only the doc_id are ordered by a hash of their text.
    Other columns are not read. An empty table gives an empty result.
    """
    texts = _placed(docs)
    ranges = repeats(texts).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(ranges, ["doc", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
