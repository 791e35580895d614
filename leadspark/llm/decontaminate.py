"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over a window of tokens: positions marked 1 are hashed, the others may be anything. Hashes of all
windows of the test items are put into a sorted table, hashes of all windows of each document are joined to it, and every
hit fixes one alignment of the document with an item. Around the hit the alignment is extended token by token; it counts
when a stretch of at least ``LEAST`` tokens agrees in at least ``SIMILARITY`` of its positions and starts and ends with equal tokens. An item
of fewer tokens is compared as a whole, its ends included. Substituted tokens are tolerated, in the seed's gaps and in the stretch.

The masks reach every such stretch at the default similarity: with a fifth of at least 13 tokens substituted, four equal tokens in a row are left,
or (15 tokens, three substitutions) four runs of three. Items of 5, 6 and 10 tokens have masks of their own. A test enumerates the patterns.

Test sets are small next to a corpus, but nothing relies on it: the items are cut into blocks of about
``BLOCK_BYTES`` of text, whole items each, and one block after the other is collected, sent to the tasks and used up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.llm.common import discard, fresh, stored, whole_text

MASKS = ("111111", "11011011", "1110100111", "1111011110", "1111", "1110111")   # Fixed values
SHORT_MASKS = {5: ("111", "11011"), 6: ("11011",), 10: ("111011",)}     # further ones for items of so many tokens
LEAST = 13
SIMILARITY = 0.8
BLOCK_BYTES = 16 << 20
FILTER_BITS = 22
KNOWN_WORDS = 1 << 18   # words whose id a task keeps
PAIRS = 1 << 21     # pairs of tokens compared at a time

#: ASCII letters lower-cased, digits kept, other ASCII to spaces; bytes of other characters stay.
_TOKEN_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_GAP = 0x9E3779B97F4A7C15       # stands between documents, never equal to a token by more than chance


class _Ids(dict):
    """64-bit ids of tokens."""

    def __missing__(self, token: bytes) -> int:
        value = xxhash.xxh64_intdigest(token)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[token] = value
        return value


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TOKEN_BYTES).split()


def _seeds(ids: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of each window of ``ids`` under a mask."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, number + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, one in enumerate(mask):
            if one == "1":
                out = (out ^ ids[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
                out ^= out >> np.uint64(32)
    return out


class Table:
    """The seeds of the test items, sorted by hash, behind a bit filter."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        own = _Ids()
        self.names, self.items = [], []
        for name, text in items:
            ids = np.array([own[t] for t in tokens(text)], dtype=np.uint64)
            if len(ids):
                self.names.append(name)
                self.items.append(ids)
        shortest = min(map(len, masks))
        # An item too short for any mask is looked up as a whole.
        lengths = sorted({len(i) for i in self.items})
        own_masks = [("1" * n, n) for n in lengths if n < shortest] + [(m, n) for n in lengths if n >= shortest for m in SHORT_MASKS.get(n, ())]
        self.masks = list(masks) + [m for m, _ in own_masks]
        only = [0] * len(masks) + [n for _, n in own_masks]
        self.sizes = np.array([len(i) for i in self.items], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.concatenate(self.items or [np.zeros(0, dtype=np.uint64)])
        self.tables = []
        for number, mask in enumerate(self.masks):
            of = [(k, _seeds(ids, mask, number)) for k, ids in enumerate(self.items) if only[number] in (0, len(ids))]
            hashes = np.concatenate([h for _, h in of] or [np.zeros(0, dtype=np.uint64)])
            item = np.concatenate([np.full(len(h), k) for k, h in of] or [np.zeros(0, dtype=np.int64)])
            at = np.concatenate([np.arange(len(h)) for _, h in of] or [np.zeros(0, dtype=np.int64)])
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((hashes[order], item[order], at[order], bits))

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Different (item, diagonal) pairs that a seed joins; diagonal = position in ``ids`` of the item's first token."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for number, mask in enumerate(self.masks):
            hashes, item, at, bits = self.tables[number]
            own = _seeds(ids, mask, number)
            where = np.flatnonzero(bits[own >> np.uint64(64 - FILTER_BITS)])
            if not len(where) or not len(hashes):
                continue
            lo, hi = np.searchsorted(hashes, own[where], "left"), np.searchsorted(hashes, own[where], "right")
            n = hi - lo
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found.append(np.stack([item[rows], np.repeat(where, n) - at[rows]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def enough(self, ids: np.ndarray, hits: np.ndarray, least: int, similarity: float = SIMILARITY) -> np.ndarray:
        """The hits with as many equal tokens over the whole item as the shortest stretch needs; others cannot count."""
        out = [np.zeros((0, 2), dtype=np.int64)]
        ends = np.cumsum(self.sizes[hits[:, 0]])
        at = 0
        while at < len(hits):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            part = hits[at:to]
            n = self.sizes[part[:, 0]]
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first, n)
            place = np.repeat(part[:, 1], n) + k
            inside = (place >= 0) & (place < len(ids))
            same = inside & (ids[np.where(inside, place, 0)] == self.joined[np.repeat(self.starts[part[:, 0]], n) + k])
            out.append(part[np.add.reduceat(same.astype(np.int64), first) >= similarity * np.minimum(least, n) - 1e-9])
            at = to
        return np.concatenate(out)

    def equal(self, ids: np.ndarray, item: int, diagonal: int) -> int:
        """Equal tokens of an alignment over the whole item; what lies outside ``ids`` differs."""
        want = self.items[item]
        lo, hi = max(0, -diagonal), min(len(want), len(ids) - diagonal)
        return int((want[lo:hi] == ids[diagonal + lo:diagonal + hi]).sum()) if lo < hi else 0

    def agreed(self, ids: np.ndarray, item: int, diagonal: int, least: int, similarity: float = SIMILARITY) -> int:
        """Tokens of the stretch for which an alignment counts; 0 if it does not."""
        size = len(self.items[item])
        if size < least:
            return size if self.equal(ids, item, diagonal) >= similarity * size - 1e-9 else 0
        n = self.stretch(ids, item, diagonal, similarity)[1]
        return n if n >= least else 0

    def stretch(self, ids: np.ndarray, item: int, diagonal: int, similarity: float = SIMILARITY) -> tuple[int, int]:
        """(first position, tokens) of the longest stretch of an alignment with the asked share of equal tokens."""
        want = self.items[item]
        lo, hi = max(0, -diagonal), min(len(want), len(ids) - diagonal)
        if lo >= hi:
            return 0, 0
        same = np.flatnonzero(want[lo:hi] == ids[diagonal + lo:diagonal + hi])
        if not len(same):
            return 0, 0
        # Over the equal positions p_i: the longest i..j with j - i + 1 >= similarity * (p_j - p_i + 1).
        score = np.arange(len(same)) - similarity * same
        best = np.maximum.accumulate(score[::-1])[::-1]
        j = i = 0
        longest = (0, 0)
        for i in range(len(same)):
            need = score[i] - 1 + similarity - 1e-9
            j = max(j, i)
            while j + 1 < len(same) and best[j + 1] >= need:
                j += 1
            if score[j] >= need and same[j] - same[i] + 1 > longest[1]:
                longest = (int(same[i]), int(same[j] - same[i] + 1))
        return diagonal + lo + longest[0], longest[1]


def _mapper(items: list[tuple[int, str]], masks: tuple[str, ...], least: int, similarity: float, names: list[str]):
    """Arrow mapper: the columns as they come, with the findings added. The text is the last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = Table(items, masks), _Ids()
        width = max(map(len, table.masks))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            parts, starts, at = [], [], 0
            gap = np.full(width, _GAP, dtype=np.uint64)
            for text in texts:
                words = tokens(text.as_py() or "")
                ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                starts.append(at)
                parts += [ids, gap]
                at += len(ids) + width
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            found: list[dict[int, int]] = [{} for _ in range(batch.num_rows)]
            begin = np.array(starts, dtype=np.int64)
            lengths = np.diff(np.append(begin, at)) - width
            for item, diagonal in table.enough(ids, table.hits(ids), least, similarity).tolist():
                # The hit lies inside the document in which the aligned item ends last but starts before.
                for doc in range(max(0, int(np.searchsorted(begin, diagonal, "right")) - 1), batch.num_rows):
                    if begin[doc] >= diagonal + len(table.items[item]):
                        break
                    own = ids[begin[doc]:begin[doc] + lengths[doc]]
                    n = table.agreed(own, item, diagonal - int(begin[doc]), least, similarity)
                    if n:
                        found[doc][table.names[item]] = max(n, found[doc].get(table.names[item], 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([sorted(f) for f in found], pa.list_(pa.int64())),
                 pa.array([max(f.values(), default=0) for f in found], pa.int32())],
                [*batch.schema.names, *names])
    return run


def _blocks(tests: DataFrame) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of test items, and the blocks one after the other. Items without text or id are left out."""
    items = stored(tests.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([(r["item_id"], r["text"]) for r in items.filter(part == k).collect()] for k in range(n))


def _found(docs: DataFrame, items: list[tuple[int, str]], masks, least, similarity) -> tuple[DataFrame, str, str]:
    """``docs`` with the findings added, and the names of their two columns."""
    text, names = fresh(docs, "_text")[0], fresh(docs, "_items", "_longest")
    wide = docs.withColumn(text, whole_text())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in wide.schema]).add(names[0], T.ArrayType(T.LongType())).add(names[1], T.IntegerType())
    return wide.mapInArrow(_mapper(items, masks, least, similarity, names), schema), *names


def contamination(docs: DataFrame, tests: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST,
                  similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, contaminated, item_ids (ascending), longest (tokens of the longest stretch).

    A null or empty text is never contaminated; test items without text or id are ignored; without any item
    nothing is contaminated. Repeated rows and null ids keep their own rows. Repeated items count once. Other columns are not read.
    """
    n, blocks = _blocks(tests)
    report = ["doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_items").alias("item_ids"), F.col("_longest").alias("longest")]
    if n == 1:
        return _found(docs.select("doc_id", "text"), next(blocks), masks, least, similarity)[0].select(*report)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"))      # stored, so numbers stay as they are
    parts = [stored(_found(rows.select("_row", "text"), block, masks, least, similarity)[0].select("_row", "_items", "_longest").filter("_longest > 0"))
             for block in blocks]
    every = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"), F.max("_longest").alias("_longest"))
    none = F.array().cast("array<bigint>")
    return rows.join(every, "_row", "left").select("doc_id", F.coalesce("_items", none).alias("_items"), F.coalesce("_longest", F.lit(0)).alias("_longest")).select(*report)


def drop_contaminated(docs: DataFrame, tests: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST,
                      similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the contaminated rows, all columns unchanged. One pass for each block of test items.

    Rows with a null or empty text stay, and so does everything where there are no test items. Repeated rows and null ids are judged
    row by row, texts are read whole. An empty table gives an empty result.
    """
    n, blocks = _blocks(tests)
    out = docs
    for k, block in enumerate(blocks):
        marked, items, _ = _found(out, block, masks, least, similarity)
        before, out = out, marked.filter(F.size(items) == 0).select(*docs.columns)
        if n > 1:
            out = stored(out)
            if k:
                discard(before)
    return out
