"""SimHash near-duplicates by pigeonhole blocks.

Each text gets a 64-bit fingerprint over its word shingles. Two fingerprints that differ in at most ``DISTANCE`` = 3 bits agree in at
least 3 of ``BLOCKS`` = 6 blocks, so each distinct fingerprint is keyed by all 20 choices of 3 blocks (about 32 bits
each), and only fingerprints with the same key are compared. Keys with more than ``BUCKET`` fingerprints are split further in the same way:
the free bits are cut into 4 blocks, of which one must agree, until the bucket is small or no free bits are left to cut.

A bucket yields a spanning set of its links, never all pairs. Components are found over fingerprints and carried to
the documents, so exact copies and hot groups weigh as one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import keep_rows, stored, text_mark, whole_text
from leadspark.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
BUCKET = 8192       # most fingerprints compared with each other in one piece
SMALL = 16          # up to this bucket size links are found for all buckets at once
CHUNK = 1 << 16     # shingles whose bits are counted at a time


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    k = words_per_shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else iter([b" ".join(words)])
    n = max(1, len(words) - k + 1)
    digest, ones = partial(xxhash.xxh64_digest, seed=SEED), np.zeros(64, dtype=np.int64)
    for start in range(0, n, CHUNK):
        hashes = b"".join(digest(s) for _, s in zip(range(min(CHUNK, n - start)), shingles))
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp for each row."""
    return docs.select("doc_id", text_mark().alias("mark"), whole_text().alias("text")).mapInArrow(
        _prints, "doc_id long, mark long, fp long")


def _cut_bits(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit numbers."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks() -> list[int]:
    """Masks of all choices of BLOCKS - DISTANCE blocks."""
    blocks = _cut_bits(list(range(64)), BLOCKS)
    return [_signed(sum(c)) for c in combinations(blocks, BLOCKS - DISTANCE)]


def _finer(masks: list[int]) -> list[tuple[int, int, int]]:
    """(mask number, part, mask) where each mask is widened by one of DISTANCE + 1 parts of its free bits."""
    out = []
    for i, mask in enumerate(masks):
        free = [b for b in range(64) if not mask >> b & 1]
        if len(free) > 12:
            out += [(i, p, _signed((mask | part) & (1 << 64) - 1)) for p, part in enumerate(_cut_bits(free, DISTANCE + 1))]
    return out


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked within one bucket: for each fingerprint but the roots one link towards its root."""
    n = len(fps)
    parent, seen = [], np.zeros(n, dtype=bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(~seen & (np.bitwise_count(fps ^ fps[i]) <= DISTANCE))
            seen[new] = True
            parent += [(i, int(j)) for j in new]
            front += new.tolist()
    return parent


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow mapper over rows (mask, key, fp) in key order: links (a, b) within each key."""
    def of(table: pa.Table) -> pa.RecordBatch:
        mask, key = table.column("mask").to_numpy(), table.column("key").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1]))))
        sizes = np.diff(np.append(first, len(fps)))
        start, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, SMALL):
            i = np.flatnonzero((size <= SMALL) & (np.arange(len(fps)) - start >= lag))
            i = i[np.bitwise_count(fps[i] ^ fps[i - lag]) <= DISTANCE]
            left.append(i - lag)
            right.append(i)
        for at, n in zip(first[sizes > SMALL], sizes[sizes > SMALL]):
            pairs = np.array(_spanning(fps[at:at + n]), dtype=np.int64).reshape(-1, 2) + at
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
        a, b = (fps.view(np.int64)[np.concatenate(x)] for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= 1 << 18:     # all but the last, unfinished key
            table = pa.Table.from_batches(held).combine_chunks()
            mask, key = table.column("mask").to_numpy(), table.column("key").to_numpy()
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield of(table.slice(0, done))
                held = table.slice(done).to_batches()
                rows = table.num_rows - done
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield of(pa.Table.from_batches(held).combine_chunks())


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints (fp) that are linked directly or over others."""
    masks = block_masks()
    done: DataFrame | None = None
    rows = prints.select(F.col("fp"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    while True:
        large = stored(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("mask", "key"))
        finer = _finer(masks)
        if large.isEmpty() or not finer:
            small = rows
        else:
            small = rows.join(large, ["mask", "key"], "left_anti")
        dealt = small.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "mask", "key")
        found = dealt.sortWithinPartitions("mask", "key", "fp").select("mask", "key", "fp").mapInArrow(_links, "a long, b long")
        done = found if done is None else done.unionByName(found)
        if small is rows:
            return done.distinct()
        wider: dict[int, list[int]] = {}
        for n, (i, _, _) in enumerate(finer):
            wider.setdefault(i, []).append(n)
        table = F.create_map(*[x for i, ns in wider.items() for x in (F.lit(i), F.array(*[F.lit(n) for n in ns]))])
        new_masks = F.array(*[F.lit(m) for _, _, m in finer])
        hot = rows.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        rows = stored(hot.select("fp", "mask", F.col("fp").bitwiseAND(F.get(new_masks, F.col("mask"))).alias("key")))
        masks = [m & (1 << 64) - 1 for _, _, m in finer]


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, keep_id, keep_mark for each row; keep_* is the first row (smallest doc_id, null last) of its component."""
    prints = stored(fingerprints(docs))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark")))
    distinct = stored(prints.groupBy("fp").agg(best.alias("best")))
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keep = rooted.groupBy("root").agg(F.min("best").alias("keep"))
    of = rooted.select("fp", "root").join(keep, "root").select("fp", F.col("keep.id").alias("keep_id"), F.col("keep.mark").alias("keep_mark"))
    return prints.join(of, "fp")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component).

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows share their component. A null doc_id
    comes last: component_id is null only where every doc_id of the component is. Other columns are not read. An empty table gives an
    empty result.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keep_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged."""
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    return keep_rows(docs, grouped(docs).filter(own).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")))
