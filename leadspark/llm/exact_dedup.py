"""Exact de-duplication over a minimal perfect hash of known digests.

Texts are equal when they are identical without ASCII white space. The digest of a text is the
SHA-256 of what is left. The *history* is a table of distinct digests, each with its winner; here
it is made from the digests that occur more than once. It is cut into shards of about
``KEYS_PER_SHARD`` digests, and each shard gets a minimal perfect hash (hash and displace): a
small table of displacement seeds sends its n digests to the slots 0..n-1, one each. A slot holds the full
digest and the locator of the winner. A document finds its seed and then its slot by two
equi-joins and is a member only if all 32 bytes of the digest agree. Non-members are grouped
on their own.

Rows that repeat (same doc_id, same text) are counted together before anything else, so a text
that a third of the rows share moves as few rows as it has doc_ids; the joins have the form that adaptive
execution can split.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import keep_rows, stored, text_mark, whole_text

KEYS_PER_SHARD = 1024
BUCKETS = 256           # displacement seeds of a shard
PORTION = 1 << 16     # copies of one row written at a time
SEED_LIMIT = 1 << 24

_WHITE = r"[\x20\x09-\x0D]+"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_id, _mark, digest, n_chars, n): one row for each different (doc_id, text); n counts its repeats."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").alias("_id"), text_mark().alias("_mark"),
        F.unhex(F.sha2(F.encode(F.regexp_replace(text, _WHITE, ""), "UTF-8"), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    ).groupBy("_id", "_mark", "digest", "n_chars").agg(F.count("*").alias("n"))


def winners(prints: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_mark, group_size): the row with most code points wins, then the smallest doc_id.

    A null doc_id comes last; rows that agree in both are told apart by their mark.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("len"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"),
                          F.col("_mark").alias("mark")))
    return (prints.groupBy("digest").agg(best.alias("b"), F.sum("n").alias("group_size"))
            .select("digest", F.col("b.id").alias("keep_id"), F.col("b.mark").alias("keep_mark"), "group_size"))


def _seeded(base: int, seed: int) -> int:
    """Spark's xxhash64(digest, seed) from base = xxhash64(digest), signed."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), base & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def displace(bases: list[int]) -> tuple[dict[int, int], list[int]]:
    """Seeds per bucket and the slot of each key. Seed s >= 2 hashes again; seed -1-k means slot k itself."""
    n = len(bases)
    buckets: dict[int, list[int]] = {}
    for i, base in enumerate(bases):
        buckets.setdefault(_seeded(base, 1) % BUCKETS, []).append(i)
    taken, slot, seeds = [False] * n, [0] * n, {}
    free = iter(range(n))
    for bucket, members in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
        if len(members) == 1:
            k = next(f for f in free if not taken[f])
            taken[k], slot[members[0]], seeds[bucket] = True, k, -1 - k
            continue
        for seed in range(2, SEED_LIMIT):
            at = [_seeded(bases[i], seed) % n for i in members]
            if len(set(at)) == len(at) and not any(taken[k] for k in at):
                break
        else:
            raise ValueError("no displacement seed found")
        seeds[bucket] = seed
        for i, k in zip(members, at):
            taken[k], slot[i] = True, k
    return seeds, slot


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    seeds, slot = displace([int(b) for b in keys["base"]])
    n = len(keys)
    cells = keys.assign(at=slot, seed=0, n_slots=n, is_slot=True).drop(columns="base")
    moves = pd.DataFrame({"at": list(seeds), "seed": list(seeds.values())}).assign(
        shard=keys["shard"].iloc[0], n_slots=n, is_slot=False, digest=None, keep_id=None, keep_mark=None, group_size=None)
    return pd.concat([cells, moves[cells.columns]], ignore_index=True).astype(
        {"keep_id": "Int64", "keep_mark": "Int64", "group_size": "Int64"})


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """The slots and seeds of a history (digest, keep_id, keep_mark, group_size), and the number of shards."""
    shards = max(1, math.ceil(history.count() / KEYS_PER_SHARD))
    keyed = history.withColumn("base", F.xxhash64("digest")).withColumn("shard", F.pmod("base", F.lit(shards)).cast("int"))
    index = keyed.groupBy("shard").applyInPandas(
        _build, "digest binary, keep_id long, keep_mark long, group_size long, shard int, at int, seed int, n_slots int, is_slot boolean")
    return stored(index), shards


def look_up(prints: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``prints`` with keep_id, keep_mark, group_size and member; null and false where the digest is not in the index."""
    d = prints.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(BUCKETS)).cast("int"))
    seeds = index.filter("NOT is_slot").select("shard", F.col("at").alias("bucket"), "seed", "n_slots")
    slots = index.filter("is_slot").select("shard", F.col("at").alias("slot"), F.col("digest").alias("held"),
                                           "keep_id", "keep_mark", "group_size")
    slot = F.when(F.col("seed") < 0, -1 - F.col("seed")).otherwise(F.pmod(F.xxhash64("digest", "seed"), F.col("n_slots")).cast("int"))
    found = d.join(seeds, ["shard", "bucket"], "left").withColumn("slot", slot).join(slots, ["shard", "slot"], "left")
    sure = F.coalesce(F.col("held") == F.col("digest"), F.lit(False))
    return found.select(*prints.columns, *[F.when(sure, F.col(c)).alias(c) for c in ("keep_id", "keep_mark", "group_size")],
                        sure.alias("member"))


def resolve(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each different (doc_id, text) with its winner: _id, _mark, digest, n, keep_id, keep_mark, group_size, wins.

    Without ``history`` it is made of the digests of ``docs`` that occur more than once. A given history
    (from ``winners`` over older documents) outranks ``docs``: members never win.
    """
    prints = stored(fingerprints(docs))
    known = stored((history if history is not None else winners(prints).filter("group_size > 1"))
                   .select("digest", "keep_id", "keep_mark", "group_size"))
    found = look_up(prints, *build_index(known))
    own = (F.col("_id").eqNullSafe(F.col("keep_id"))) & (F.col("_mark") == F.col("keep_mark"))
    members = found.filter("member").withColumn("wins", own if history is None else F.lit(False))
    rest = found.filter("NOT member").drop("keep_id", "keep_mark", "group_size")
    rest = rest.join(winners(rest), "digest").withColumn("wins", own)
    return members.unionByName(rest).drop("member")


def exact_groups(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; all empty texts are one group. Of repeated rows (same doc_id and text)
    exactly one is kept. A null doc_id is a value of its own and comes last in ties. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = stored(resolve(docs, history).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("wins").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n"))
    # The other copies of a repeated row: portions of bounded size, spread over the tasks, then row by row.
    portions = rows.filter("n > 1").withColumn("portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 2) / PORTION))))
    spread = portions.repartition("doc_id", "text_sha256", "portion").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(PORTION), F.col("n") - 1 - F.col("portion") * PORTION))))
    return rows.drop("n").unionByName(spread.withColumn("kept", F.lit(False)).drop("n", "portion", "copy"))


def drop_copies(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    The winner is that of ``exact_groups``: null and empty texts are one group, and of repeated rows one stays. Texts of any length are
    compared whole. An empty table gives an empty result.
    """
    return keep_rows(docs, resolve(docs, history).filter("wins").select("_id", "_mark"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS rn,
             count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
