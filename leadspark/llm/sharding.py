"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Documents with equal texts form a group with a vector (bytes, tokens, rows). Each group goes as a whole to the shard
where the dot product of its vector with the shard's residual capacity is highest, largest first. Only a group that is more
than a whole shard in bytes, tokens or rows cannot stay together; it is dealt in parts of ``1/SPLIT`` of a shard.

Placing is sequential, so it must not see every group. A unit above ``1/FINE`` of a shard in any of the three is placed on
its own; by arithmetic there are at most 3 x shards x FINE of these. All smaller ones are put together into lots by size class and hash; a lot
has an exact summed vector and is placed like a group. The driver sees only units, a number that does not depend on the
corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import numbered, stored, whole_text

SHARDS = 40
OVERHEAD = 16
SPLIT = 64      # a group above a whole shard, by its largest share, is dealt in parts of 1/SPLIT of a shard
WEIGHTS = np.array([8.0, 1.0, 1.0])     # of bytes, tokens and rows in the dot product
FINE = 1000     # units above 1/FINE of a shard, by their largest share, are placed one by one
LOTS = 256      # lots for each size class of the small ones


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, key: what placing needs of each row. ``key`` stands for the text."""
    text = whole_text()
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.xxhash64(text).alias("key"))


def choose(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit: largest first, to the highest dot product with the residual capacity.

    Capacities are equal shares of the totals, so each dimension counts by its share, and bytes, for which the law holds, by ``WEIGHTS`` more.
    Shards that the unit still fits into come first; where it fits into none, the one with most bytes left takes it.
    """
    total = np.maximum(vectors.sum(axis=0), 1)
    share = vectors / total * shards
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -share.sum(axis=1))):
        fits = (residual >= share[i]).all(axis=1)
        score = np.where(fits, residual @ (share[i] * WEIGHTS), -1e9) if fits.any() else residual[:, 0]
        out[i] = best = int(np.argmax(score))
        residual[best] -= share[i]
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard for each row of ``docs``.

    Null and empty texts are one group of rows with the overhead alone as size. Repeated rows stay together like other
    equal texts and are each placed. A null doc_id stays null. Other columns are not read. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = stored(measured(docs))
    vector = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = rows.agg(*vector).first()
    # The part of a shard that a vector fills, in the dimension where that is most.
    share = F.greatest(*[F.col(c) / F.lit(max(1.0, (totals[c] or 0) / shards)) for c in ("bytes", "tokens", "rows")])
    group = ["key", "size", "text_crc32"]
    # Groups above a shard: fewer than 3 x shards.
    large = rows.groupBy(*group).agg(*vector).filter(share > 1).select(
        *group, F.least(F.ceil(share * SPLIT), F.col("rows")).alias("parts"))
    parted = rows.join(F.broadcast(large), group, "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    unit = F.when(share * FINE > 1, F.concat_ws(":", F.lit("u"), *group, "part")).otherwise(
        F.concat_ws(":", F.lit("lot"), F.floor(F.log2("bytes")), F.pmod(F.xxhash64(*group, "part"), F.lit(LOTS))))
    units = parted.groupBy(*group, "part").agg(*vector).withColumn("unit", unit)
    # At most 3 x shards x FINE units of their own, and LOTS lots for each power of two of a size.
    summed = units.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")]).orderBy("unit").collect()
    chosen = choose(np.array([[r["bytes"], r["tokens"], r["rows"]] for r in summed], dtype=float).reshape(-1, 3), shards)
    table = spark.createDataFrame([(r["unit"], int(s)) for r, s in zip(summed, chosen)], "unit string, shard int")
    placed = units.select(*group, "part", "unit").join(F.broadcast(table), "unit").drop("unit")
    return parted.join(placed, [*group, "part"]).select("doc_id", "size", "text_crc32", "shard")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each row with its shard under the law of equal bytes and its slot there (0, 1, ... without gaps)."""
    return numbered(assign(docs, shards), ["shard"], ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
