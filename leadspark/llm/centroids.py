"""Centroid clustering over a VA-file: vectors compressed to a few bits for each dimension, full vectors only where that does not decide.

Vectors become integers, so all sums and distances are exact. The VA-file holds for each vector the number of the cell of each component (4
bits, cut at values that follow each dimension's mean and spread; the outer cells end at its least and greatest value). In each round a
table of the least and the greatest squared difference of each centroid to each cell of each dimension is
looked up and added over the dimensions: that bounds the distance of a vector to every centroid. Centroids whose interval
begins behind the least upper bound are out. If one is left, the vector is assigned without having been read; the others are fetched
by a join, and only the centroids left are compared exactly. Sums of clusters follow the vectors that
move, so a vector that stays where it was is not read either.

Centroids (k x d numbers) are all that comes to the driver or is sent to tasks, besides the tables made from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, release, stored

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
BITS = 4                    # bits of a cell number
LIMIT = 1 << 27             # integers are kept within +-LIMIT, so that distances fit 64 bits
BLOCK = 1 << 11             # vectors looked up at a time

_CELLS = 1 << BITS
_EDGES = np.array([NormalDist().inv_cdf(i / _CELLS) for i in range(1, _CELLS)])
_ASSIGNED = "key long, cells binary, cluster int, sums array<long>"


def integers(vector: str, dimensions: int, scale: int) -> Column:
    """floor(scale * x) of each component as double; null unless there are ``dimensions`` finite components."""
    x = F.col(vector)
    good = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(good, F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * scale)))).cast("array<int>"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


class Grid:
    """Cell borders of each dimension, all integers: cell c of dimension j holds low[j, c] <= x <= high[j, c]."""

    def __init__(self, least: np.ndarray, greatest: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        inner = np.clip(np.floor(mean[:, None] + spread[:, None] * _EDGES), least[:, None], greatest[:, None]).astype(np.int64)
        self.inner = inner                                      # the last value of each cell but the outermost
        self.low = np.concatenate([least[:, None], inner + 1], axis=1)
        self.high = np.concatenate([inner, greatest[:, None]], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edges, x[:, j], side="left") for j, edges in enumerate(self.inner)], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(d, cells, 2k): least and greatest squared difference of a component in a cell to each centroid."""
        low, high, c = self.low[:, :, None], self.high[:, :, None], centroids.T[:, None, :]
        near = np.maximum(0, np.maximum(low - c, c - high))
        far = np.maximum(np.abs(low - c), np.abs(high - c))
        return np.concatenate([near * near, far * far], axis=2).astype(np.float64)


def pack_cells(cells: np.ndarray) -> list[bytes]:
    """Two cell numbers to a byte."""
    if cells.shape[1] % 2:
        cells = np.pad(cells, ((0, 0), (0, 1)))
    return [row.tobytes() for row in (cells[:, ::2] << 4 | cells[:, 1::2])]


def unpack_cells(column: pa.Array, dimensions: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, (dimensions + 1) // 2)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), -1)[:, :dimensions]


def possible(cells: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(n, k): which centroids can be nearest, by the intervals of their distances."""
    k = tables.shape[2] // 2
    out = np.zeros((len(cells), k), dtype=bool)
    for at in range(0, len(cells), BLOCK):
        part = cells[at:at + BLOCK]
        bounds = np.zeros((len(part), 2 * k))
        for j in range(part.shape[1]):
            bounds += tables[j, part[:, j]]
        # Bounds are sums of integers below 2^56; the margin covers their rounding.
        out[at:at + BLOCK] = bounds[:, :k] * (1 - 1e-13) <= (bounds[:, k:].min(axis=1) * (1 + 1e-13))[:, None]
    return out


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k)."""
    reach = max(1, int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * reach * reach * x.shape[1] < 1 << 53:        # all sums are exact as floats
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    for c, centre in enumerate(centroids):
        out[:, c] = ((x - centre) ** 2).sum(axis=1)
    return out


def nearest(x: np.ndarray, candidates: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each vector's candidates (ties: the smaller number) and the squared distance."""
    d = np.where(candidates, distances(x, centroids), np.iinfo(np.int64).max)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


class _Sums:
    """Counts and sums of the clusters, as far as a task has seen vectors come and go."""

    def __init__(self, k: int, dimensions: int):
        self.total = np.zeros((k, dimensions + 1), dtype=np.int64)

    def move(self, x: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        rows = np.concatenate([np.ones((len(x), 1), dtype=np.int64), x], axis=1)
        np.add.at(self.total, new, rows)
        np.subtract.at(self.total, old[old >= 0], rows[old >= 0])

    def rows(self) -> pa.RecordBatch:
        """Rows without a key: cluster and sums."""
        k = np.flatnonzero(self.total.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.binary()), pa.array(k, pa.int32()), pa.array(list(self.total[k]), pa.list_(pa.int64()))],
            ["key", "cells", "cluster", "sums"])


def _compress(grid: Grid, dimensions: int):
    """Arrow mapper from (key, vec_id, x) to the same with cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pack_cells(grid.cells(_matrix(batch.column(2), dimensions)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], ["key", "vec_id", "x", "cells"])
    return run


def _bounded(tables: np.ndarray, k: int, dimensions: int):
    """Arrow mapper from (key, cells, old) to the same with the cluster, null where intervals overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            can = possible(unpack_cells(batch.column(1), dimensions), tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(can.argmax(axis=1).astype(np.int32), mask=can.sum(axis=1) != 1)],
                                             ["key", "cells", "old", "cluster"])
    return run


def _decided(tables: np.ndarray, centroids: np.ndarray):
    """Arrow mapper from (key, cells, old, x) to assigned rows; a task ends with the sums of what it has moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        sums = _Sums(k, dimensions)
        for batch in batches:
            x = _matrix(batch.column(3), dimensions)
            new, _ = nearest(x, possible(unpack_cells(batch.column(1), dimensions), tables), centroids)
            old = batch.column(2).fill_null(-1).to_numpy()
            moved = old != new
            sums.move(x[moved], old[moved], new[moved])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.int32()), pa.nulls(len(new), pa.list_(pa.int64()))],
                                             ["key", "cells", "cluster", "sums"])
        yield sums.rows()
    return run


def _final(tables: np.ndarray, centroids: np.ndarray):
    """Arrow mapper from (vec_id, cells, x) to (vec_id, cluster, distance)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), centroids.shape[1])
            cluster, distance = nearest(x, possible(unpack_cells(batch.column(1), centroids.shape[1]), tables), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])
    return run


def _grid(full: DataFrame, dimensions: int) -> Grid:
    """Cell borders from exact extremes and from mean and spread of each dimension; d rows come to the driver."""
    each = full.select(F.posexplode("x").alias("j", "c"))
    got = {r["j"]: r for r in each.groupBy("j").agg(F.min("c").alias("least"), F.max("c").alias("greatest"), F.avg("c").alias("mean"),
                                                  F.stddev_pop("c").alias("spread")).collect()}
    column = lambda name: np.array([got[j][name] for j in range(dimensions)])
    return Grid(column("least"), column("greatest"), column("mean"), column("spread"))


def _moved(assigned: DataFrame, sums: list[list[int]]) -> list[list[int]]:
    """Counts and sums of the clusters after what the tasks of a round have moved; k x (d + 1) numbers come to the driver."""
    parts = assigned.filter("key IS NULL").select("cluster", F.posexplode("sums").alias("j", "s"))
    out = [list(row) for row in sums]
    for r in parts.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["cluster"]][r["j"]] += int(r["s"])
    return out


def first_centroids(full: DataFrame, k: int, seed: int) -> np.ndarray:
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = full.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()       # k rows
    return np.array([r["x"] for r in rows], dtype=np.int64)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors`` has vec_id and embedding. Vectors that are null, of another length, or with null or non-finite components are left out. Rows that
    repeat count as often as they occur; a null vec_id is allowed, it counts as empty where the first centroids are chosen, and equal
    vec_ids are ordered by their vectors there. With fewer vectors than ``k`` each starts a cluster. Integers beyond +-2^27 are set to that.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    raw = stored(vectors.select("vec_id", integers("embedding", dimensions, scale).alias("x")).filter("x IS NOT NULL")
                 .select(F.monotonically_increasing_id().alias("key"), "vec_id", "x"))       # stored at once, so keys stay as they are
    if raw.isEmpty():
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    grid = _grid(raw, dimensions)
    id_type = dict(vectors.dtypes)["vec_id"]
    full = stored(raw.mapInArrow(_compress(grid, dimensions), f"key long, vec_id {id_type}, x array<int>, cells binary"))
    discard(raw)
    centroids = first_centroids(full, k, seed)
    k = len(centroids)
    sums = [[0] * (dimensions + 1) for _ in range(k)]
    assigned = None
    for _ in range(rounds):
        tables = grid.tables(centroids)
        if assigned is None:
            now = stored(full.select("key", "cells", F.lit(None).cast("int").alias("old"), "x").mapInArrow(_decided(tables, centroids), _ASSIGNED))
        else:
            bounded = stored(assigned.filter("key IS NOT NULL").select("key", "cells", F.col("cluster").alias("old")).mapInArrow(
                _bounded(tables, k, dimensions), "key long, cells binary, old int, cluster int"))
            fetched = bounded.filter("cluster IS NULL OR cluster <> old").select("key", "cells", "old").join(full.select("key", "x"), "key")
            settled = bounded.filter("cluster = old").select("key", "cells", "cluster", F.lit(None).cast("array<long>").alias("sums"))
            now = stored(fetched.select("key", "cells", "old", "x").mapInArrow(_decided(tables, centroids), _ASSIGNED).unionByName(settled))
            discard(bounded)
            discard(assigned)
        assigned, sums = now, _moved(now, sums)
        centroids = np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(sums, centroids.tolist())], dtype=np.int64)
        release(spark)
    if assigned is not None:
        discard(assigned)
    final = stored(full.select("vec_id", "cells", "x").mapInArrow(_final(grid.tables(centroids), centroids), f"vec_id {id_type}, cluster int, distance long"))
    discard(full)
    marks = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())],
                                  "cluster int, centroid_sha256 string")
    of_cluster = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))                 # k rows
    total = of_cluster.agg(F.sum("cluster_inertia").alias("inertia"))
    small = of_cluster.join(F.broadcast(marks), "cluster").join(F.broadcast(total))
    return final.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The contract as plain SQL: every distance in every round."""
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), q) - 1 AS cluster, q AS m FROM v QUALIFY cluster < {k})"""]
    distance = "list_sum(list_transform(list_zip(q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, q, min(struct_pack(distance := CAST({distance} AS BIGINT), cluster := cluster)) AS best FROM v, c{r} GROUP BY vec_id, q)""")
        if r < rounds:
            parts.append(f"""
u{r} AS (SELECT best.cluster AS cluster, unnest(q) AS x, unnest(range({dimensions})) AS j FROM a{r}),
s{r} AS (SELECT cluster, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM u{r} GROUP BY cluster, j),
n{r} AS (SELECT cluster, list(x ORDER BY j) AS m FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN n{r} USING (cluster))""")
    return f"""WITH {','.join(parts)}
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, best.distance AS distance,
  CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = a{rounds}.best.cluster"""
