"""Clusters against plain loops, and the edge cases."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from leadspark.llm import centroids


def plain(rows, k, rounds, dimensions, scale=256, seed=2):
    kept = [(i, [max(-2**27, min(2**27, math.floor(scale * float(c)))) for c in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centres = [x for _, x in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in set(of):
            own = [x for (_, x), o in zip(kept, of) if o == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own)]
    best = assign()
    total = sum(d for d, _ in best)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, sum(e for e, o in best if o == j), total, marks[j]) for (i, _), (d, j) in zip(kept, best)), key=str)


def found(spark, rows, **how):
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, key int, cluster string")
    return sorted(map(tuple, centroids.clusters(vectors, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_contract_on_the_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    assert found(spark, rows) == plain(rows, 40, 5, 64)


@pytest.mark.parametrize("shape", [(5, 3, 2), (7, 9, 4), (3, 0, 3), (4, 1, 1)])
def test_lumpy_vectors(spark, shape):
    """Clumps, ties, repeated rows, one very common vector and extremes."""
    k, rounds, d = shape
    rng = np.random.default_rng(k)
    clumps = rng.normal(size=(k, d))
    rows = [(int(i), (clumps[i % k] + rng.normal(size=d) * 0.05).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, [0.5] * d) for i in range(100)] + [(7, [1.0 / 256] * d)] * 3 + [(None, [0.25] * d)] * 2
    rows += [(2000, None), (2001, []), (2002, [None] * d), (2003, [float("nan")] * d), (2004, [float("inf")] * d), (2005, [0.0] * (d + 1)), (2006, [1e30] * d)]
    assert found(spark, rows, k=k, rounds=rounds, dimensions=d) == plain(rows, k, rounds, d)


def test_fewer_rows_than_centroids(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])]
    assert found(spark, rows, dimensions=2) == plain(rows, 40, 5, 2)
    assert found(spark, [], dimensions=2) == []


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 6)) * 300).astype(np.int64)
    c = np.floor(rng.normal(size=(9, 6)) * 300).astype(np.int64)
    grid = centroids.Grid(x.min(axis=0), x.max(axis=0), x.mean(axis=0), x.std(axis=0))
    cells = grid.cells(x)
    assert (grid.low[np.arange(6), cells] <= x).all() and (x <= grid.high[np.arange(6), cells]).all()
    import pyarrow as pa
    packed = pa.array(centroids.pack_cells(cells), pa.binary())
    assert (centroids.unpack_cells(packed, 6) == cells).all()
    bounds = sum(grid.tables(c)[j, cells[:, j]] for j in range(6))
    exact = centroids.distances(x, c)
    assert (bounds[:, :9] <= exact).all() and (exact <= bounds[:, 9:]).all()
    can = centroids.possible(cells, grid.tables(c))
    assert can[np.arange(500), exact.argmin(axis=1)].all() and can.mean() < 0.7
