"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that the join reads two plain exchanges, which adaptive execution can split at a hub.
    least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    out = stored(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    discard(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")))
    others = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored(others.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the smallest node of its component.

    Ends when a round changes nothing; rounds grow with the logarithm of the size of the largest component. Only counts come to the
    driver. Hubs are pre-aggregated, and their rows are joined in the form that adaptive execution splits.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    while True:
        large = _large(now)
        then, now = now, _small(large)
        discard(then)
        discard(large)
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (new["n"], new["h"]):
            break
        mark = (new["n"], new["h"])
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
