"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """a, m: the least of a and its neighbours. Partial sums keep hubs from gathering in one task."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return materialize(least, "cc-least", few=True)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the least node of the component.

    Each round links larger neighbours to a node's least neighbour, then smaller neighbours likewise, and
    stops when the edges no longer change. Every round is written to the shared folder, so a lost
    executor costs the running round only. No edges give no rows.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", few=True)
    mark = _mark(now)
    for _ in range(ROUNDS):
        both = _both(now)
        large = both.join(_least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = small.join(_least(small), "a").select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a <> b").distinct(), "cc", few=True)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
