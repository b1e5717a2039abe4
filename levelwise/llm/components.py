"""Connected components of an edge table, without gathering any vertex's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelwise.llm.common import stored

#: Alternating rounds end after O(log^2 n) steps; this is only a guard against a fault.
MAX_ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with ``m``, the least of u and all v of u.

    The least is aggregated map-side and joined back, so a hub vertex is neither
    gathered nor left to one task: adaptive execution splits its side of the join.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours greater than u move to the least neighbour of u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its lesser neighbours move to the least of them. Edges have u > v."""
    pairs = _with_least(edges)
    moved = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        pairs.select("u", F.col("m").alias("v"))
    )
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges: equal when nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``root``, the least vertex of its component, from edges ``a``, ``b``.

    Vertices without an edge to another do not appear. Repeated edges, loops and edges with a null end
    are allowed and change nothing. Every round is written to the shared folder.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    kept = edges.where("a is not null and b is not null and a <> b")
    now = stored(kept.select(high, low).distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS if mark[0] else 0):
        now = stored(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )
