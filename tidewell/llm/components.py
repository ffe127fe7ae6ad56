"""Connected components of an edge table: large-star and small-star rounds in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours move to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node, and its neighbours, all smaller, move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most, to a node that has none: stars, which no round changes."""
    several = edges.groupBy("a").count().where("count > 1").select("a")
    chained = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return several.unionByName(chained.select(F.col("b").alias("a"))).isEmpty()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """From edges(a long, b long): (id, component) for every id in them, component being the smallest id reachable.

    Least neighbours are partial aggregates. The join that brings them back sees a node's edges in one task, as plain
    rows that stream by and are never held together. A round halves long paths, so few are needed; if ``rounds`` don't
    suffice the function raises rather than return something else.
    """
    real = edges.where("a is not null and b is not null and a <> b")
    now = scratch.write(real.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for k in range(rounds):
        if _settled(now):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        moved = scratch.write(_large(now), f"large{k}")
        now = scratch.write(_small(moved), f"small{k}")
        scratch.drop(f"large{k}", f"small{k - 1}" if k else "edges")
    raise RuntimeError(f"components not found in {rounds} rounds")


def roots(pairs: list[tuple[int, int]], n: int) -> list[int]:
    """Union-find over 0 .. n-1 within a task: the smallest number of each one's set."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
