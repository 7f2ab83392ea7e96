"""Connected components by alternating stars: no component, and no node's links, ever meet in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import collected, dropped, spread_join, stored

MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the smallest node that links reach. links: pairs of numbers, any order.

    A large-star round ties each node's larger neighbours to its smallest neighbour; a small-star round ties its smaller
    ones to it. Both keep the components; when neither changes a link, each component is one star around its smallest node.
    The links of a node with a large part of all links are dealt over many tasks.
    Each round's links are written in the shared folder. Cases: no links give no rows; loops and repeated links don't matter.
    """
    now = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v").distinct()
    now = stored(now, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        # (links, sums of their ends) is equal over rounds only once nothing changes: the ends only ever get smaller
        state = now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least, ["u"], 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], state[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, stored(small, "links")
        dropped(last)
        collected(now.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(centres)


def spanning(n: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of links between 0..n-1 at most n - 1 that keep their components: (least member, other)."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(root(i), i) for i in range(n) if root(i) != i]
