"""Connected components of a graph of links: local union-find, and large and small stars between tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import cut, join_groups, prepare

#: Links that one task joins up; a graph of more is dealt to several.
TASK_LINKS = 500_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Joins each node's neighbours (larger ones, or those up to itself) to its least neighbour."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = cut(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n")), "least")
    near = join_groups(sides, least, ["u"], "_n", ["v"])
    out = near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def _locally(links: DataFrame) -> DataFrame:
    """Each task's links replaced by a star for each component that they make."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ends = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pd.DataFrame(ends, columns=["a", "b"], dtype="int64")

    return links.mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node of links (columns a, b; a != b) with the least node that it reaches.

    Nodes without a link have no row. Tasks of at most TASK_LINKS links each join up what they hold; if
    there are several, the stars that they leave are joined by alternating large and small stars, whose
    rounds grow with the logarithm of the longest path. Each round is written to the shared folder, so a
    lost executor costs one round at most.
    """
    prepare(links.sparkSession)
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    tasks = -(-now.count() // TASK_LINKS)
    if tasks <= 1:
        now = cut(_locally(now.coalesce(1)), "stars")
    else:
        now = cut(_locally(now.repartition(tasks, "b")), "stars")
        seen = None
        while True:
            now = cut(_star(_star(now, True), False), "star")
            state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if state == seen:
                break
            seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
