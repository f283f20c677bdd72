"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """node, root: the least node of its component, for every node of edges (a long, b long); self-loops count as nodes.

    A step links each node's neighbours to the least of them; only minima are gathered by node, never lists, so a hub costs no more than its edges.
    Each step is written to folder. It ends when a step changes nothing."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = C.staged(pairs, folder, "pairs-0")
    summary = None
    for i in range(1, rounds + 1):
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: every node with smaller neighbours links them, and itself, to the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = C.staged(small, folder, f"pairs-{i}")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if i > 1:
            C.drop(edges.sparkSession, f"{folder}/pairs-{i - 2}")
        if now == summary:
            break
        summary = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} steps")
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(pairs.select("b", "b").distinct())
