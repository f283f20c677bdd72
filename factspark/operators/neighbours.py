"""A graph of near neighbours for tables too large to compare all pairs: neighbour descent over edge tables.

TREES times, every vector falls into a cell by the signs of its products with random directions, and the vectors of a cell (of at most CELL rows; larger ones are cut
by a hash) are compared; that gives each its first DEGREE neighbours. Then each node's neighbours, and as many that have it as a neighbour, are compared with each
other: a neighbour's neighbour is likely one too. A node sends its vector once along each of its edges, so a round moves rows in proportion to the table, whatever
is a neighbour of whom. Rounds end when fewer than SETTLED of all edges change.

The neighbours are approximate: ask `retrieval.nearest` for exact ones. Vectors that `retrieval.usable` leaves out take no part; equal vectors are one node, of which the
least ids stand for all, since ties go to them. Vectors of unlike length are never compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import removed, shared_folder, written
from .retrieval import ranked, usable

DEGREE, TREES, CELL, ROUNDS, SETTLED = 24, 4, 512, 12, 0.002
EDGES = "a long, b long, distance double"


def directions(d: int, tree: int, bits: int) -> np.ndarray:
    return np.random.default_rng([d, tree]).normal(size=(d, bits))


def cells_of(bits: int, trees: int):
    """The kernel that adds each vector's cell in every tree: the signs of its products with random directions, each direction through the origin."""

    def kernel(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            v, size = batch.column("v"), batch.column("v").value_lengths().to_numpy()
            cells = np.zeros((rows, trees), np.int64)
            flat, end = v.flatten().to_numpy(), np.cumsum(size)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = flat[(end[at] - d)[:, None] + np.arange(d)]
                for t in range(trees):
                    cells[at, t] = (x @ directions(d, t, bits) >= 0) @ (1 << np.arange(bits))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * trees), pa.array(cells.reshape(-1)))
            yield pa.record_batch([batch.column("node"), v, lists], ["node", "v", "cells"])

    return kernel


def pairs_within(node: np.ndarray, x: np.ndarray, degree: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, squared distance) of each row's nearest others in a small block; of those only that are nearer than the row's limit."""
    square = (x * x).sum(axis=1)
    gap = np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T)
    gap[node[:, None] == node[None, :]] = np.inf
    if limit is not None:
        gap[gap >= limit[:, None]] = np.inf
    keep = min(degree, len(node) - 1)
    if keep <= 0:
        return node[:0], node[:0], square[:0]
    near = np.argpartition(gap, keep - 1, axis=1)[:, :keep]
    found = np.take_along_axis(gap, near, axis=1)
    i, k = np.nonzero(np.isfinite(found))
    return node[i], node[near[i, k]], found[i, k]


def compare(degree: int):
    """The kernel that compares all rows of a group (node, v, and, if there is, limit)."""

    def kernel(t: pa.Table) -> pa.Table:
        node, first = np.unique(t["node"].to_numpy(), return_index=True)
        x = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)[first]
        limit = t["limit"].to_numpy()[first] if "limit" in t.column_names else None
        return pa.table([pa.array(c) for c in pairs_within(node, x, degree, limit)], ["a", "b", "distance"])

    return kernel


def best(edges: DataFrame, degree: int) -> DataFrame:
    """The first edges of each node."""
    order = W.partitionBy("a").orderBy("distance", "b")
    one = edges.groupBy("a", "b").agg(F.min("distance").alias("distance"))
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= degree)


def graph(nodes: DataFrame, folder: str, degree: int = DEGREE, trees: int = TREES, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """a, b, distance (squared), place: about the nearest others of each node (node, v), nearest first."""
    n = nodes.count()
    bits = min(40, max(0, int(np.ceil(np.log2(max(1, n / (cell / 2)))))))
    placed = nodes.mapInArrow(cells_of(bits, trees), "node long, v array<double>, cells array<long>").select("node", "v", F.posexplode("cells").alias("tree", "cell"))
    parts = written(placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")), f"{folder}/cells")
    placed = placed.join(parts, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    edges = written(best(placed.select("tree", "cell", "part", "node", "v", F.size("v").alias("d")).groupBy("tree", "cell", "part", "d").applyInArrow(compare(degree), EDGES), degree), f"{folder}/edges-0")
    for i in range(1, rounds + 1):
        limits = edges.groupBy("a").agg(F.when(F.count("*") >= degree, F.max("distance")).otherwise(float("inf")).alias("limit"))
        # a node's neighbours, some that have it as one (the nearest of a crowd), and itself
        back = edges.select(F.col("b").alias("at"), F.col("a").alias("node"), "distance").withColumn("place", F.row_number().over(W.partitionBy("at").orderBy("distance", "node"))).where(F.col("place") <= degree)
        met = edges.select(F.col("a").alias("at"), F.col("b").alias("node")).union(back.select("at", "node")).union(edges.select(F.col("a").alias("at"), F.col("a").alias("node"))).distinct()
        sent = met.join(nodes.join(limits.withColumnRenamed("a", "node"), "node", "left").select("node", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit")), "node")
        new = sent.groupBy("at").applyInArrow(compare(degree), EDGES)
        now = written(best(edges.select("a", "b", "distance").union(new), degree), f"{folder}/edges-{i}")
        changed, total = now.join(edges, ["a", "b"], "left_anti").count(), now.count()
        removed(nodes.sparkSession, f"{folder}/edges-{i - 1}")
        edges = now
        if changed <= SETTLED * total:
            break
    return edges


def near_graph(vectors: DataFrame, queries: DataFrame, k: int, drop_self: bool = False, folder: str | None = None, degree: int = DEGREE) -> DataFrame:
    """Like `retrieval.nearest`, approximately: query_id, id, distance, rank. Ids of queries and vectors are of one kind, so a query whose id a vector has is that vector's row.

    The graph is over both; a query's neighbours that are vectors are its results, so degree should exceed k by as many queries as may crowd around one."""
    folder = folder or shared_folder(vectors.sparkSession, "neighbours")
    rows = usable(vectors, "id").withColumn("q", F.lit(False)).union(usable(queries, "query_id").withColumn("q", F.lit(True)))
    node = F.xxhash64("v")
    asked = written(rows.where("q").select(node.alias("node"), "id").distinct(), f"{folder}/asked")
    # ids of one vector: only the first k + 1 can be results, so equal ones are cut to those before they are gathered
    first = rows.where("not q").select("id", "v").distinct().withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    kept = rows.where("q").select("v", F.lit(None).cast("long").alias("id")).distinct().union(first.select("v", "id"))
    nodes = kept.groupBy("v").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids")).select(node.alias("node"), "v", "ids")
    nodes = written(nodes, f"{folder}/nodes")
    edges = graph(nodes.select("node", "v"), folder, max(degree, k)).select("a", "b", "distance")
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("distance"))
    found = edges.union(own).join(nodes.select(F.col("node").alias("b"), F.explode("ids").alias("id")), "b").join(asked.select(F.col("node").alias("a"), F.col("id").alias("query_id")), "a")
    if drop_self:
        found = found.where("query_id <> id")
    return ranked(found.select("query_id", "id", F.round("distance", 6).alias("distance")), "distance", "id", k)
