"""Near copies among embeddings: a robust-pruned graph, built on overlapping shards and searched with an expanding range.

Equal vectors are one node. Centres are learned on a bounded sample; each node is a member of the shards of its OVERLAP nearest centres, and at home in the
nearest. A shard with more than SHARD_ROWS nodes at home is cut by a hash of the node. In each shard every node's POOL of nearest and of random members is pruned
robustly (a candidate goes if a kept one is ALPHA times nearer to it than the node is), with the way back of each edge; the lists of a node's shards are
united, and a shard's part of that graph are the united lists among its members.

Every node is a query, and goes to each shard where a partner may be at home: if y is at home with centre c, and x's nearest centre is c*, then |x - y| <= R
asks |x - c|^2 - |x - c*|^2 <= 2 R |c - c*|. Of R only the part along c - c* matters, which for a difference in any direction of d dimensions is R / sqrt(d) in the mean
square: SPREAD times that is allowed for, so up to SPREAD^2 dimensions no pair is lost between shards, and beyond them one in a thousand of those at the very threshold, which the audit sees. There the search walks greedily from the medoid (and from
the query itself, where it is a member) with a beam, then opens every node found within the threshold less SLACK until nothing new comes. What is found is verified by the
cosine of the original vectors in double precision, and counted where it is at home, so a partner counts once. Only counts and one edge for each
node leave a task, never all pairs of a group.

The audit compares AUDIT queries with all nodes, in every task's blocks; while fewer than RECALL of their partners were found, the search runs again with
twice the beam, slack and spread, RUNS times at most; the last recall is written to folder/audit and an operator whose recall stays below LEAST raises.

Vectors that are null, zero, hold null or non-finite components, or are of another length than most (of equally many, the shorter), link with nothing: no links, a
component of their own. Rows with null or repeated ids are vectors of their own; a component is named by its least id that is not null, and kept is vec_id = component_id (true
for a null id without links, false for one with links). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ann import matrix, usable
from .graph import components

THRESHOLD = 0.95
#: Nodes at home in a shard, shards of a node, edges of a node in a shard, candidates of a node (nearest, random).
SHARD_ROWS, OVERLAP, DEGREE, POOL, ALPHA = 4096, 2, 24, (40, 24), 1.2
#: Each node's so many nearest kept edges always lead back to it, so that no member of a crowd is left without a way in.
WAYS_BACK = 4
#: Open nodes that a walk keeps, how far below the threshold the range is opened, deviations allowed for between shards, queries that one task searches together.
BEAM, SLACK, SPREAD, QUERY_ROWS, LOCKSTEP = 12, 0.1, 3.0, 16384, 256
#: Centres are learned on so many rows for each, and on SAMPLE at most; so there are SAMPLE / PER_CENTRE centres at most.
PER_CENTRE, SAMPLE, ROUNDS = 40, 200_000, 8
AUDIT, RECALL, LEAST, RUNS = 200, 0.999, 0.9, 3


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_centres(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n centres of unit vectors by Lloyd's rounds; one that loses all its rows starts again at the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near, gap = nearest_centres(sample, centres, 1)
        near, far = near[:, 0], np.argsort(-gap[:, 0])
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        empty = np.flatnonzero(size == 0)
        centres = total / np.maximum(size, 1)[:, None]
        centres[empty] = sample[far[: len(empty)]]
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T)


def nearest_centres(x: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centres of each row, nearest first, and their squared distances."""
    near, gap = [np.zeros((0, k), np.int64)], [np.zeros((0, k))]
    for at in range(0, len(x), 4096):
        d = distances(x[at : at + 4096], centres)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        near.append(order)
        gap.append(np.take_along_axis(d, order, axis=1))
    return np.concatenate(near), np.concatenate(gap)


def shards_to_visit(x: np.ndarray, centres: np.ndarray, radius: float) -> np.ndarray:
    """Which centres may be nearest to a row within the radius of each row."""
    d = distances(x, centres)
    best = d.argmin(axis=1)
    apart = np.sqrt(distances(centres, centres))[best]
    return d - d[np.arange(len(x)), best][:, None] <= 2 * radius * apart + 1e-6


# ---------------------------------------------------------------- graph


def robust_prune(x: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Of each node's pool (-1: none) the edges kept, -1 behind them."""
    inside = (pool >= 0) & (pool != node[:, None])
    some = np.where(inside, pool, 0)
    near = np.einsum("npd,nd->np", x[some], x[node])
    apart = np.sqrt(np.maximum(0, 2 - 2 * near))
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(x[some], x[some].transpose(0, 2, 1))))
    alive, out, row = inside, np.full((len(node), degree), -1, np.int64), np.arange(len(node))
    for k in range(degree):
        pick = np.where(alive, apart, np.inf).argmin(axis=1)
        has = alive[row, pick]
        if not has.any():
            break
        out[has, k] = some[row, pick][has]
        alive = alive & (alpha * between[row, pick] > apart)
        alive[row, pick] = False
    return out


def build(x: np.ndarray, seed: int, degree: int = DEGREE, pool: tuple[int, int] = POOL) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the graph over unit vectors x as (from, to), sorted."""
    n, rng = len(x), np.random.default_rng(seed)
    near = min(pool[0], n - 1)
    first = np.full((n, degree), -1, np.int64)
    for at in range(0, n if near > 0 else 0, 512):
        node = np.arange(at, min(n, at + 512))
        s = x[node] @ x.T
        s[np.arange(len(node)), node] = -2
        best = np.argpartition(-s, near - 1, axis=1)[:, :near]
        first[node] = robust_prune(x, node, np.hstack([best, rng.integers(0, n, (len(node), pool[1]))]), degree)
    a, k = np.nonzero(first >= 0)
    b = first[a, k]
    # every edge and its way back; of a crowd as many as a pool has, at random
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    mixed = rng.permutation(len(a))
    a, b = a[mixed], b[mixed]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    place, width = np.arange(len(a)) - np.searchsorted(a, a), sum(pool)
    some = place < width
    wide = np.full((n, width), -1, np.int64)
    wide[a[some], place[some]] = b[some]
    out = np.full((n, degree), -1, np.int64)
    for at in range(0, n, 512):
        node = np.arange(at, min(n, at + 512))
        out[node] = robust_prune(x, node, wide[node], degree)
    near, kept = first[:, :WAYS_BACK], out >= 0
    back = near >= 0
    key = np.unique(np.concatenate([np.nonzero(kept)[0] * n + out[kept], near[back] * n + np.nonzero(back)[0]]))
    return key // n, key % n


class Shard:
    """The members of a shard, unit vectors x, with their part of the united graph: edges row-to, sorted by row."""

    def __init__(self, x: np.ndarray, row: np.ndarray, to: np.ndarray, home: np.ndarray):
        self.x, self.to, self.home = x.astype(np.float32), to, home
        self.begin = np.searchsorted(row, np.arange(len(x)))
        self.size = np.bincount(row, minlength=len(x))
        middle = x.mean(axis=0)
        self.medoid = int((x @ middle).argmax())

    def next(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into node, row) of all edges of some rows."""
        which, place = C.spread(self.begin[node], self.size[node])
        return which, self.to[place]

    def near(self, queries: np.ndarray, own: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows found whose cosine is reach or more; own: the query's row, or -1."""
        q, n = queries.astype(np.float32), len(self.x)
        m, row = len(q), np.arange(len(queries))
        seen, opened = np.zeros((m, n), bool), np.zeros((m, n), bool)
        score = np.full((m, n), -2, np.float32)
        asks = np.concatenate([row, row[own >= 0]])
        start = np.concatenate([np.full(m, self.medoid), own[own >= 0]])
        score[asks, start] = np.einsum("ij,ij->i", q[asks], self.x[start])
        seen[asks, start] = True
        held = np.full((m, beam), -1)
        held[:, 0] = self.medoid
        if beam > 1:
            held[:, 1] = np.where(own != self.medoid, own, -1)
        busy = row
        while len(busy):
            # the best open node of each walk's beam
            at = held[busy]
            s = np.where((at >= 0) & ~opened[busy[:, None], at], score[busy[:, None], at], -3)
            k = s.argmax(axis=1)
            going = s[np.arange(len(busy)), k] > -3
            busy, node = busy[going], at[np.arange(len(at)), k][going]
            if not len(busy):
                break
            opened[busy, node] = True
            i, to = self.next(node)
            fresh = ~seen[busy[i], to]
            i, to = i[fresh], to[fresh]
            asks = busy[i]
            score[asks, to] = np.einsum("ij,ij->i", q[asks], self.x[to])
            seen[asks, to] = True
            place = np.arange(len(i)) - np.searchsorted(i, i)
            wide = np.full((len(busy), beam + int(place.max(initial=-1)) + 1), -1)
            wide[:, :beam] = held[busy]
            wide[i, beam + place] = to
            s = np.where(wide >= 0, score[busy[:, None], wide], -3)
            held[busy] = np.take_along_axis(wide, np.argpartition(-s, beam - 1, axis=1)[:, :beam], axis=1)
        # open everything within reach until nothing new comes
        asks, to = np.nonzero((score >= reach) & ~opened)
        while len(asks):
            opened[asks, to] = True
            i, to = self.next(to)
            key = asks[i] * n + to
            key = np.unique(key[~seen.reshape(-1)[key]])
            asks, to = key // n, key % n
            s = np.concatenate([np.einsum("ij,ij->i", q[asks[a : a + 65536]], self.x[to[a : a + 65536]]) for a in range(0, len(asks), 65536)] or [np.zeros(0, np.float32)])
            score[asks, to] = s
            seen[asks, to] = True
            asks, to = asks[s >= reach], to[s >= reach]
        return np.nonzero(score >= reach)


def cosines(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of original vectors in double precision."""
    out = [np.zeros(0)]
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    for at in range(0, len(a), 65536):
        i, j = a[at : at + 65536], b[at : at + 65536]
        out.append((x[i] * y[j]).sum(axis=1) / (nx[i] * ny[j]))
    return np.concatenate(out)


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least that links a-b connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            return root


# ---------------------------------------------------------------- Spark


def nodes_of(vectors: DataFrame, folder: str, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows with a digest of their vector, null where it takes no part; distinct vectors as nodes; their length)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(v), v).alias("v"))
    size = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = size[0].d if size else 0

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), d)
            x = x + 0.0  # one zero, not two
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array([hashlib.blake2b(r.tobytes(), digest_size=20).digest() for r in x], pa.binary())], ["vec_id", "v", "digest"])

    good = rows.where(F.size("v") == d).mapInArrow(name, "vec_id long, v array<double>, digest binary")
    nodes = good.groupBy("digest").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = C.staged(nodes.withColumn("node", F.monotonically_increasing_id()), folder, "nodes", compression="zstd")
    odd = rows.where("v is null").select("vec_id").unionByName(rows.where(F.size("v") != d).select("vec_id"))
    return good.select("vec_id", "digest").unionByName(odd.select("vec_id", F.lit(None).cast("binary").alias("digest"))), nodes, d


def in_parts(node: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts).cast("int")


def members_of(nodes: DataFrame, centres: np.ndarray, d: int, folder: str, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(cell, part, home, node, v) of each node in its nearest centres' shards, and cell, parts."""
    overlap = min(OVERLAP, len(centres))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, _ = nearest_centres(unit(matrix(b.column("v"), d)), centres, overlap)
            yield pa.record_batch([b.column("node"), C.lists(near.reshape(-1), np.arange(len(near) + 1) * overlap, pa.int32())], ["node", "cells"])

    placed = C.staged(nodes.select("node", "v").mapInArrow(kernel, "node long, cells array<int>"), folder, "cells")
    at_home = placed.groupBy(F.col("cells")[0].alias("cell")).count()
    parts = C.staged(at_home.select("cell", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts")), folder, "parts")
    each = placed.select("node", F.posexplode("cells").alias("i", "cell")).join(F.broadcast(parts), "cell")  # a row for each centre
    each = each.select("cell", in_parts(F.col("node"), F.col("parts")).alias("part"), (F.col("i") == 0).alias("home"), "node")
    return C.staged(each.join(nodes.select("node", "v", "copies"), "node"), folder, "members", compression="zstd"), parts


def graph_of(members: DataFrame, d: int, folder: str, degree: int) -> DataFrame:
    """members with edges: the united lists of a node's shards."""

    def kernel(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        order = np.argsort(node)
        x = unit(matrix(t["v"].combine_chunks(), d)[order]).astype(np.float32)
        row, to = build(x, int(t["cell"][0].as_py()), degree)
        return pa.table([pa.array(node[order]), C.lists(node[order][to], np.searchsorted(row, np.arange(len(node) + 1)), pa.int64())], ["node", "edges"])

    built = members.groupBy("cell", "part").applyInArrow(C.tidied_group(kernel), "node long, edges array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))  # a list for each shard of the node
    return C.staged(members.join(united, "node"), folder, "graph", compression="zstd")


def searched(nodes: DataFrame, graph: DataFrame, parts: DataFrame, centres: np.ndarray, d: int, threshold: float, beam: int, slack: float, spread: float) -> DataFrame:
    """node, found (copies of other nodes linked with it, where that is counted), least (a node that its task has linked it with)."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) * min(1.0, spread / math.sqrt(d))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column("v"), d))
            for at in range(0, b.num_rows, 1024):
                row, cell = np.nonzero(shards_to_visit(x[at : at + 1024], centres, radius))
                part = b.slice(at, 1024).take(pa.array(row))
                yield pa.record_batch([pa.array(cell, pa.int32()), part.column("node"), part.column("v")], ["cell", "node", "v"])

    routed = nodes.select("node", "v").mapInArrow(route, "cell int, node long, v array<double>")
    blocks = routed.groupBy("cell").count().join(F.broadcast(parts), "cell").select("cell", "parts", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks")).collect()
    sizes = F.broadcast(nodes.sparkSession.createDataFrame([tuple(r) for r in blocks], "cell int, parts int, blocks int"))  # a row for each centre
    asked = routed.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.hash("node"), F.col("blocks")).alias("block"), "node", "v")
    held = graph.join(sizes.select("cell", "blocks"), "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "v", "home", "copies", "edges")

    def kernel(asks: pa.Table, has: pa.Table) -> pa.Table:
        if not asks.num_rows or not has.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, ["node", "found", "least"])
        order = np.argsort(has["node"].to_numpy())
        has = has.take(pa.array(order)).combine_chunks()
        node, base, copies, home = has["node"].to_numpy(), matrix(has["v"].combine_chunks(), d), has["copies"].to_numpy(), has["home"].to_numpy(zero_copy_only=False)
        lists = has["edges"].combine_chunks()
        row, to = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(node, to), len(node) - 1)
        row, place = row[node[place] == to], place[node[place] == to]
        shard = Shard(unit(base), row, place, home)
        asker, x = asks["node"].to_numpy(), matrix(asks["v"].combine_chunks(), d)
        everyone = np.union1d(asker, node)
        known = np.searchsorted(everyone, node)
        root, found = np.arange(len(everyone)), np.zeros(len(asker), np.int64)
        flat = unit(x)
        for at in range(0, len(asker), LOCKSTEP):
            mine = asker[at : at + LOCKSTEP]
            place = np.minimum(np.searchsorted(node, mine), len(node) - 1)
            i, j = shard.near(flat[at : at + LOCKSTEP], np.where(node[place] == mine, place, -1), threshold - slack, beam)
            other = home[j] & (node[j] != mine[i])
            i, j = i[other], j[other]
            score = np.einsum("ij,ij->i", flat[at + i], shard.x[j]) if len(i) else np.zeros(0)
            i, j = i[score >= threshold - 1e-4], j[score >= threshold - 1e-4]
            true = cosines(x, at + i, base, j) >= threshold
            i, j = i[true], j[true]
            found[at : at + LOCKSTEP] = np.bincount(i, copies[j], minlength=len(mine)).astype(np.int64)
            root = least_linked(len(everyone), np.concatenate([np.arange(len(everyone)), np.searchsorted(everyone, mine)[i]]), np.concatenate([root, known[j]]))
        name = np.concatenate([asker, everyone])
        return pa.table([pa.array(name), pa.array(np.concatenate([found, np.zeros(len(everyone), np.int64)])), pa.array(np.concatenate([asker, everyone[root]]))], ["node", "found", "least"]).filter(pa.array(np.concatenate([found > 0, root != np.arange(len(everyone))])))

    by = ("cell", "part", "block")
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(C.tidied_pair(kernel), "node long, found long, least long")


def audited(nodes: DataFrame, d: int, threshold: float, rows: int = AUDIT) -> list[tuple[int, int]]:
    """(node, copies of other nodes linked with it) of the first rows by hash, by comparing them with every node."""
    picked = nodes.orderBy(F.xxhash64("digest"), "node").limit(rows).select("node", "v").collect()
    ids, x = np.array([r.node for r in picked], np.int64), np.array([r.v for r in picked]).reshape(-1, d)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            y, node, copies = matrix(b.column("v"), d), b.column("node").to_numpy(), b.column("copies").to_numpy()
            i, j = np.nonzero(unit(x) @ unit(y).T >= threshold - 1e-6)
            i, j = i[ids[i] != node[j]], j[ids[i] != node[j]]
            true = cosines(x, i, y, j) >= threshold
            total += np.bincount(i[true], copies[j[true]], minlength=len(ids)).astype(np.int64)
        yield pa.record_batch([pa.array(ids), pa.array(total)], ["node", "n"])

    return [(r.node, r.n) for r in nodes.select("node", "v", "copies").mapInArrow(kernel, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()]


def link(vectors: DataFrame, folder: str, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM, slack: float = SLACK, degree: int = DEGREE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    rows, nodes, d = nodes_of(vectors, folder, id_col, vector_col)
    rows = C.staged(rows, folder, "rows", compression="zstd")
    total = nodes.agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).first()
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total.n:
        return alone
    picked = nodes.orderBy(F.xxhash64("digest")).limit(min(SAMPLE, max(4096, PER_CENTRE * -(-total.n // shard_rows)))).select("v").collect()
    sample = unit(np.array([r.v for r in picked]))
    centres = learn_centres(sample, min(-(-total.n // shard_rows), max(1, SAMPLE // PER_CENTRE)))
    members, parts = members_of(nodes, centres, d, folder, shard_rows)
    graph = graph_of(members, d, folder, degree)
    truth = audited(nodes, d, threshold)
    for run in range(RUNS):
        found = C.staged(searched(nodes, graph, parts, centres, d, threshold, beam << run, slack * (run + 1), SPREAD * (1 << run)), folder, f"found-{run}", compression="zstd")
        counts = found.groupBy("node").agg(F.sum("found").alias("found"))
        got = {r.node: r.found for r in counts.join(F.broadcast(spark.createDataFrame(truth, "node long, n long")), "node").select("node", "found").collect()}
        all_links = sum(n for _, n in truth)
        recall = sum(min(n, got.get(node, 0)) for node, n in truth) / all_links if all_links else 1.0
        if recall >= RECALL:
            break
    C.staged(spark.createDataFrame([(len(truth), all_links, recall, run + 1)], "queries long, links long, recall double, runs int"), folder, "audit")
    if recall < LEAST:
        raise RuntimeError(f"the search finds {recall:.3f} of the links of {len(truth)} audited vectors")
    joined = components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")), folder)
    named = nodes.select("node", "digest", "copies", "least").join(joined, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("digest", "copies", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = C.staged(named, folder, "named", compression="zstd")
    told = C.join_frequent_apart(rows.where("digest is not null"), named, ["digest"], named.where(F.col("copies") >= C.FREQUENT * total.rows))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("n_links") == 0)
    return told.select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(alone)


ORACLE = """
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT r, list_transform(e, lambda x: coalesce(x, 0)) AS v, len(e) AS d FROM numbered WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
usual AS (SELECT d FROM good GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
compared AS (SELECT r, v AS e, sqrt(list_dot_product(v, v)) AS norm FROM good JOIN usual USING (d)),
links AS (SELECT a.r AS a, b.r AS b FROM compared a JOIN compared b ON a.r <> b.r WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
counted AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a),
reach AS (SELECT r, r AS t FROM numbered UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.t = links.a),
lowest AS (SELECT reach.r, min(n.vec_id) AS component_id FROM reach JOIN numbered n ON reach.t = n.r GROUP BY reach.r)
SELECT n.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(n.vec_id = component_id, coalesce(n_links, 0) = 0) AS kept
FROM numbered n JOIN lowest USING (r) LEFT JOIN counted USING (r)
"""
