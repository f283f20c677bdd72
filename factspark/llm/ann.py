"""Approximate nearest neighbours by inner product: multi-index hashing over learned binary codes.

Vectors v become [v / M, sqrt(1 - |v|^2 / M^2)] with M the largest norm, so that the largest inner product is the smallest
angle. Rotations learned on a bounded sample (iterative quantisation) give BITS bits. A shard cuts its codes into substrings of
SUBSTRING bits, about the logarithm of its rows, and keeps an inverted list for each value of each. By the pigeonhole principle a code within radius r
of the query's differs by at most floor(r / substrings) in some substring, so probing the lists of all values that near
retrieves every code within r. What they give is checked by the whole code and reranked with the original vectors in double precision. Where a radius
asks for more lists than PROBES, the codes are compared one by one, which gives the same set at less cost.

The radius follows from the query: it grows until K are found, then to the angle of the K-th best plus Z standard deviations of the Hamming distance at
that angle, so a neighbour at that angle is missed with the probability of a normal tail beyond Z.

Queries, with their codes, are written once; every task builds indexes over its own rows, SHARD_ROWS at a time, and reads the queries in
batches, so no row is sent from task to task but each shard's k best of each query. Which rows share a shard changes no distance.

No part is taken by rows with a null id, and by vectors that are null, zero, hold null or non-finite components, or are of
another length than most (of equally many, the shorter). A query is a row: other rows with its id are candidates like all others, and each of several
query rows with one id has its own k results. Equal scores are in order of vec_id. Fewer candidates than k give them all; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

BITS, SUBSTRING = 256, 16
Z = 2.0
#: Rows that the rotations are learned from.
SAMPLE = 4000
SHARD_ROWS, QUERY_ROWS = 1 << 15, 2048
#: Lists of one substring that are probed at most; beyond, codes are compared one by one.
PROBES = 200


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Directions, one for each bit: principal axes turned by iterative quantisation, as often as needed for all bits."""
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1][:, : min(bits, sample.shape[1])]
    found: list[np.ndarray] = []
    while sum(x.shape[1] for x in found) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        flat = sample @ axes
        for _ in range(rounds):
            u, _, v = np.linalg.svd(flat.T @ np.where(flat @ turn >= 0, 1.0, -1.0))
            turn = u @ v
        found.append(axes @ turn)
    return np.hstack(found)[:, :bits]


def lift(v: np.ndarray, norm: float) -> np.ndarray:
    v = v / norm
    return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))[:, None]])


def codes_of(lifted: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.packbits(lifted @ directions >= 0, axis=1)


def near_values(distance: int) -> np.ndarray:
    """All substrings with so many ones at most: what a value is combined with to give the values that near."""
    ones = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint32))
    return np.flatnonzero(ones <= distance)


NEAR = [x for d in range(SUBSTRING + 1) if len(x := near_values(d)) <= PROBES]


class MultiIndex:
    """Codes of a shard with an inverted list for each value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.words = np.ascontiguousarray(codes.view(np.uint64).T)
        parts = codes.view(">u2").astype(np.int64)
        self.order = [np.argsort(x, kind="stable") for x in parts.T]
        self.bounds = [np.searchsorted(x[o], np.arange((1 << SUBSTRING) + 1)) for x, o in zip(parts.T, self.order, strict=True)]

    def distances(self, query: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        out = None
        for own, w in zip(self.words, query.view(np.uint64), strict=True):
            d = np.bitwise_count((own if rows is None else own[rows]) ^ w)
            out = d.astype(np.uint16) if out is None else np.add(out, d, out=out)
        return out

    def probes(self, radius: int) -> bool:
        """Whether lists are probed for this radius."""
        return radius // len(self.order) < len(NEAR)

    def within(self, query: np.ndarray, radius: int, every: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of all codes within the radius; every may hold the distances of all."""
        if self.probes(radius):
            # some substring of the first rest + 1 is within most, or some other within most - 1
            most, rest = divmod(radius, len(self.order))
            hit = np.zeros(self.n, bool)
            for j, value in enumerate(query.view(">u2").astype(np.int64)):
                allowed = most if j <= rest else most - 1
                if allowed >= 0:
                    values = value ^ NEAR[allowed]
                    low, high = self.bounds[j][values], self.bounds[j][values + 1]
                    some = np.flatnonzero(high > low)
                    for a, b in zip(low[some].tolist(), high[some].tolist(), strict=True):
                        hit[self.order[j][a:b]] = True
            rows = np.flatnonzero(hit)
            distance = self.distances(query, rows)
        else:
            distance = self.distances(query) if every is None else every
            rows = np.flatnonzero(distance <= radius)
            return rows, distance[rows]
        keep = distance <= radius
        return rows[keep], distance[keep]


def nearest(index: MultiIndex, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, code: np.ndarray, own: int, norm: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the k best found, best first; own is the query's row in the shard, or -1."""
    bits = 8 * len(code)
    others = index.n - (own >= 0)
    if not others:
        return ids[:0], vectors[:0, 0]
    # small radii by the lists; when they end, the distances of all give the radius that holds k
    every, radius = None, len(index.order) * (len(NEAR) - 1) + len(index.order) - 1
    rows, _ = index.within(code, radius)
    if len(rows) - np.count_nonzero(rows == own) < min(k, others):
        every = index.distances(code)
        radius = int(np.searchsorted(np.cumsum(np.bincount(every, minlength=bits + 1)), min(k + (own >= 0), index.n)))
        rows = np.flatnonzero(every <= radius)
    rows = rows[rows != own]
    scored, score = rows, (vectors[rows] * query).sum(axis=1)
    kth = np.partition(score, -k)[-k] if len(rows) > k else score.min()
    turned = math.acos(min(1.0, max(-1.0, kth / (norm * math.sqrt(float((query * query).sum())))))) / math.pi if others > k else 1.0
    need = min(bits, math.ceil(bits * turned + Z * math.sqrt(bits * turned * (1 - turned))))
    if need > radius:
        rows, _ = index.within(code, need, every)
        rows = rows[rows != own]
        # the k-th best is at least as good as before, so the rest below it needs no exact order
        new = np.setdiff1d(rows, scored, assume_unique=True)
        rows, score = np.concatenate([scored, new]), np.concatenate([score, (vectors[new] * query).sum(axis=1)])
    best = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][best], score[best]


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(vectors: DataFrame, is_query: Column, folder: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is a query, among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = C.staged(rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("row", F.monotonically_increasing_id()), folder, "rows", compression="zstd")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes or not sizes[0].nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, norm = sizes[0].d, math.sqrt(sizes[0].norm)
    rows = rows.where(F.size("v") == d)
    picked = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "row").limit(sample).select("v").collect()])
    directions = learn(lift(picked, norm))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), d)
            # a query's own code has no lifted part
            lifted = np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))])
            yield pa.record_batch([*(b.column(c) for c in ("id", "row", "v")), C.blobs(codes_of(lifted, directions).reshape(-1), np.arange(len(x) + 1) * (BITS // 8))], ["id", "row", "v", "code"])

    C.staged(rows.where("q").select("id", "row", "v").mapInArrow(C.tidied(encode), "id long, row long, v array<double>, code binary"), folder, "queries")

    def found_in(ids: np.ndarray, own_rows: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(codes_of(lift(x, norm), directions))
        order = np.argsort(own_rows)
        for b in C.parquet_batches(f"{folder}/queries", QUERY_ROWS):
            asked, q, row = b.column("id").to_numpy(), matrix(b.column("v"), d), b.column("row").to_numpy()
            codes = C.raw(b.column("code"))[0].reshape(-1, BITS // 8)
            place = np.minimum(np.searchsorted(own_rows[order], row), len(order) - 1)
            own = np.where(own_rows[order][place] == row, order[place], -1)
            got = [nearest(index, x, ids, q[i], codes[i], int(own[i]), norm, k) for i in range(len(asked))]
            size = [len(near) for near, _ in got]
            yield pa.record_batch([pa.array(np.repeat(row, size)), pa.array(np.repeat(asked, size)), pa.array(np.concatenate([near for near, _ in got])), pa.array(np.concatenate([score for _, score in got]))], ["row", "query_id", "vec_id", "score"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column("id").to_numpy(), b.column("row").to_numpy(), matrix(b.column("v"), d)))
            n += b.num_rows
            if n >= SHARD_ROWS:
                yield from found_in(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from found_in(*map(np.concatenate, zip(*held, strict=True)))

    found = rows.select("id", "row", "v").mapInArrow(C.tidied(probe), "row long, query_id long, vec_id long, score double")
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
