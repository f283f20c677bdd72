"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (fewer words: one shingle, all of them). Documents with equal sets are one class; classes are embedded as T
MinHash values. From the root, a path is extended by coordinates that its own hash samples, with FANOUT of them on average, and by the
class's values there; so two classes share a path if they agree on every value sampled along it. A class's paths need no look at others, and those of DEPTH
steps are computed at once; nodes that more than BUCKET classes share are split further, level by level. Buckets are then compared
by brute force on their embeddings. RUNS independent runs bring the chance that two classes of the threshold's similarity meet to RECALL at least,
at the deepest level and with the deviation of T MinHash values counted in.

What meets is joined to candidate components, and within each every pair is compared exactly, in blocks of BLOCK classes, so no link inside is lost to
sampling and none is emitted as a row of its own: a block pair gives each class's number of links and a spanning forest. A dense cluster of near classes
fills large buckets that no further split would part and that would only multiply its paths. So each class of a large bucket is first compared with the heads of
two such buckets, and buckets that are mostly of one resulting group are not split; nor are those still large after DEEPEST steps, whose blocks
are compared instead. Of all pairs in buckets left whole, those that no candidate component holds yet are then compared, in pairs of blocks.

Null or empty texts have no shingles and are alone. Repeated rows are copies of one class; a null id is never the name of a class that
has another id. Links count other classes, not copies. An empty table gives no row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
T, DEPTH, FANOUT, DEEPEST = 128, 3, 1.43, 5
BUCKET, BLOCK = 64, 256
#: Similarity of embeddings from which two classes are joined to be compared exactly: below the threshold by over five deviations.
NEAR = 0.6
#: Share of a large bucket in one group from which it is left whole.
DENSE = 0.5

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 32, T, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, T, np.uint32)


def meeting_chance(similarity: float, depth: int = DEPTH) -> float:
    """That two classes share a path of this depth: survival of a branching process with one or two children."""
    two = FANOUT - 1
    dead = 0.0
    for _ in range(depth):
        x = 1 - similarity + similarity * dead
        dead = (1 - two) * x + two * x * x
    return 1 - dead


def miss_chance(similarity: float, depth: int, runs: int) -> float:
    """That two classes share no path of this depth in any run; of T MinHash values a binomial number agree."""
    agree = (math.comb(T, k) * similarity**k * (1 - similarity) ** (T - k) for k in range(T + 1))
    return sum(p * (1 - meeting_chance(k / T, depth)) ** runs for k, p in enumerate(agree))


#: The same rows by comparing all pairs that share a shingle; links lead from class to class until no lesser one is reached.
ORACLE = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t),
c AS (SELECT row_number() OVER (ORDER BY min(doc_id), g) AS k, g, min(doc_id) AS least, count(*) AS n_copies FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT k, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT k, k AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.k WHERE r.root < l.b),
u AS (SELECT k, min(root) AS root FROM r GROUP BY 1), n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY 1),
m AS (SELECT g, least, n_copies, coalesce(n_links, 0) AS n_links, min(least) OVER (PARTITION BY root) AS class_id FROM c JOIN u USING (k) LEFT JOIN n USING (k))
SELECT doc_id, coalesce(least, doc_id) AS text_class, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM s LEFT JOIN m ON s.g = m.g"""

RUNS = next(n for n in itertools.count(1) if miss_chance(THRESHOLD, DEEPEST, n) <= 1 - RECALL)


def embed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """T MinHash values of 16 bits for each set; of an empty set, zeros."""
    n, out = len(first) - 1, np.zeros((len(first) - 1, T), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        x = (values >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for t in range(T):
                h = x * _A[t] + _B[t]
                h ^= h >> np.uint32(15)
                least = np.minimum.reduceat(h * np.uint32(0x85EBCA6B), first[some])
                out[some, t] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    assert len(out) == n
    return out


def extend(paths: np.ndarray, rows: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of paths (each of the class in that row of e): (paths, rows). One or two coordinates follow from the path."""
    out_p, out_r = [], []
    for k in range(2):
        seed = C.mix(paths, 31 + k)
        coordinate = (seed % np.uint64(T)).astype(np.int64)
        value = e[rows, coordinate].astype(np.uint64)
        child = C.mix(seed ^ (value + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 7)
        if k:
            keep = C.mix(paths, 99) < np.uint64(int((FANOUT - 1) * 2**64))
            child, rows = child[keep], rows[keep]
        out_p.append(child)
        out_r.append(rows)
    return np.concatenate(out_p), np.concatenate(out_r)


def paths_of(e: np.ndarray, depth: int = DEPTH, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """All paths of this depth, in all runs, of each row of e."""
    n = len(e)
    paths = np.tile(C.mix(np.arange(runs, dtype=np.uint64), 3), n)
    rows = np.repeat(np.arange(n), runs)
    for _ in range(depth):
        paths, rows = extend(paths, rows, e)
    return paths, rows


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric relation, given as a boolean matrix."""
    u = Union(len(near))
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True) if u.join(int(a), int(b))]


def embeddings_of(column: pa.ChunkedArray) -> np.ndarray:
    return C.raw(column)[0].view(np.uint16).reshape(-1, T)


def compare_bucket(t: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the near classes of a bucket, or of one block of it."""
    node, e = t["node"].to_numpy(), embeddings_of(t["e"])
    _, keep = np.unique(node, return_index=True)
    node, e = node[keep], e[keep]
    near = np.zeros((len(node), len(node)), bool)
    for i in range(len(node)):
        near[i] = (e == e[i]).mean(axis=1) >= NEAR
    tree = forest(near)
    return pa.table([pa.array([node[x] for x, _ in tree], pa.int64()), pa.array([node[y] for _, y in tree], pa.int64())], ["a", "b"])


def compare_roots(t: pa.Table) -> pa.Table:
    """Edges (a, b) that join the roots of near classes: each class marked apart is compared with each unmarked one of another root."""
    node, e, apart = t["node"].to_numpy(), embeddings_of(t["e"]), t["apart"].to_numpy(zero_copy_only=False)
    _, root = np.unique(t["root"].to_numpy(), return_inverse=True)
    others = np.flatnonzero(~apart)
    u, a, b = Union(len(node)), [], []
    for i in np.flatnonzero(apart):
        near = others[((e[others] == e[i]).mean(axis=1) >= NEAR) & (root[others] != root[i])]
        for j in near[np.unique(root[near], return_index=True)[1]]:
            if u.join(int(root[i]), int(root[j])):
                a.append(node[i])
                b.append(node[j])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compare_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from heads to the near classes among those that are compared with them."""
    for b in batches:
        near = pa.array((embeddings_of(b.column("e")) == embeddings_of(b.column("head_e"))).mean(axis=1) >= NEAR)
        yield pa.record_batch([b.column("head").filter(near), b.column("node").filter(near)], ["a", "b"])


def dense_buckets(large: DataFrame, embedding: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(edges from heads of large buckets to near classes, paths of the buckets that are nearly all of one group)."""
    heads = large.groupBy("path").agg(F.min_by("node", F.xxhash64("node")).alias("head"))
    # each class meets the heads of two of its buckets, the largest and another
    two = large.groupBy("node").agg(F.array_distinct(F.array(F.max_by("path", F.struct("n", "path")), F.min_by("path", F.xxhash64("path")))).alias("paths"))
    one = two.select("node", F.explode("paths").alias("path")).join(heads, "path").where("node <> head").select("node", "head").distinct()
    both = one.join(embedding, "node").join(embedding.select(F.col("node").alias("head"), F.col("e").alias("head_e")), "head")
    edges = C.staged(both.select("head", "head_e", "node", "e").mapInArrow(C.tidied(compare_heads), "a long, b long"), folder, "heads")
    root = components(edges, f"{folder}/groups")
    grouped = large.select("path", "node").join(root, "node", "left").groupBy("path", F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("c"))
    dense = grouped.groupBy("path").agg((F.max("c") >= DENSE * F.sum("c")).alias("dense")).where("dense").select("path")
    return edges, C.staged(dense, folder, "dense")


def across_blocks(large: DataFrame, embedding: DataFrame, first: DataFrame, folder: str) -> DataFrame | None:
    """Edges between classes of one large bucket that first leaves in different components; None if there are no such classes.
    Two classes of different roots are not both in the bucket's largest, so the classes outside it are compared with all."""
    rooted = C.staged(large.select("path", "node").join(first, "node", "left").select("path", "node", F.coalesce("root", "node").alias("root")), folder, "rooted")
    sizes = rooted.groupBy("path", "root").agg(F.count("*").alias("c")).groupBy("path").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.sum("c").alias("n"), F.max("c").alias("most"))
    mixed = C.staged(sizes.where("n > most").select("path", "top", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("rows"), F.ceil(F.col("n") / BLOCK).alias("columns")), folder, "mixed")
    if mixed.isEmpty():
        return None

    def each(number: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), (F.col(number) - 1).cast("int")))

    def block(number: str) -> F.Column:
        return F.pmod(F.xxhash64("node"), F.col(number)).cast("int")

    placed = rooted.join(mixed, "path").join(embedding, "node")
    apart = placed.where("root <> top").select("path", "node", "root", "e", F.lit(True).alias("apart"), block("rows").alias("i"), each("columns").alias("j"))
    every = placed.select("path", "node", "root", "e", F.lit(False).alias("apart"), each("rows").alias("i"), block("columns").alias("j"))
    return C.staged(apart.union(every).groupBy("path", "i", "j").applyInArrow(compare_roots, "a long, b long"), folder, "across")


def compare_sets(values: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each two of these sets have that Jaccard similarity: frequent values by products of indicator matrices, rare ones by their short lists."""
    n = len(first) - 1
    size = np.diff(first)
    row = np.repeat(np.arange(n), size)
    _, v, count = np.unique(values, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    often = np.flatnonzero(count > max(8, n // 16))
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    for at in range(0, len(often), 4096):
        pick = (place[v] >= at) & (place[v] < at + 4096)
        m = np.zeros((n, min(4096, len(often) - at)), np.float32)
        m[row[pick], place[v][pick] - at] = 1
        common += m @ m.T
    rare = (place[v] < 0) & (count[v] > 1)
    if rare.any():
        order = np.argsort(v[rare], kind="stable")
        r, g = row[rare][order], v[rare][order]
        for step in range(1, int(count[v[rare]].max())):
            same = g[step:] == g[:-step]
            a, b = r[:-step][same], r[step:][same]
            add = np.bincount(a * n + b, minlength=n * n).reshape(n, n)
            common += add + add.T
    union = size[:, None] + size[None, :] - common
    out = common >= threshold * union - 1e-6
    np.fill_diagonal(out, False)
    return out & (size > 0)[:, None] & (size > 0)[None, :]


def compare_blocks(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        """Links and a spanning forest of one pair of blocks of a component."""
        node, block = t["node"].to_numpy(), t["block"].to_numpy()
        _, keep = np.unique(node, return_index=True)
        t, node, block = t.take(pa.array(keep)), node[keep], block[keep]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        values, first = C.shingle_sets(t["text"], SHINGLE)
        near = compare_sets(values, first, threshold)
        if i != j:
            near &= block[:, None] != block[None, :]
        links = near.sum(axis=1)
        tree = forest(near)
        some = np.flatnonzero(links)
        a = [node[x] for x in some] + [node[x] for x, _ in tree]
        b = [node[x] for x in some] + [node[y] for _, y in tree]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links[some].tolist() + [0] * len(tree), pa.int64())], ["a", "b", "links"])

    return run


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (the text's hash), node (the hash of the set, null for an empty one) and e of each row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            values, first = C.shingle_sets(b.column("text"), SHINGLE)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(values, 77))])
                node = C.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64), 78).view(np.int64)
            e = embed(values, first)
            yield pa.record_batch([b.column("id"), b.column("th"), pa.array(node, pa.int64(), mask=np.diff(first) == 0), C.blobs(e.reshape(-1), np.arange(len(e) + 1) * T)], ["id", "th", "node", "e"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(C.tidied(run), f"id {kind}, th long, node long, e binary")


def link(docs: DataFrame, folder: str, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_class (the least id with an equal set), class_id (the least id that links lead to), n_links (other classes with the
    threshold's similarity), n_copies (rows with an equal set), for every row."""
    spark = docs.sparkSession
    rows = C.staged(sets_of(docs, id_col, text_col), folder, "sets", compression="zstd")
    classes = C.staged(rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "th")).alias("first"), F.count("*").alias("n_copies"), F.first("e").alias("e")).select("node", F.col("first.id").alias("least"), F.col("first.th").alias("th"), "n_copies", "e"), folder, "classes")

    def all_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                p, r = paths_of(embeddings_of(part.column("e")))
                yield pa.record_batch([pa.array(p.view(np.int64)), part.column("node").take(pa.array(r))], ["path", "node"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, r = extend(b.column("path").to_numpy().view(np.uint64), np.arange(b.num_rows), embeddings_of(b.column("e")))
            yield pa.record_batch([pa.array(p.view(np.int64)), b.column("node").take(pa.array(r))], ["path", "node"])

    embedding = classes.select("node", "e")
    found: list[DataFrame] = []

    def shared(level: DataFrame, name: str) -> DataFrame:
        """The level's paths that several classes share, with their number."""
        counts = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        return C.staged(level.join(counts, "path"), folder, name)

    level = shared(classes.select("node", "e").mapInArrow(C.tidied(all_paths), "path long, node long"), f"paths-{DEPTH}")
    known: list[DataFrame] = []
    whole: list[DataFrame] = []
    if DEPTH < DEEPEST and not level.where(F.col("n") > BUCKET).isEmpty():
        to_heads, dense = dense_buckets(level.where(F.col("n") > BUCKET), embedding, folder)
        known.append(to_heads)
        whole.append(level.join(dense, "path", "left_semi").select("path", "node"))
        level = level.join(dense, "path", "left_anti")
    for depth in range(DEPTH, DEEPEST + 1):
        last = depth == DEEPEST
        small = level if last else level.where(F.col("n") <= BUCKET)
        found.append(small)
        large = level.where(F.col("n") > BUCKET)
        if last or large.isEmpty():
            break
        level = shared(large.join(embedding, "node").mapInArrow(C.tidied(deeper), "path long, node long"), f"paths-{depth + 1}")

    buckets = reduce(DataFrame.union, found)
    part = F.when(F.col("n") > BUCKET, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BUCKET))).otherwise(F.lit(0))
    if last and not large.isEmpty():
        whole.append(large.select("path", "node"))
    edges = C.staged(buckets.join(embedding, "node").withColumn("part", part).groupBy("path", "part").applyInArrow(compare_bucket, "a long, b long"), folder, "edges")
    member = C.staged(components(reduce(DataFrame.union, [edges, *known]), f"{folder}/near"), folder, "near-roots")
    if whole and (across := across_blocks(reduce(DataFrame.union, whole), embedding, member, folder)) is not None:
        joined = member.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across)
        member = C.staged(components(joined, f"{folder}/nearer"), folder, "candidates")
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    wanted = member.join(sizes, "root").join(classes.select("node", "least", "th"), "node")
    placed = wanted.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    spread = placed.select("root", "node", "least", "block", other).select("root", "node", "least", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    with_text = spread.join(one_text(texts, wanted), "node")
    linked = C.staged(with_text.select("root", "node", "block", "i", "j", "text").groupBy("root", "i", "j").applyInArrow(compare_blocks(threshold), "a long, b long, links long"), folder, "links", )
    per_node = linked.where("a = b").groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "node")
    linked_roots = components(linked.where("a <> b").select("a", "b"), f"{folder}/whole")
    named = classes.select("node", "least", "n_copies").join(linked_roots, "node", "left").join(per_node, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = C.staged(named.join(roots, "root").select("node", F.col("least").alias("text_class"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), folder, "named")
    alone = rows.select("id", "node").join(named, "node", "left")
    return alone.select(F.col("id").alias("doc_id"), F.coalesce("text_class", "id").alias("text_class"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def one_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text: the text of one row of each wanted class, or that of each of its equal rows. Rows are told apart by id (null or not) and the text's
    hash; the set's hash is checked again."""
    named = wanted.select("node", F.col("least").alias("least"), F.col("th").alias("least_th"))
    picked = texts.join(named, (texts.th == named.least_th) & texts.id.eqNullSafe(named.least))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            values, first = C.shingle_sets(b.column("text"), SHINGLE)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(values, 77))])
                node = C.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64), 78).view(np.int64)
            right = node == b.column("node").to_numpy()
            yield b.select(["node", "text"]).filter(pa.array(right))

    return picked.select("node", "text").mapInArrow(C.tidied(check), "node long, text string")
