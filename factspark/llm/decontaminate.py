"""Benchmark decontamination: containment search with size-partitioned MinHash, verified by exact shingle containment.

Shingles are SHINGLE words, unchanged; an item of fewer words has one shingle, all its words. Items are partitioned by size into
powers of two. For a partition of items of s to 2s - 1 shingles a document is read in windows of 4s shingles that start every
2s, so each passage as long as an item lies whole in some window, and the Jaccard similarity of window and item stays high
however long the document is. Window and item have MinHash sketches of BINS values (one permutation, the least hash of each
bin); an agreement in any bin makes a candidate, which is then verified: the share of the item's shingles that the document holds must reach the threshold.
With a containment of 0.8 the chance that no bin agrees is below 1e-6. The sketch of an item of few shingles would hold nearly all of them; of
such items the rarest shingles are listed instead, a fifth of them and one more at this threshold: a document without any of these holds too few of the
others, so nothing is lost, and an opening that thousands of items share proposes none of them. Candidates from sketches, too, are first asked for their rarest
shingles, all of a document at once.

Only windows that hold some sketched item value at all are sketched; others can't agree. Hashes only propose: what is reported was counted
on the words themselves. The benchmark is written in blocks of about BLOCK_BYTES of text (a longer item is taken whole), each a pass over
the documents; a task reads one block from the shared folder, and nothing of the benchmark goes through the driver.

Null or empty texts and items hold nothing and are never reported; repeated rows are reported each; null ids stay null;
an empty table on either side gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

SHINGLE = 5
BINS = 256
BLOCK_BYTES = 16 << 20
SIEVE_BITS = 22
#: Least shingles of the size partitions up to which the rarest shingles of an item make candidates, and no sketch.
SMALL = 16


def member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers from each start to its stop, one range after another."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)


@dataclass
class Postings:
    """Values in order, and the item of each."""

    values: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, items: np.ndarray) -> Postings:
        order = np.argsort(values, kind="stable")
        return cls(values[order], items[order].astype(np.int32))

    def holding(self, wanted: np.ndarray) -> np.ndarray:
        """The items that have one of these distinct values, a number for each value."""
        return self.items[ranges(np.searchsorted(self.values, wanted), np.searchsorted(self.values, wanted, "right"))]


class Items:
    """Shingles, rarest shingles and sketches of a block of items, in flat arrays."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = 0.8, k: int = SHINGLE):
        kept = [(i, t) for i, t in zip(ids, texts, strict=True) if t]
        self.texts = pa.array([t for _, t in kept], pa.string())
        self.ids = [i for i, _ in kept]
        self.threshold = threshold
        w = C.words(self.texts)
        length = np.minimum(np.diff(w.first), k)
        self.size = np.zeros(len(kept), np.int64)
        #: words of a shingle -> size partition -> postings
        self.parts: dict[int, dict[int, Postings]] = {}
        self.sieve: dict[int, np.ndarray] = {}
        item, hash_, rare = [], [], []
        for n in np.unique(length[length > 0]).tolist():
            h, ok = C.grams(w, n)
            at = np.flatnonzero(ok)
            own = np.searchsorted(w.first, at, "right") - 1
            of_n = length[own] == n
            own, v = own[of_n], h[at[of_n]]
            part = np.frexp(np.bincount(own, minlength=len(kept)))[1] - 1
            order = np.lexsort((v, own))
            own, v = own[order], v[order]
            first = np.concatenate([[True], (own[1:] != own[:-1]) | (v[1:] != v[:-1])])
            own, v = own[first], v[first]
            size = np.bincount(own, minlength=len(kept))
            self.size += size
            # an item's rarest shingles, so many that a text which holds none of them can't hold enough of the others
            _, which, often = np.unique(v, return_inverse=True, return_counts=True)
            by_rarity = np.lexsort((v, often[which], own))
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            needed = np.ceil(threshold * size - 1e-9).astype(np.int64)
            is_rare = np.zeros(len(own), bool)
            is_rare[by_rarity] = place < (size - needed + 1)[own]
            # the least hash of each bin
            bins = v % np.uint64(BINS)
            order = np.lexsort((v, bins, own))
            sketched = order[np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (bins[order][1:] != bins[order][:-1])])]
            self.parts[n], self.sieve[n] = {}, np.zeros(1 << SIEVE_BITS, bool)
            for e in np.unique(part[np.unique(own)]).tolist():
                here = np.flatnonzero(is_rare & (part[own] == e)) if 1 << e <= SMALL else sketched[part[own[sketched]] == e]
                self.parts[n][1 << e] = Postings.of(v[here], own[here])
                self.sieve[n][v[here] >> np.uint64(64 - SIEVE_BITS)] = True
            item.append(own)
            hash_.append(v)
            rare.append(is_rare)
        own, v, is_rare = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((item, np.int64), (hash_, np.uint64), (rare, bool)))
        order = np.lexsort((v, own))
        self.shingles = v[order]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.rare = v[order][is_rare[order]]
        self.rare_first = np.concatenate([[0], np.cumsum(np.bincount(own[is_rare], minlength=len(kept)))])

    def of(self, i: int) -> np.ndarray:
        return self.shingles[self.first[i] : self.first[i + 1]]

    def held(self, found: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Those of these distinct items that a text with the sorted hashes own holds: first by their rarest shingles, then by all."""
        for flat, first, needed in ((self.rare, self.rare_first, None), (self.shingles, self.first, self.threshold * self.size - 1e-9)):
            if not len(found):
                break
            size = first[found + 1] - first[found]
            hits = member(own, flat[ranges(first[found], first[found + 1])])
            counts = np.add.reduceat(hits, np.cumsum(size) - size, dtype=np.int64)
            found = found[counts >= (1 if needed is None else needed[found])]
        return found

    def spelled(self, i: int, n: int) -> set[tuple[bytes, ...]]:
        """The shingles of an item in words."""
        w = C.words(self.texts.slice(i, 1))
        return spelled(w, np.arange(len(w.hash) - n + 1), n)


def spelled(w: C.Words, at: np.ndarray, n: int) -> set[tuple[bytes, ...]]:
    """The n words from each of these, as bytes."""
    return {tuple(w.buf[w.start[j] : w.end[j]].tobytes() for j in range(i, i + n)) for i in at.tolist()}


def sketch(h: np.ndarray) -> np.ndarray:
    """The least hash of each bin that has one."""
    order = np.lexsort((h, h % np.uint64(BINS)))
    h = h[order]
    bins = h % np.uint64(BINS)
    return h[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(h) else h


def contained(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, shingles of the item, of these in the text) for each item that a text holds."""
    w = C.words(texts)
    out: list[tuple[int, int, int, int]] = []
    for n, parts in items.parts.items():
        h, ok = C.grams(w, n)
        hit = np.flatnonzero(ok & items.sieve[n][h >> np.uint64(64 - SIEVE_BITS)])
        row = np.searchsorted(w.first, hit, "right") - 1
        edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(hit) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            r = int(row[a])
            base, stop = w.first[r], w.first[r + 1] - n + 1
            near = hit[a:b] - base
            found = []
            for s, postings in parts.items():
                exact = near[member(postings.values, h[base + near])]
                if not len(exact):
                    continue
                if s <= SMALL:
                    found.append(postings.holding(np.unique(h[base + exact])))
                    continue
                windows = np.unique(np.concatenate([exact // (2 * s), np.maximum(exact // (2 * s) - 1, 0)]))
                sketches = [sketch(h[base + j * 2 * s : min(stop, base + (j + 2) * 2 * s)]) for j in windows.tolist()]
                found.append(postings.holding(np.unique(np.concatenate(sketches))))
            if not found:
                continue
            candidates = np.unique(np.concatenate(found))
            for i in items.held(candidates, np.unique(h[base:stop])).tolist() if len(candidates) else ():
                # counted again in words: all places whose hash is the item's
                want, places = items.spelled(i, n), np.flatnonzero(member(items.of(i), h[base:stop]))
                got = len(want & spelled(w, base + places, n))
                if got >= items.threshold * len(want) - 1e-9:
                    out.append((r, i, len(want), got))
    return out


_loaded: dict[tuple[str, float], Items] = {}


def block_items(path: str, threshold: float) -> Items:
    """The items of one block; a worker keeps those of the last block it read."""
    if (path, threshold) not in _loaded:
        _loaded.clear()
        ids: list = []
        texts: list = []
        for b in C.parquet_batches(path):
            ids += b.column("item").to_pylist()
            texts += b.column("text").to_pylist()
        _loaded[path, threshold] = Items(ids, texts, threshold)
    return _loaded[path, threshold]


def contaminated(docs: DataFrame, benchmark: DataFrame, folder: str, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, shingles, found, containment for each item that a document holds."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, shingles int, found int, containment double"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)

    def search(block: int) -> DataFrame:
        path = f"{folder}/items-{block}"
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        C.staged(part, folder, f"items-{block}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block_items(path, threshold)
            for b in C.slices(batches, "text"):
                got = contained(b.column("text"), own)
                if got:
                    r, i, size, found = zip(*got, strict=True)
                    yield pa.record_batch([b.column("id").take(pa.array(r)), pa.array([own.ids[x] for x in i], item_type), pa.array(size, pa.int32()), pa.array(found, pa.int32()), pa.array(np.divide(found, size))], ["doc_id", "item_id", "shingles", "found", "containment"])

        return rows.mapInArrow(C.tidied(run), schema)

    return reduce(DataFrame.union, map(search, range(blocks))) if blocks else spark.createDataFrame([], schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
si AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' '))) AS s FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM si),
sd AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(list_slice(w, p, p + n - 1), ' '))) AS s FROM d, k WHERE len(w) >= n),
size AS (SELECT item_id, count(*) AS shingles FROM si GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(shingles) AS INTEGER) AS shingles, CAST(count(*) AS INTEGER) AS found, CAST(count(*) AS DOUBLE) / any_value(shingles) AS containment
FROM sd JOIN si USING (n, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(shingles) - 1e-9
"""
