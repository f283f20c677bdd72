"""Substring dedup: a compressed FM-index per shard, searched backward for passages that also start elsewhere.

Words are unchanged runs of non-space bytes. A window is WINDOW consecutive words of one document. So that equal windows meet in one shard, each is routed by
its minimiser: of its GRAM-word hashes the least one, the leftmost of equal ones. Neighbouring windows with the same minimiser travel as one
passage. Passages whose minimiser occurs once in the corpus can't repeat and stay at home; those with a very frequent one are routed window by window, by the
window's own hash, so no shard gathers a hot passage's surroundings. Equal passages of a batch travel once, with the list of their places; those of
frequent minimisers are counted by Spark first and travel as passage and count alone, and their places are joined to what the index reports.

A shard sorts the suffixes of its distinct passages, builds the Burrows-Wheeler transform as a wavelet tree of packed bits with rank counts, and streams
every passage through backward search: matching statistics against the index, each row counted as often as its passage occurs. Intervals of at least
WINDOW words that occur twice or more are reported for every place.

Null or empty texts have no words. Repeated rows repeat each other's windows. Ties and overlaps need no choice: all places of a repeated window are reported.
An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 35, 8
#: Words in a shard, about; occurrences from which a minimiser's windows are routed one by one.
SHARD_WORDS, HOT = 1_000_000, 2000
#: Repeated windows of frequent minimisers, 8 bytes each, up to which their names are broadcast.
NAMES = 1_000_000


# ---------------------------------------------------------------- routing


def window_runs(w: C.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the minimiser, first window, last window) of each run of windows that share one; windows by the number of
    their first word."""
    n = len(w.hash)
    h, _ = C.grams(w, gram)
    width = window - gram + 1
    best, at = h, np.arange(n)
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        m = max(len(best) - step, 0)
        right = best[step:] < best[:m]
        best, at = np.where(right, best[step:], best[:m]), np.where(right, at[step:], at[:m])
        covered += step
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)
    start = np.flatnonzero(left[: len(at)] >= window)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    chosen = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(start)]]) - 1
    return h[chosen[begin]], start[begin], start[end]


# ---------------------------------------------------------------- FM-index


class WaveletTree:
    """Rank over a sequence of symbols below 2 ** levels: a bit vector for each level, packed, with the ones before each word."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.bits, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.bits.append(words)
            self.before.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefixes of these lengths end after the symbols' bits have been followed to the last level."""
        for i in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][word] + np.bitwise_count(self.bits[i][word] & below)
            at = np.where(symbol >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """An index of passages, sequences of symbols from 1; 0 parts them. Suffixes are sorted by as many symbols as the
    longest passage has, which is exact for every pattern that is not longer."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, longest: int):
        n = len(text)
        rank = text.astype(np.int64)
        order, depth = None, 1
        while True:
            key = np.zeros(n, np.int64)
            key[: max(n - depth, 0)] = rank[depth:] + 1
            key += rank * (int(rank.max(initial=0)) + 2)
            order = np.argsort(key)
            sorted_ = key[order]
            new = np.zeros(n, np.int32)
            np.cumsum(sorted_[1:] != sorted_[:-1], out=new[1:])
            del key, sorted_
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth *= 2
            if depth >= longest + 1 or n == 0 or new[-1] == n - 1:
                break
        top = int(text.max(initial=0))
        self.tree = WaveletTree(text[order - 1], max(1, top.bit_length()))
        symbols = np.arange(top + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])[: top + 1]
        self.base = self.tree.descend(symbols, np.zeros(top + 1, np.int64))
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with these symbols put before them."""
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.tile(self.base[symbol], 2) + np.tile(self.less[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]

    def reach(self, text: np.ndarray, stop: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For each pattern text[floor:stop], the least start from which text[start:stop] occurs twice; backward from stop."""
        at = stop.copy()
        live = np.flatnonzero(at > floor)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.tree.n, np.int64)
        while len(live):
            low, high = self.extend(text[at[live] - 1], low, high)
            ok = self.weight[high] - self.weight[low] >= 2
            live, low, high = live[ok], low[ok], high[ok]
            at[live] -= 1
            more = at[live] > floor[live]
            live, low, high = live[more], low[more], high[more]
        return at

    def repeated(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
        """Whether the window that starts at each position occurs twice; passage i is text[first[i]:first[i] + size[i]]."""
        out = np.zeros(len(text) + 1, bool)
        mark = np.zeros(len(text) + 2, np.int64)
        last = first + size - window

        def found(a: np.ndarray, b: np.ndarray) -> None:
            """Windows from a to b are repeated."""
            some = b >= a
            np.add.at(mark, a[some], 1)
            np.add.at(mark, b[some] + 1, -1)

        # from the end: what the longest repeated end of the passage covers
        got = self.reach(text, first + size, first)
        found(got, last)
        low, high = first.copy(), np.minimum(got - 1, last)
        while len(open_ := np.flatnonzero(low <= high)):
            # the lowest window left; if it fails at f, so do all that start up to f and hold what follows it
            start = low[open_]
            got = self.reach(text, start + window, start)
            fits = got == start
            low[open_[~fits]] = got[~fits]
            # else the longest repeated string from there, by bisection of its end
            grow = open_[fits]
            a, b = low[grow].copy(), high[grow].copy()
            while len(part := np.flatnonzero(a < b)):
                middle = (a[part] + b[part] + 1) // 2
                whole = self.reach(text, middle + window, low[grow[part]]) == low[grow[part]]
                a[part[whole]] = middle[whole]
                b[part[~whole]] = middle[~whole] - 1
            found(low[grow], a)
            low[grow] = a + 1
        out[:] = np.cumsum(mark[:-1]) > 0
        return out


def search_shard(t: pa.Table, window: int) -> pa.Table:
    """key, a, b: word ranges of documents that repeated windows cover, from the passages of one shard. A passage without places gives its name
    as key instead, with a and b from its own first word, and named is true."""
    w = C.words(t["passage"])
    size = np.diff(w.first)
    here = t["places"].is_valid().to_numpy()
    places, count = C.raw(t["places"])[0].view(np.int64).reshape(-1, 2), t["n"].to_numpy()
    # passages and words are told apart by their bytes
    same = t["passage"].combine_chunks().dictionary_encode().indices.to_numpy()
    _, kept = np.unique(same, return_index=True)
    total = np.bincount(same, weights=count).astype(np.int64)
    # the text of distinct passages, each with a separator behind it
    length = size[kept]
    first = np.concatenate([[0], np.cumsum(length + 1)[:-1]]).astype(np.int64)
    text = np.zeros(int((length + 1).sum()), np.int32)
    symbol = w.spelled().dictionary_encode().indices.to_numpy()
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(first, length) + within] = symbol[np.repeat(w.first[kept], length) + within] + 1
    weight = np.repeat(total, length + 1)
    weight[first + length] = 0
    index = FMIndex(text, weight, int(length.max(initial=1)))
    hit = index.repeated(text, first, length, window)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    passage = np.searchsorted(first, a, "right") - 1
    a, b = a - first[passage], b - first[passage] + window

    def spread(spot_of: np.ndarray, key: np.ndarray, at: np.ndarray, named: bool) -> pa.Table:
        """The reported ranges of each passage for each of its spots."""
        order = np.argsort(spot_of, kind="stable")
        begin = np.searchsorted(spot_of[order], np.arange(len(kept) + 1))
        times = np.diff(begin)[passage]
        spot = order[np.repeat(begin[passage], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        return pa.table([pa.array(key[spot]), pa.array(at[spot] + np.repeat(a, times)), pa.array(at[spot] + np.repeat(b, times)), pa.array(np.full(len(spot), named))], ["key", "a", "b", "named"])

    own = np.flatnonzero(~here)
    return pa.concat_tables([spread(np.repeat(same[here], count[here]), places[:, 0], places[:, 1], False), spread(same[own], t["name"].to_numpy()[own], np.zeros(len(own), np.int64), True)])


# ---------------------------------------------------------------- in Spark


def repeats(docs: DataFrame, folder: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, spans (a list of word ranges a to b, b excluded, that repeated windows cover) for rows of docs (key, text) that have any."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            w = C.words(b.column("text"))
            h, start, last = window_runs(w, window, gram)
            row = np.searchsorted(w.first, start, "right") - 1
            order = np.lexsort((h, row))
            h, row, windows = h[order], row[order], (last - start + 1)[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.concatenate([at, [len(h)]]))
            total = np.add.reduceat(windows, at) if len(at) else at
            yield pa.record_batch([pa.array(h[at].view(np.int64)), b.column("key").take(pa.array(row[at])), pa.array(times.astype(np.int32)), pa.array(total.astype(np.int32))], ["h", "key", "n", "windows"])

    runs = docs.mapInArrow(C.tidied(minimisers), "h long, key long, n int, windows int")
    counts = runs.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1")
    hot = F.col("total") > HOT
    # words that are sent to shards: a passage for each run, or for each window of hot minimisers
    words = F.when(hot, window * F.col("windows")).otherwise(F.col("windows") + (window - 1) * F.col("n"))
    wanted = runs.join(counts, "h").groupBy("key").agg(F.collect_list(F.struct("h", hot.alias("hot"))).alias("wanted"), F.sum("n").alias("n"), F.sum(words.cast("long")).alias("words"))
    wanted = C.staged(wanted, folder, "wanted", compression="zstd")
    sizes = wanted.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    shards = max(1, (sizes.words or 0) // SHARD_WORDS, min((sizes.n or 0) // 2000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            w = C.words(b.column("text"))
            h, start, last = window_runs(w, window, gram)
            row = np.searchsorted(w.first, start, "right") - 1
            lists = b.column("wanted")
            inner = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            named = C.mix(inner.field("h").to_numpy().view(np.uint64) ^ C.mix(owner.astype(np.uint64), 9), 8)
            hot = inner.field("hot").to_numpy(zero_copy_only=False)
            own = C.mix(h ^ C.mix(row.astype(np.uint64), 9), 8)
            order = np.argsort(named)
            at = np.minimum(np.searchsorted(named[order], own), max(len(named) - 1, 0))
            known = named[order][at] == own if len(named) else np.zeros(len(own), bool)
            is_hot = hot[order][at] & known if len(named) else known
            # passages of one window for frequent minimisers, else of the run
            many = np.where(is_hot, last - start + 1, 1) * known
            begin = np.repeat(start, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            stop = np.where(np.repeat(is_hot, many), begin + window, np.repeat(last, many) + window)
            name = C.span_hash(w, begin, stop)
            apart = np.repeat(is_hot, many)
            route = np.where(apart, C.mix(name, 13), C.mix(np.repeat(h, many), 12))
            where = np.repeat(row, many)
            key = b.column("key").to_numpy()[where]
            place = np.stack([key, begin - w.first[where]], axis=1)
            order = np.argsort(name, kind="stable")
            name = name[order]
            new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([new, [len(name)]]))
            pick = order[new]
            data = w.buf.tobytes()
            # a passage in one spelling: its words, parted by one space
            passage = [b" ".join([data[s:e] for s, e in zip(w.start[i:j].tolist(), w.end[i:j].tolist(), strict=True)]) if h_ else data[w.start[i] : w.end[j - 1]] for i, j, h_ in zip(begin[pick].tolist(), stop[pick].tolist(), apart[pick].tolist(), strict=True)]
            shard = (route[pick] % np.uint64(shards)).astype(np.int32)
            yield pa.record_batch([pa.array(shard), pa.array(apart[pick]), pa.array(name[new].view(np.int64)), pa.array(passage, pa.binary()), C.blobs(place[order].reshape(-1), 2 * np.concatenate([new, [len(name)]])), pa.array(times, pa.int64())], ["shard", "apart", "name", "passage", "places", "n"])

    sent = docs.join(wanted.select("key", "wanted"), "key").select("key", "text", "wanted").mapInArrow(C.tidied(cut), "shard int, apart boolean, name long, passage binary, places binary, n long")
    sent = C.staged(sent, folder, "passages", compression="zstd")
    # frequent windows are counted before they meet in a shard; a name stands for one passage, told apart by its bytes
    frequent = sent.where("apart").groupBy("shard", "name", "passage").agg(F.sum("n").alias("n")).select("shard", "name", "passage", F.lit(None).cast("binary").alias("places"), "n")
    given = sent.where("not apart").select("shard", "name", "passage", "places", "n").union(frequent)
    found = C.staged(given.groupBy("shard").applyInArrow(C.tidied_group(lambda t: search_shard(t, window)), "key long, a long, b long, named boolean"), folder, "found", compression="zstd")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of words: windows of one document that touch or overlap are one range."""
        for b in batches:
            place = C.raw(b.column("places"))[0].view(np.int64).reshape(-1, 2)
            key, at = place[np.lexsort((place[:, 1], place[:, 0]))].T
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[1:] > at[:-1] + window)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(key))[: len(first)] - 1
            yield pa.record_batch([pa.array(key[first]), pa.array(at[first]), pa.array(at[last] + window)], ["key", "a", "b"])

    names = C.staged(found.where("named").select(F.col("key").alias("name")).distinct(), folder, "names")
    if names.count() <= NAMES:  # the places then stay where they are, and windows of one document meet
        names = F.broadcast(names)
    again = sent.where("apart").select("name", "places").join(names, "name", "left_semi").select("places").mapInArrow(C.tidied(placed), "key long, a long, b long")
    spans = found.where("not named").select("key", "a", "b").union(again)
    return C.staged(spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), folder, "spans", compression="zstd")


def covered(w: C.Words, spans: pa.Array) -> np.ndarray:
    """Whether each word lies in a span of its text."""
    inner = spans.flatten()
    if isinstance(inner, pa.ChunkedArray):
        inner = inner.combine_chunks()
    counts = np.array([len(x) if x.is_valid else 0 for x in spans])
    base = np.repeat(w.first[:-1], counts)
    mark = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(mark, base + inner.field("a").to_numpy(), 1)
    np.add.at(mark, base + inner.field("b").to_numpy(), -1)
    return np.cumsum(mark[:-1]) > 0


def kept_texts(w: C.Words, gone: np.ndarray) -> list[bytes]:
    """Each text's other words, joined by one space."""
    data = w.buf.tobytes()
    keep = np.flatnonzero(~gone)
    part = [data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]
    at = np.searchsorted(keep, w.first).tolist()
    return [b" ".join(part[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def key_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with __key, a hash of these columns; equal rows share it, and so repeat each other."""
    return docs.withColumn("__key", F.xxhash64(*columns))


def remove_repeats(docs: DataFrame, folder: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """doc_id (or the columns to keep), n_words, n_removed, kept_text (the words that no repeated window covers, joined by one space) and
    kept_sha256 (its lowercase hexadecimal SHA-256); a prefix for these names keeps them apart from the columns to keep."""
    columns = keep_columns or [id_col]
    keyed = key_of(docs.select(*dict.fromkeys([*columns, text_col])), [id_col, text_col])
    spans = repeats(keyed.where(F.length(text_col) >= 2 * window - 1).select(F.col("__key").alias("key"), F.col(text_col).alias("text")), folder, window)
    rows = keyed.join(spans.withColumnRenamed("key", "__key").withColumnRenamed("spans", "__spans"), "__key", "left").select(*columns, F.col(text_col).alias("__text"), "__spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema]
    made = [prefix + name for name in ("n_words", "n_removed", "kept_text", "kept_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "__text"):
            w = C.words(b.column("__text"))
            gone = covered(w, b.column("__spans"))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[w.first[1:]] - total[w.first[:-1]]
            text = kept_texts(w, gone)
            sha = [hashlib.sha256(x).hexdigest() for x in text]
            yield pa.record_batch([*b.columns[: len(columns)], pa.array(np.diff(w.first)), pa.array(removed), pa.array([x.decode() for x in text], pa.string()), pa.array(sha, pa.string())], [*columns, *made])

    return rows.mapInArrow(C.tidied(run), ", ".join([*fields, *(f"`{name}` {kind}" for name, kind in zip(made, ("long", "long", "string", "string"), strict=True))]))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, p, sha256(array_to_string(list_slice(w, p, p + 34), ' ')) AS x FROM s),
again AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
hit AS (SELECT r, list(p) AS ps FROM h JOIN again USING (x) GROUP BY r),
gone AS (SELECT DISTINCT r, p + k AS p FROM (SELECT r, unnest(ps) AS p FROM hit), range(0, 35) AS t(k)),
word AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
