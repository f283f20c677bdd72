"""How often tokens of two tokenizers end together, and how well each document's tokens follow those pairs.

Each text with a space before it is cut by a byte-level BPE (A) and a piece model (B, which adds the space itself). Offsets where tokens of both end cut the
text into groups of A ids and B ids; every A and B token whose byte ranges end together are a link. An id pair's count is how many links of the corpus hold it.

Texts are cut into parts before a space that follows another byte than a space and is followed by a sign that no tokenizer takes for white space. No token of
either crosses such a cut (A's pattern ends there; B has no piece with a space mark behind another sign, which is checked), so each distinct
part of a batch is encoded once, and groups never cross parts.

Groups are interned: a batch of STEP bytes gives its distinct groups with their frequencies, Spark adds them up by group, links are expanded once for each distinct
group and multiplied by its frequency, and the counts are joined back by id pair, then by group. A batch gets one row for each of its distinct groups, and its documents are
summed up from those, so no exchange sends a row for each token.

A text that is null or empty, or that either tokenizer does not give back byte by byte (B takes U+2581 for a space), has no tokens: zeros, and an empty hash. Special
tokens' strings are plain text. Rows with null or repeated ids are rows of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

STEP = 1 << 21
#: Bytes of parts that are encoded as one text.
TOGETHER = 1 << 12
#: First bytes of UTF-8 sequences that may be white space to some tokenizer.
UNSURE = (0xC2, 0xE1, 0xE2, 0xE3)
FOLLOWS = np.array([0x21 <= b <= 0x7E or (b >= 0xC3 and b not in UNSURE) for b in range(256)])
COUNTS = ("n_links", "n_best", "count_sum")


def byte_signs() -> dict[str, int]:
    """The sign that byte-level BPE writes for each byte: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def large_texts(first: np.ndarray, data: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data))


class Table:
    """Byte strings by number, in one array."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[C.spread(self.begin[ids], self.size[ids])[1]]


class Pair:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, byte_bpe: str, piece_model: str):
        # a worker's threads would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        signs = byte_signs()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.whole = any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.a_table, self.b_table = Table(self.a_bytes), Table(self.b_bytes)
        # an id in decimal, with room for the sign behind it
        self.decimal = Table([b"%d " % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))])

    def cut(self, texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The parts of all texts, without the space that each begins with, and how many each text has."""
        buf, off = C.raw(texts)
        size = np.diff(off)
        at = np.flatnonzero(buf == 32) if not self.whole else np.zeros(0, np.int64)
        inside = np.zeros(len(buf) + 1, bool)
        inside[off[:-1][size > 0]] = True  # the first byte of a text follows the added space
        at = at[(at > 0) & (at + 1 < len(buf)) & ~inside[at]]
        at = at[(buf[at - 1] != 32) & FOLLOWS[buf[at + 1]] & ~inside[at + 1]]
        keep = np.ones(len(buf), bool)
        keep[at] = False
        text_start = off[:-1][size > 0]
        start = np.sort(np.concatenate([text_start, at + 1]))
        # an offset in the kept bytes is smaller by the cuts before it
        first = np.append(start - np.searchsorted(at, start), len(buf) - len(at))
        return large_texts(first, buf[keep]), np.diff(np.searchsorted(start, off))

    def coded(self, texts: pa.Array, first: np.ndarray, size: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For A and for B, the ids of all texts, where in them each part's begin, and how many those are; and whether both give a text's bytes back,
        with tokens that end where its parts end. Texts and parts begin with a space. first: each text's first part, and the number of parts. size: the parts' bytes."""
        found, same = [], np.ones(len(texts), bool)
        spelled = texts.to_pylist()
        buf, off = C.raw(texts)
        ends, text = np.cumsum(size), np.repeat(np.arange(len(texts)), np.diff(first))
        for side, table in enumerate((self.a_table, self.b_table)):
            # B adds the space itself
            ids = self.b.encode([t[1:] for t in spelled], num_threads=1) if side else [x.ids for x in self.a.encode_batch_fast(spelled, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat, stop = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum())), np.append(0, np.cumsum(n))
            at = np.append(0, np.cumsum(table.size[flat]))
            whole = np.diff(at[stop]) == np.diff(off)
            kept = np.flatnonzero(whole)
            got, want = (table.joined(flat), buf) if whole.all() else (table.joined(flat[np.repeat(whole, n)]), buf[np.repeat(whole, np.diff(off))])
            unlike = np.flatnonzero(got != want)
            whole[kept[np.searchsorted(np.cumsum(np.diff(off)[kept]), unlike, "right")]] = False
            due = ends - (off[:-1] - at[stop[:-1]])[text]
            place = np.minimum(np.searchsorted(at, due), len(flat))
            whole[text[at[place] != due]] = False
            start = np.append(0, place)[:-1]
            start[first[:-1]] = stop[:-1]
            found.append((flat, start, place - start))
            same &= whole
        return found, same

    def encoded(self, parts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of all parts, and how many each part has; none where one of them does not give a part's bytes back. Parts are encoded
        together, up to TOGETHER bytes, where the cuts between them are as in a text; those of a text that does not come back are encoded again one by one."""
        buf, off = C.raw(parts)
        n, size = len(parts), np.diff(off) + 1
        at = np.append(0, np.cumsum(size))
        spaced, inside = np.full(at[-1], 32, np.uint8), np.ones(at[-1], bool)
        inside[at[:-1]] = False
        spaced[inside] = buf
        # a part that may follow another one, and be followed
        plain = np.zeros(n, bool)
        if not self.whole:
            plain[size > 1] = FOLLOWS[spaced[at[:-1][size > 1] + 1]]
            plain &= spaced[at[1:] - 1] != 32
        begins = np.ones(n, bool)
        begins[1:] = ~(plain[1:] & plain[:-1]) | (np.diff(at[:-1] // TOGETHER) > 0)
        first = np.append(np.flatnonzero(begins), n)
        found, same = self.coded(large_texts(at[first], spaced), first, size)
        again = np.flatnonzero(~np.repeat(same, np.diff(first)))
        if len(again):
            alone, same = self.coded(large_texts(np.append(0, np.cumsum(size[again])), spaced[C.spread(at[again], size[again])[1]]), np.arange(len(again) + 1), size[again])
            for k, ((ids, start, count), (more, more_start, more_count)) in enumerate(zip(found, alone, strict=True)):
                start[again], count[again] = len(ids) + more_start, np.where(same, more_count, 0)
                found[k] = np.append(ids, more)[C.spread(start, count)[1]], start, count
        return [x[0] for x in found], [x[2] for x in found]

    def groups(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """All groups of all parts as texts like a1,a2|b1; how many groups each part has, and its numbers of A and B tokens."""
        (a, b), (a_n, b_n) = self.encoded(parts)
        a_end, b_end = np.cumsum(self.a_table.size[a]), np.cumsum(self.b_table.size[b])
        cuts = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end] if len(b_end) else b_end
        cuts = cuts[np.diff(cuts, prepend=-1) > 0]
        a_stop, b_stop = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
        # in a group A's tokens stand before B's
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.append(0, b_stop)[a_group]] = a
        ids[np.arange(len(b)) + a_stop[b_group]] = b
        after[a_stop + np.append(0, b_stop)[:-1] - 1] = ord("|")
        after[a_stop + b_stop - 1] = ord(";")
        data, end = self.decimal.joined(ids), np.cumsum(self.decimal.size[ids])
        data[end - 1] = after
        first = np.append(0, end[a_stop + b_stop - 1])
        last = np.append(0, a_end)[np.cumsum(a_n)]
        n_groups = np.diff(np.append(0, np.searchsorted(cuts, last, "right")))
        return large_texts(first, data), n_groups, a_n, b_n

    def links(self, group: str) -> list[tuple[int, int, int]]:
        """(A id, B id, times) of all tokens of a group (a1,a2|b1;) whose byte ranges end together."""
        a, b = (list(map(int, side.split(","))) for side in group.rstrip(";").split("|"))
        a_end, b_end = np.cumsum(self.a_table.size[a]).tolist(), np.cumsum(self.b_table.size[b]).tolist()
        at: dict[int, list[int]] = {}
        for i, e in zip(a, a_end, strict=True):
            at.setdefault(e, []).append(i)
        times: dict[tuple[int, int], int] = {}
        for j, e in zip(b, b_end, strict=True):
            for i in at.get(e, ()):
                times[i, j] = times.get((i, j), 0) + 1
        return [(i, j, n) for (i, j), n in times.items()]


@functools.lru_cache(maxsize=2)
def pair(byte_bpe: str, piece_model: str) -> Pair:
    return Pair(byte_bpe, piece_model)


DOCUMENT = "batch long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, held array<int>, times array<int>, names array<string>, counts array<long>"


def aligned_batch(p: Pair, number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """A row for each text, with which of the batch's groups it holds how often; and a last row with those groups and their frequencies."""
    n = len(texts)
    parts, n_parts = p.cut(texts)
    coded = parts.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled, size, a_n, b_n = p.groups(coded.dictionary)
    row = np.repeat(np.arange(n), n_parts)
    ok = (n_parts > 0) & (np.bincount(row, a_n[which] == 0, minlength=n) == 0)
    which, row = which[ok[row]], row[ok[row]]
    named = spelled.dictionary_encode()
    local, n_names = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(named.dictionary))
    begin = np.cumsum(size) - size
    part, at = C.spread(begin[which], size[which])
    key, times = np.unique(row[part] * n_names + local[at], return_counts=True)
    held, bounds = key % n_names, np.searchsorted(key, np.arange(n + 1) * n_names)
    frequency = np.bincount(held, times, minlength=n_names).astype(np.int64)
    some = np.flatnonzero(frequency)  # not those of parts that only texts without tokens have
    held = np.searchsorted(some, held)
    # a text's groups in order, as one text
    data, first = C.raw(spelled)
    written = np.append(0, np.cumsum(np.bincount(row, (first[begin + size] - first[begin])[which], minlength=n).astype(np.int64)))
    data = data[C.spread(first[begin][which], (first[begin + size] - first[begin])[which])[1]]
    hashes = [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in itertools.pairwise(written.tolist())]
    total = [np.bincount(row, x[which], minlength=n).astype(np.int64) for x in (a_n, b_n, size)]
    none = [None] * n
    columns = [
        pa.array([number] * (n + 1), pa.int64()), pa.array([*ids.to_pylist(), None], pa.int64()), *(pa.array([*x.tolist(), None], pa.int64()) for x in total), pa.array([*hashes, None], pa.string()),
        pa.concat_arrays([C.lists(held, bounds, pa.int32()), pa.array([None], pa.list_(pa.int32()))]), pa.concat_arrays([C.lists(times, bounds, pa.int32()), pa.array([None], pa.list_(pa.int32()))]),
        pa.array([*none, named.dictionary.take(pa.array(some)).to_pylist()], pa.list_(pa.string())), pa.array([*none, frequency[some].tolist()], pa.list_(pa.int64())),
    ]
    return pa.record_batch(columns, ["batch", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "held", "times", "names", "counts"])


def sums(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Each document's sums over its groups: how often it holds one times what the group counts."""
    held, times = docs["held"].combine_chunks(), docs["times"].combine_chunks().flatten().to_numpy()
    end = np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))
    begin = np.append(0, end)[:-1]
    place, order = held.flatten().to_numpy(), np.argsort(known["place"].to_numpy())
    at = order[np.searchsorted(known["place"].to_numpy()[order], place)] if len(place) else place
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    for name in COUNTS:
        total = np.append(0, np.cumsum(known[name].to_numpy()[at] * times)) if len(at) else np.zeros(1, np.int64)
        out = out.append_column(name, pa.array(total[end] - total[begin], pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, byte_bpe: str, piece_model: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row. The table of id pairs with their counts stays in folder/pairs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, task = pair(byte_bpe, piece_model), TaskContext.get().partitionId()
        for k, b in enumerate(C.slices(batches, "text", STEP)):
            yield aligned_batch(p, task << 32 | k, b.column("doc_id"), b.column("text"))
            C.give_back()  # the arrays of the next batch are as large

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(byte_bpe, piece_model)
        for b in batches:
            found = [(g, *link, n) for g, n in zip(b.column("name").to_pylist(), b.column("n").to_pylist(), strict=True) for link in p.links(g)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["name", "a", "b", "times", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = C.staged(rows.mapInArrow(C.tidied(encode), DOCUMENT), folder, "documents", compression="zstd")
    used = coded.where("names is not null").select("batch", F.posexplode(F.arrays_zip("names", "counts")).alias("place", "g")).select("batch", "place", F.col("g.names").alias("name"), F.col("g.counts").alias("n"))
    groups = used.groupBy("name").agg(F.sum("n").alias("n"))
    links = C.staged(groups.mapInArrow(C.tidied(expand), "name string, a int, b int, times long, n long"), folder, "links", compression="zstd")
    pairs = links.groupBy("a", "b").agg(F.sum(F.col("times") * F.col("n")).alias("count"), F.count("*").alias("groups"))
    # a B id meets no more A ids than there are
    pairs = C.staged(pairs.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b"))), folder, "pairs", compression="zstd")
    n = links.count()
    told = C.join_frequent_apart(links, pairs, ["a", "b"], pairs.where(F.col("groups") >= C.FREQUENT * n))
    stats = told.groupBy("name").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    known = used.select(F.col("batch").alias("of"), "place", "name").join(stats, "name").select("of", "place", *COUNTS)
    done = coded.where("names is null").drop("names", "counts").groupBy("batch").cogroup(known.groupBy("of"))
    return done.applyInArrow(C.tidied_pair(sums), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
