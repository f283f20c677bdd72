"""SentencePiece encoding and decoding with the N best segmentations.

A text is normalised by the model and cut where no piece can reach across: before a run of word marks that follows another
sign, and around line feeds if no longer piece holds one. The distinct parts of a batch are searched together, in numpy: their lattices
come from a tree of all pieces, forward Viterbi scores give the exact best score from the start to each position, and
a backward A* search from the end uses them as its heuristic. As that heuristic is exact, every open path leads to a
segmentation of just its estimate; so of a part's open paths only as many are kept as segmentations are still wanted, and they are settled
in the order of their score. The N best of the whole text combine those of its parts.

A segmentation's score is the sum of its pieces' scores in the model; a sign that no piece covers is one edge of the least
score less 10, written as byte pieces where the model has them, else as the unknown piece. Of equal scores the search prefers
longer last pieces. Null or empty text has no pieces and score 0; a text with one segmentation has no second. Decoding gives the normalised
text back, without the word mark that the model puts before it (a word mark that stood in the text itself comes back as a space).
Repeated rows return once each; an empty table gives no row. Nothing is kept from one batch of texts to the next but the model.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
#: Text bytes that are encoded together: the more, the fewer parts are searched twice.
ENCODE_BYTES = 1 << 22
#: Positions of the parts that are searched in lockstep; a longer part is taken alone.
CELLS = 1 << 17
EMPTY, NO_SIGN = np.uint64(2**64 - 1), 0x1FFFFF


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) of the ranges first[i]:first[i] + count[i], one after another."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(first - (np.cumsum(count) - count), count)


class Trie:
    """A tree of words, in arrays: an open-addressing table gives the child of (node, sign)."""

    def __init__(self, words: list[str]):
        nodes: dict[str, int] = {}
        for w in words:
            for k in range(1, len(w) + 1):
                nodes.setdefault(w[:k], len(nodes) + 1)
        key = np.fromiter((nodes.get(x[:-1], 0) << 21 | ord(x[-1]) for x in nodes), np.uint64, len(nodes))
        self.shift = np.uint64(64 - max(4, (4 * len(nodes)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.child = np.full(size, EMPTY), np.zeros(size, np.int32)
        left, slot = np.arange(len(key)), self.slot(key)
        while len(left):
            free = left[self.keys[slot[left]] == EMPTY]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.child[slot[put]] = key[put], put + 1
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) % size
        self.word = np.full(len(nodes) + 1, -1, np.int32)
        self.word[[nodes[w] for w in words]] = np.arange(len(words))

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The child of each node by each sign; 0 if there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | sign
        slot = self.slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.child[slot], 0)
        left = np.flatnonzero((seen != key) & (seen != EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (seen != EMPTY)]
        return out


class Found:
    """The n best segmentations of parts: score[i, r] of part i (-inf if it has fewer), and its ids at[i, r] of a list of lists."""

    def __init__(self, parts: int, n: int):
        self.score, self.at = np.full((parts, n), -np.inf), np.zeros((parts, n), np.int64)
        self.ids, self.sizes, self.lists = [], [], 0

    def add(self, part: np.ndarray, rank: np.ndarray, score: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.score[part, rank], self.at[part, rank] = score, self.lists + np.arange(len(part))
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.lists += len(sizes)

    def close(self) -> Found:
        self.ids = np.concatenate([*self.ids, np.zeros(0, np.uint32)]).astype(np.uint32)
        self.sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)]).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        return self


class Pieces:
    """A model's pieces, with encoding to the N best and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        size = m.vocab_size()
        text = [m.id_to_piece(i) for i in range(size)]
        self.byte = {int(text[i][1:-1], 16): i for i in range(size) if m.is_byte(i)}
        self.plain_ids = np.array([i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))], np.int64)
        words = [text[i] for i in self.plain_ids]
        self.scores = {text[i]: (m.get_score(int(i)), int(i)) for i in self.plain_ids.tolist()}
        self.trie = Trie(words)
        self.word_score = np.array([self.scores[w][0] for w in words])
        self.longest = max(map(len, words), default=1)
        self.unknown = float(self.word_score.min(initial=0.0)) - 10
        self.unknown_id = m.unk_id()
        raw = [text[i].replace(MARK, " ").encode() for i in range(size)]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        for i in range(size):
            if m.is_control(i):
                raw[i] = b""
        raw[self.unknown_id] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, size)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        crossing = any(MARK in p.lstrip(MARK) for p in words)
        line = any("\n" in p and len(p) > 1 for p in words)
        stop = "" if line else r"\n"
        self.parts = re.compile(r"(?s).+" if crossing else rf"{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" + ("" if line else r"|\n"))
        self.prefixed = m.normalize("x").startswith(MARK)

    def edges(self, signs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score, symbol) of all edges of the lattices of parts, by end, then start. Column i of signs holds part i; node
        p * len(size) + i is position p of part i. Symbols are words, and beyond them -1 - sign for a sign that no word covers."""
        m = len(size)
        flat = signs.reshape(-1)
        at = np.flatnonzero(flat != NO_SIGN)
        node, covered, found = np.zeros(len(at), np.int32), np.zeros(len(flat), bool), []
        every = at
        for k in range(self.longest):
            node = self.trie.step(node, flat[at + k * m])
            alive = node > 0
            at, node = at[alive], node[alive]
            word = self.trie.word[node]
            is_word = word >= 0
            found.append((at[is_word], at[is_word] + (k + 1) * m, word[is_word]))
            if k == 0:
                covered[at[is_word]] = True
            if not len(at):
                break
        bare = every[~covered[every]]
        found.append((bare, bare + m, -1 - flat[bare].astype(np.int64)))
        start, end, symbol = (np.concatenate([x[i] for x in reversed(found)]) for i in range(3))
        order = np.argsort(end, kind="stable")
        symbol = symbol[order]
        # reversed, so that of equal ends longer words come first; a bare sign is as long as a single one and never beside it
        return start[order], end[order], np.where(symbol >= 0, self.word_score[np.maximum(symbol, 0)], self.unknown), symbol

    def search(self, signs: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, rank, score, ids, ids in each) of the n best segmentations of each part, by Viterbi forward and A* backward."""
        m, levels = len(size), len(signs) - 1
        start, end, score, symbol = self.edges(signs, size)
        first = np.searchsorted(end, np.arange((levels + 1) * m + 1))
        best = np.full((levels + 1) * m, -np.inf)
        best[:m] = 0.0
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        of_level = np.searchsorted(end[heads], np.arange(levels + 2) * m)
        for p in range(1, levels + 1):
            a, b = of_level[p], of_level[p + 1]
            if a < b:
                low, high = heads[a], heads[b] if b < len(heads) else len(end)
                best[end[heads[a:b]]] = np.maximum.reduceat(best[start[low:high]] + score[low:high], heads[a:b] - low)
        # the open paths of all parts, best first within each; every round settles the best one of each
        part, at = np.arange(m), size * m + np.arange(m)
        lost, value, edge, up = np.zeros(m), best[at], np.full(m, -1), np.full(m, -1)
        done, settled, goals, base = np.zeros(m, np.int64), [], [], 0
        while len(part):
            top = np.ones(len(part), bool)
            top[1:] = part[1:] != part[:-1]
            t = np.flatnonzero(top)
            name = base + np.arange(len(t))
            settled.append((edge[t], up[t]))
            base += len(t)
            goal = at[t] < m
            g = t[goal]
            goals.append((part[g], done[part[g]].copy(), lost[g], name[goal]))
            done[part[g]] += 1
            x, parent = t[~goal], name[~goal]
            which, e = spread(first[at[x]], first[at[x] + 1] - first[at[x]])
            own = x[which]
            gone = lost[own] + score[e]
            rest = ~top
            part = np.concatenate([part[rest], part[own]])
            at = np.concatenate([at[rest], start[e]])
            lost = np.concatenate([lost[rest], gone])
            value = np.concatenate([value[rest], gone + best[start[e]]])
            edge, up = np.concatenate([edge[rest], e]), np.concatenate([up[rest], parent[which]])
            order = np.lexsort((at, -value, part))
            sorted_ = part[order]
            begin = np.searchsorted(sorted_, sorted_)
            order = order[np.arange(len(order)) - begin < n - done[sorted_]]
            part, at, lost, value, edge, up = part[order], at[order], lost[order], value[order], edge[order], up[order]
        found, rank, total, chain = (np.concatenate([x[i] for x in goals]) for i in range(4))
        edge, up = (np.concatenate([x[i] for x in settled]) for i in range(2))
        owner, names, symbols = np.arange(len(found)), [], []
        while True:
            e = edge[chain]
            more = e >= 0
            if not more.any():
                break
            owner, chain, e = owner[more], chain[more], e[more]
            names.append(owner)
            symbols.append(symbol[e])
            chain = up[chain]
        owner, symbols = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, symbols))
        order = np.argsort(owner, kind="stable")
        return found, rank, total, *self.expand(owner[order], symbols[order], len(found))

    def expand(self, owner: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each of n owners): a word has one id, a sign that no word covers the pieces of its bytes or the unknown one."""
        ids = self.plain_ids[np.maximum(symbols, 0)] if len(self.plain_ids) else np.zeros(len(symbols), np.int64)
        bare = np.flatnonzero(symbols < 0)
        if not len(bare):
            return ids, np.bincount(owner, minlength=n)
        signs, which = np.unique(-1 - symbols[bare], return_inverse=True)
        spelled = [[self.byte.get(b, self.unknown_id) for b in chr(s).encode("utf-8", "replace")] if self.byte else [self.unknown_id] for s in signs.tolist()]
        table = np.array([i for x in spelled for i in x])
        width = np.fromiter(map(len, spelled), np.int64, len(spelled))
        size = np.ones(len(symbols), np.int64)
        size[bare] = width[which]
        place = np.repeat(np.arange(len(symbols)), size)
        out = ids[place]
        _, index = spread((np.cumsum(width) - width)[which], width[which])
        out[symbols[place] < 0] = table[index]
        return out, np.bincount(owner[place], minlength=n)

    def best(self, parts: list[str], n: int) -> Found:
        """The n best segmentations of each part; parts of like length are searched together."""
        found = Found(len(parts), n)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(size, kind="stable")[::-1]
        at = 0
        while at < len(order):
            longest = int(size[order[at]])
            take = order[at : at + max(1, CELLS // (longest + 1))]
            signs = np.full((longest + 1, len(take)), NO_SIGN, np.uint64)
            column, row = spread(np.zeros(len(take), np.int64), size[take])
            signs[row, column] = np.frombuffer("".join([parts[i] for i in take.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            part, *got = self.search(signs, size[take], n)
            found.add(take[part], *got)
            at += len(take)
        return found.close()

    def encode(self, texts: list[str | None], n: int = 2) -> list[list[tuple[float, np.ndarray]]]:
        """The n best (score, ids) of each text, best first."""
        normal = [self.model.normalize(t or "") for t in texts]
        cut = [self.parts.findall(x) for x in normal]
        stop = np.cumsum([0, *map(len, cut)])
        coded = pa.array([x for parts in cut for x in parts], pa.large_string()).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        found = self.best(coded.dictionary.to_pylist(), n)
        score = np.bincount(np.repeat(np.arange(len(texts)), np.diff(stop)), weights=found.score[word, 0], minlength=len(texts)) if len(word) else np.zeros(len(texts))
        loss = found.score[:, :1] - found.score
        picks = [least_sums(loss[word[a:b]], n) for a, b in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
        out: list[list[tuple[float, np.ndarray]]] = [[] for _ in texts]
        for k in range(n):
            use = found.at[word, 0]
            for a, p in zip(stop[:-1].tolist(), picks, strict=True):
                if k < len(p):
                    for i, r in p[k][1].items():
                        use[a + i] = found.at[word[a + i], r]
            sizes = found.sizes[use]
            ids = found.ids[spread(found.first[use], sizes)[1]]
            before = np.concatenate([[0], np.cumsum(sizes)])[stop]
            for i, p in enumerate(picks):
                if k < len(p):
                    out[i].append((float(score[i]) - p[k][0], ids[before[i] : before[i + 1]]))
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of several lists of ids, list i being ids[first[i]:first[i + 1]]."""
        size = self.raw_size[ids]
        data = self.raw[spread(self.raw_first[ids], size)[1]].tobytes()
        end = np.concatenate([[0], np.cumsum(size)])[first].tolist()
        return [self.unprefixed(data[a:b].decode("utf-8", "replace")) for a, b in zip(end[:-1], end[1:], strict=True)]

    def unprefixed(self, text: str) -> str:
        return text[1:] if self.prefixed and text.startswith(" ") else text

    def plain(self, text: str | None) -> str:
        """What decoding should give back."""
        return self.unprefixed(self.model.normalize(text or "").replace(MARK, " "))


def least_sums(loss: np.ndarray, n: int) -> list[tuple[float, dict[int, int]]]:
    """The n least sums of one column for each row, as (sum, {row: column} where it is not the first); column 0 is all zeros."""
    tops: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    if n > 1 and len(loss):
        second = loss[:, 1]
        # only rows with the smallest seconds can differ in one of the n least
        few = [int(np.argmin(second))] if n == 2 else np.argsort(second, kind="stable")[: n - 1].tolist()
        for i in few:
            row = loss[i].tolist()
            tops = heapq.nsmallest(n, [(lost + x, {**picked, i: r} if r else picked) for lost, picked in tops for r, x in enumerate(row) if x < np.inf], key=lambda t: t[0])
    return tops


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, n: int = 2, with_nbest: bool = False) -> DataFrame:
    """doc_id; n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and score of the best segmentation; second_score
    (null if there is none), decodes (whether decoding the best ids gives the normalised text), nbest_scores and nbest_crc32 of the n best;
    on demand the best's ids, or all nbest_ids."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kinds = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "score": pa.float64(), "second_score": pa.float64(), "decodes": pa.bool_(), "nbest_scores": pa.list_(pa.float64()), "nbest_crc32": pa.list_(pa.int64())}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int64())
    if with_nbest:
        kinds["nbest_ids"] = pa.list_(pa.list_(pa.int64()))
    sql = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}

    def sql_type(kind: pa.DataType) -> str:
        return f"array<{sql_type(kind.value_type)}>" if pa.types.is_list(kind) else sql[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in C.slices(batches, "__text", ENCODE_BYTES):
            texts = b.column("__text").to_pylist()
            got = p.encode(texts, n)
            sizes = [len(x[0][1]) for x in got]
            ids, first = np.concatenate([np.zeros(0, np.uint32), *[x[0][1] for x in got]]), np.cumsum([0, *sizes])
            back = p.decode(ids, first)
            crc = [[zlib.crc32(y.astype("<u4").tobytes()) for _, y in x] for x in got]
            values = [sizes, [x[0] for x in crc], [x[0][0] for x in got], [x[1][0] if len(x) > 1 else None for x in got], [a == p.plain(t) for a, t in zip(back, texts, strict=True)], [[s for s, _ in x] for x in got], crc]
            if with_ids:
                values.append(C.lists(ids.astype(np.int64), first, pa.int64()))
            if with_nbest:
                inner = [y for x in got for _, y in x]
                inner = C.lists(np.concatenate([np.zeros(0, np.int64), *inner]).astype(np.int64), np.cumsum([0, *map(len, inner)]), pa.int64())
                values.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), inner))
            yield pa.record_batch([b.column("doc_id"), *(v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds.values(), strict=True))], ["doc_id", *kinds])
            del got, ids, back, values

    return rows.mapInArrow(C.tidied(run), ", ".join([f"doc_id {dict(docs.dtypes)[id_col]}", *(f"{name} {sql_type(kind)}" for name, kind in kinds.items())]))


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            lists = [np.zeros(0, np.int64) if x is None else np.array(x, np.int64) for x in b.column("ids").to_pylist()]
            text = p.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.cumsum([0, *map(len, lists)]))
            yield pa.record_batch([b.column("doc_id"), pa.array(text, pa.string(), mask=b.column("ids").is_null().to_numpy(zero_copy_only=False))], ["doc_id", "text"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(C.tidied(run), f"doc_id {dict(coded.dtypes)[id_col]}, text string")
