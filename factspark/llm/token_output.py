"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

The more often an id occurs in the whole corpus, the smaller its rank, so most ids take one byte. Four ids share a
control byte with two bits for each (bytes in the code, less one); controls and codes are stored apart, so a block is
decoded by looking the control bytes up in a table of 256 x 4 lengths, without a loop over ids.

Rows come in ascending (id, text) order. Null text counts as empty and gives the end id alone; a null id sorts first and
comes back null; repeated rows are separate documents; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"FSTOK001"
HEAD = "<QQQ"
#: Ids in a block before it is written; a longer document makes a longer block.
BLOCK_IDS = 1 << 20
#: Text bytes that are encoded together: the more, the fewer words are looked up twice.
ENCODE_BYTES = 1 << 23
#: Words whose ids a worker keeps.
MEMO = 600_000
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray, sizes: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """(control bytes, code bytes) of the ranks below 2 ** 32 of documents with so many ids each (by default of one); a document's controls begin a byte."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = np.array([len(ranks)]) if sizes is None else sizes
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    slots = (sizes + 3) // 4 * 4
    shift = np.cumsum(slots) - slots - (np.cumsum(sizes) - sizes)
    padded = np.zeros(int(slots.sum()), np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(shift, sizes)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, codes: bytes, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents with so many ids each, whose controls and codes follow one another."""
    slots = (sizes + 3) // 4 * 4
    within = np.arange(slots.sum()) - np.repeat(np.cumsum(slots) - slots, slots)
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[within < np.repeat(sizes, slots)]
    end = np.cumsum(size)
    data = np.concatenate([np.frombuffer(codes, np.uint8), np.zeros(4, np.uint8)])
    at, out = end - size, np.zeros(len(size), np.uint32)
    for i in range(4):
        out |= np.where(size > i, data[at + i], 0).astype(np.uint32) << np.uint32(8 * i)
    return out


#: Signs that a normaliser may change beyond their case, or that might spell a special token.
UNSAFE = re.compile(r"[^\x00-\u012F\u0131-\u017F]|<\|")
#: Punctuation between a Latin letter and the word's end; no apostrophe, which can start a token of letters. It begins with the signs
#: and looks back from them, so a search passes letters over quickly.
TRAILING = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-z\u00DF-\u00F6\u00F8-\u017F].)[!-&(-/:-@\[-`{-~]*(?=[ \n]|\Z)")
#: Latin letters alone; a word of them is plain if it has no capital.
PLAIN = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u012F\u0131-\u017F]+")


class WordEncoder:
    """Encodes texts with a tokenizer that never joins across a space or line feed, word by word through a memo.

    Where the tokenizer's file folds case, parts letters from punctuation and marks word ends, a Latin text is folded and cut there first, and
    the ids of plain words are found by the tokenizer's own merges, many words in one call; all else goes through it as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_space(spec)
        self.memo: dict[str, bytes] = {"": b""}
        self.merges = None
        if self.by_word and splits_at_punctuation(spec):
            ends = [i for token, i in spec["model"]["vocab"].items() if token.endswith(spec["model"]["end_of_word_suffix"])]
            self.is_end = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.is_end[ends] = True
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}
            self.letters = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}

    def whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> None:
        """Puts these words' ids into the memo."""
        if self.merges is None:
            self.memo.update(zip(missing, self.whole(missing), strict=True))
            return
        plain = [w for w in missing if PLAIN.fullmatch(w) and w == w.lower()]
        other = list(set(missing).difference(plain))
        self.memo.update(zip(other, self.whole(other), strict=True))
        if plain:
            plain.sort(key=str.isascii)
            at = sum(not w.isascii() for w in plain)
            joined = " ".join(plain[:at]).translate(self.letters) + " " + " ".join(plain[at:])
            ids = np.array(self.merges.encode(joined, add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
            data, starts = ids.tobytes(), [0, *ends.tolist()]
            self.memo.update((w, data[i:j]) for w, i, j in zip(plain, starts[:-1], starts[1:], strict=True))

    def cut(self, text: str) -> str:
        """The text with its words parted by spaces alone."""
        if self.merges is not None and is_safe(text):
            text = TRAILING.sub(r" \g<0>", text.lower())
        return text.replace("\n", " ")

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has the ids first[i]:first[i + 1], the last of them end_id. Words are told apart once for all texts."""
        end = struct.pack("<I", end_id)
        if not self.by_word:
            coded = [x + end for x in self.whole(texts)]
            return np.frombuffer(b"".join(coded), "<u4"), np.cumsum([0, *map(len, coded)]) // 4
        if len(self.memo) > MEMO:
            self.memo = {"": b""}
        split = pc.split_pattern(pa.array([self.cut(x) for x in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        for part in C.chunks((w for w in known if w not in self.memo), 20_000):
            self.learn(part)
        parts = [self.memo[w] for w in known] + [end]
        ids = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        stop = np.cumsum(pc.list_value_length(split).to_numpy())
        word = np.insert(coded.indices.to_numpy(), stop, len(known))
        n = size[word]
        after = np.cumsum(n)
        # a text is below 2 GB, and an id takes a byte of it or more
        place = np.repeat(((np.cumsum(size) - size)[word] - (after - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
        return ids[place], np.concatenate([[0], after[stop + np.arange(len(stop))]])


def is_safe(text: str) -> bool:
    """Whether nothing in it is UNSAFE; most texts are Latin-1, which is told at once."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not UNSAFE.search(text)
    return "<|" not in text


def splits_at_space(spec: dict) -> bool:
    """Whether the tokenizer's file says that space and line feed always part tokens and leave no trace."""
    normal, before = json.dumps(spec.get("normalizer")), json.dumps(spec.get("pre_tokenizer"))
    removes = '"behavior": "Removed"' in before and '"invert": true' in before
    spaces = any(" " in x["content"] or x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", []))
    return removes and not spaces and '"Prepend"' not in normal and '"add_prefix_space": true' not in before


def splits_at_punctuation(spec: dict) -> bool:
    """Whether it lowers case, cuts runs of letters from runs of other signs, and ends each word's last token with a suffix."""
    model, normal, before = spec["model"], json.dumps(spec.get("normalizer")), json.dumps(spec.get("pre_tokenizer"))
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    byte_level = '"type": "ByteLevel", "add_prefix_space": false' in before and '"use_regex": false' in before
    runs = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in before
    return bool(model.get("type") == "BPE" and model.get("end_of_word_suffix") and kinds == ["NFC", "Replace", "Lowercase"] and '"Regex": "\\\\s+"' in normal and byte_level and runs)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes folder/ranks.bin (ids by falling count, then by id, as <u4) and folder/*.tok; returns the manifest: shard, path,
    n_docs, n_ids, in ascending order of documents. The ranks come from counts over all documents; their number is
    bounded by the tokenizer's vocabulary."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    width = id_width(tokenizer, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in C.slices(batches, "text", ENCODE_BYTES):
            ids, first = enc.encode([x or "" for x in b.column("text").to_pylist()], end_id)
            yield pa.record_batch([b.column("id"), b.column("tie"), C.blobs(ids.astype(width), first)], ["id", "tie", "ids"])

    coded = C.staged(docs.mapInArrow(C.tidied(encode), "id long, tie long, ids binary"), folder, "ids", compression="zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(C.raw(b.column("ids"))[0].view(width), minlength=len(total))
            got[: len(total)] += total
            total = got
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    counts = coded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.token for r in sorted(counts, key=lambda r: (-r.n, r.token))], "<u4")
    file = C.AtomicFile(f"{folder}/ranks.bin")
    file.write(by_rank.tobytes())
    file.close()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, n_docs, n_ids = TaskContext.get().partitionId(), None, 0, 0
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        for b in C.slices(batches, "ids", BLOCK_IDS * np.dtype(width).itemsize):
            if out is None:
                out = C.AtomicFile(path := f"{folder}/{shard:06d}.tok")
                out.write(MAGIC)
            ids, first = C.raw(b.column("ids"))
            sizes = np.diff(first) // np.dtype(width).itemsize
            control, codes = pack(rank[ids.view(width)], sizes)
            out.write(struct.pack(HEAD, len(sizes), sizes.sum(), len(codes)))
            out.write(np.array(b.column("id").fill_null(0).to_numpy(), "<i8").tobytes())
            out.write(np.array(b.column("id").is_valid().to_numpy(zero_copy_only=False), np.uint8).tobytes())
            out.write(sizes.astype("<i8").tobytes())
            out.write(control)
            out.write(codes)
            n_docs, n_ids = n_docs + len(sizes), n_ids + int(sizes.sum())
        if out is not None:
            out.close()
            yield pa.record_batch([[shard], [path], [n_docs], [n_ids]], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # ranks and codes are made behind the exchange: Spark reads what is in front of it twice, the first time for the ranges' bounds
    ordered = coded.repartitionByRange("id").sortWithinPartitions("id", "tie")
    manifest = C.staged(ordered.mapInArrow(C.tidied(write), "shard int, path string, n_docs long, n_ids long"), folder, "manifest")
    C.drop(docs.sparkSession, f"{folder}/ids")
    return manifest


def id_width(tokenizer: str, end_id: int) -> str:
    """The narrowest type that holds all ids, for what is stored on the way."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else "<u4"


def blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether each is valid, token counts, ranks of all tokens) of each block of a file."""
    fs, at = C.filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        while head := f.read(struct.calcsize(HEAD)):
            n_docs, _, n_codes = struct.unpack(HEAD, head)
            ids, valid = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(n_docs), np.uint8).astype(bool)
            sizes = np.frombuffer(f.read(8 * n_docs), "<i8")
            yield ids, valid, sizes, unpack(f.read(int(((sizes + 3) // 4).sum())), f.read(n_codes), sizes)


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers), and on demand the ids."""
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                if by_rank is None:
                    fs, at = C.filesystem(f"{folder}/ranks.bin")
                    with fs.open_input_stream(at, compression=None) as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                for ids, valid, sizes, ranks in blocks(path):
                    tokens, end = by_rank[ranks], np.cumsum(sizes)
                    crc = [zlib.crc32(tokens[e - n : e].tobytes()) for e, n in zip(end, sizes, strict=True)]
                    columns = [pa.array(ids, pa.int64(), mask=~valid), start + end - sizes, sizes, crc]
                    if with_ids:
                        columns.append(C.lists(tokens.astype(np.int64), np.concatenate([[0], end]), pa.int64()))
                    yield pa.record_batch([pa.array(x, t.type) if not isinstance(x, pa.Array) else x for x, t in zip(columns, schema, strict=True)], schema=schema)
                    start += len(tokens)

    return files.mapInArrow(C.tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
