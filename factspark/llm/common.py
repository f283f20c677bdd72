"""What the text operators share: a shared work folder, Arrow batches cut by bytes, and word hashing in numpy.

A word is a run of bytes other than space and \\x09-\\x0D, unchanged. Hashes are unsigned 64-bit numbers; they are
computed for all words of a batch at once, without a Python loop over words.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that a kernel works on at once; a longer document is taken alone.
STEP_BYTES = 1 << 21


# ---------------------------------------------------------------- shared folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; only where that is unset on a single machine, as in tests, below a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "factspark-work")
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: Work folders of this session, oldest first.
_made: list[str] = []


@contextmanager
def dropped_after(spark: SparkSession):
    """Deletes the work folders that are made inside, when it ends."""
    before = len(_made)
    yield
    while len(_made) > before:
        drop(spark, _made.pop())


def staged(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """df written as Parquet below folder and read again: cuts the lineage, and outlives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in any store that Spark's JVM can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key is frequent if it holds more than this share of the rows that are joined by it; so there are at most 1000 such keys.
FREQUENT = 0.001


def join_frequent_apart(left: DataFrame, right: DataFrame, keys: list[str], frequent: DataFrame) -> DataFrame:
    """Inner join of left with right, which has a row for each key. frequent: right's rows whose keys are frequent in left (see FREQUENT, which
    bounds them); only those are broadcast, so that no exchange sends a frequent key's rows to one task."""
    apart = left.join(F.broadcast(frequent), keys)
    rest = left.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    return apart.unionByName(rest.join(right, keys))


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI, for use in executors."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def parquet_batches(folder: str, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """All rows of a folder of Parquet files, read in a task, in batches."""
    fs, at = filesystem(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows)


class AtomicFile:
    """A file that appears under its name only when it is whole, so a retried or doubled task does no harm."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


# ---------------------------------------------------------------- Arrow batches


def tidied(kernel):
    """The kernel of a mapInArrow, after whose last batch the worker gives freed memory back: Spark keeps workers for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def tidied_group(kernel):
    """The same for the kernel of an applyInArrow, after each group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return kernel(table)
        finally:
            give_back()

    return run


def tidied_pair(kernel):
    """The same for the kernel of a cogrouped applyInArrow."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return kernel(left, right)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns freed memory to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most step bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + step, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (and the last ends); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array; list i has values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, place) of all elements of lists that begin so and are so long."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(begin - (np.cumsum(size) - size), size)


def blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary array; value i has the bytes of values[first[i]:first[i + 1]]."""
    data = np.ascontiguousarray(values)
    off = (np.asarray(first, np.int64) * data.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)]).cast(pa.binary())


# ---------------------------------------------------------------- words and hashes

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits separates, for bags of bare words; letters are folded to lower case.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

P = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + U64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


#: A value for each byte at each of a word's first places; those of later places are computed.
PLACES = 64
_values: list[np.ndarray] = []


def byte_values(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """An independent value for each (byte, place): tabulation, so no structure of a text makes two words alike."""
    if not _values:
        _values.append(mix(np.arange(PLACES * 256, dtype=U64), 17))
    out = _values[0][np.minimum(place, PLACES - 1) * 256 + byte]
    late = np.flatnonzero(place >= PLACES)
    if len(late):
        out[late] = mix(place[late].astype(U64) * U64(256) + byte[late].astype(U64), 17)
    return out


@dataclass
class Words:
    """Words of several texts: byte range of each, hash of each, and first[i]:first[i + 1] those of text i."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spelled(self) -> pa.LargeBinaryArray:
        """The words themselves."""
        size = self.end - self.start
        off = np.concatenate([[0], np.cumsum(size)])
        data = self.buf[np.arange(off[-1]) + np.repeat(self.start - off[:-1], size)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])


def words(texts: pa.Array, separators: np.ndarray = SPACE, fold: bool = False) -> Words:
    buf, off = raw(texts)
    if fold:
        buf = LOWER[buf]
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    np.logical_not(separators[buf], out=inside[1:-1])
    body = inside[1:-1]
    new, last = body & ~inside[:-2], body & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    new[cut] = body[cut]
    last[cut - 1] = body[cut - 1]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    return Words(buf, start, end, np.searchsorted(start, off), ranges_hash(buf, start, end))


def ranges_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range; ranges ascend and do not overlap."""
    if not len(start):
        return np.zeros(0, U64)
    low = int(start[0])
    place = np.arange(low, len(buf), dtype=np.int64) - np.repeat(start, np.diff(np.append(start, len(buf))))
    total = np.zeros(len(place) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(byte_values(buf[low:], place), out=total[1:])
        return mix(total[end - low] - total[start - low] + (end - start).astype(U64))


def doubled(h: np.ndarray, step: int) -> np.ndarray:
    """The hashes of two runs of words, the second step words after the first; void where a second is missing."""
    out = np.zeros(len(h), U64)
    if step < len(h):
        with np.errstate(over="ignore"):
            out[:-step] = mix(h[:-step] * P + h[step:], step)
    return out


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words that start at each word, and whether all k belong to one text (else the hash is void)."""
    h, width = w.hash, 1
    while width < k:
        step = min(width, k - width)
        h = doubled(h, step)
        width += step
    return mix(h, k), np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(h)) >= k


def span_hash(w: Words, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the words first:stop, of any number above 0."""
    size, out = stop - first, np.zeros(len(first), U64)
    h, width = w.hash, 1
    while len(size):
        pick = np.flatnonzero((size >= width) & (size < 2 * width))
        with np.errstate(over="ignore"):
            out[pick] = mix(h[first[pick]] * P + h[stop[pick] - width] + size[pick].astype(U64), 41)
        if size.max() < 2 * width:
            break
        h = doubled(h, width)
        width *= 2
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles: (values, first); a text of 1 to k-1 words has one shingle, all its words."""
    w = words(texts)
    count = np.diff(w.first)
    h, ok = grams(w, k)
    row = w.row
    h, row = h[ok], row[ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.concatenate([h, mix(span_hash(w, w.first[short], w.first[short + 1]), 1000)])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(count) + 1))


def chunks(it, n: int):
    it = iter(it)
    while part := list(itertools.islice(it, n)):
        yield part
