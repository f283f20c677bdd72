"""Importance resampling towards a target: documents whose n-grams the target has more often than the corpus are drawn more often.

Words are runs of ASCII letters, digits and all signs beyond ASCII, with A-Z folded to lower case. Features are all runs of LOW to HIGH words, joined by
one space, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. A bucket's gain is the logarithm of how much likelier
the target is to show it than the corpus, both counted once more than seen; a document's weight is the floored mean of its features' gains. A Gumbel
noise that its id alone decides is added, so the highest scores are a draw without replacement by weight.

Equal texts are one group: features are made once for each distinct text, corpus counts are multiplied by how many rows hold it, and weights are joined back
by the text's SHA-256 before each row gets its noise. Only the buckets' counts, BUCKETS of each side, pass the driver.

A null text counts as empty: no features, weight 0. A null id takes the noise of an empty id, and stands last among equal scores. Rows that repeat an id are rows
of their own with the same noise. Rows with too few words are scored and never drawn. An empty corpus gives no rows; an empty target gives every bucket the same count.
Other columns of docs are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, LOW, HIGH = 10_000, 1, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Longer features than this many bytes are hashed one by one.
TABLE_BYTES = 64


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parts of a CRC-32: what a byte adds that has so many bytes behind it, and the sum of so many zero bytes."""
    zeros = np.array([zlib.crc32(bytes(n)) for n in range(TABLE_BYTES + 1)], np.uint32)
    one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ zeros[1]
    rows = [one]
    for _ in range(TABLE_BYTES - 1):
        rows.append(one[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.array(rows), zeros


BYTE_CRC, ZERO_CRC = crc_tables()


def crc_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each byte range; ranges may overlap, none is empty. A CRC is a sum of what its bytes add, so no loop runs over ranges."""
    size = end - start
    out = np.zeros(len(size), np.uint32)
    short = np.flatnonzero(size <= TABLE_BYTES)
    if len(short):
        n = size[short]
        first = np.cumsum(n) - n
        behind = np.repeat(first + n - 1, n) - np.arange(first[-1] + n[-1])
        at = np.repeat(end[short] - 1, n) - behind
        out[short] = np.bitwise_xor.reduceat(BYTE_CRC[behind, buf[at]], first) ^ ZERO_CRC[n]
    for i in np.flatnonzero(size > TABLE_BYTES).tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    return out


def joined(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with a space behind each, and where each begins."""
    size = w.end - w.start
    first = np.cumsum(size + 1) - size - 1
    buf = np.full(int(size.sum()) + len(size), 32, np.uint8)
    buf[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.buf[np.repeat(w.start - (first - np.arange(len(size))), size) + np.arange(int(size.sum()))]
    return buf, first


def features(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature, and each row's number of words."""
    w = C.words(texts, C.PUNCTUATION, fold=True)
    n_words, size, owner = np.diff(w.first), w.end - w.start, w.row
    left = np.repeat(w.first[1:], n_words) - np.arange(len(size))
    buf, first = joined(w)
    rows, found = [], []
    for k in range(low, high + 1):
        at = np.flatnonzero(left >= k)
        rows.append(owner[at])
        found.append(crc_of(buf, first[at], first[at + k - 1] + size[at + k - 1]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), n_words


def text_features(texts: DataFrame, low: int, high: int, buckets: int, text_col: str = "text") -> DataFrame:
    """For each distinct text: digest, copies, n_words, n_features, and its buckets with how often each occurs."""
    distinct = texts.select(F.col(text_col).cast("string").alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            row, bucket, n_words = features(b.column("text"), low, high, buckets)
            key, times = np.unique(row * buckets + bucket, return_counts=True)
            first = np.searchsorted(key, np.arange(b.num_rows + 1) * buckets)
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.record_batch([b.column("digest"), b.column("copies"), pa.array(n_words), pa.array(n), C.lists(key % buckets, first, pa.int32()), C.lists(times, first, pa.int32())], ["digest", "copies", "n_words", "n_features", "buckets", "times"])

    named = distinct.select(digest_of(F.col("text")).alias("digest"), "copies", "text")
    return named.mapInArrow(C.tidied(kernel), "digest string, copies long, n_words long, n_features long, buckets array<int>, times array<int>")


def digest_of(text: Column) -> Column:
    return F.coalesce(F.sha2(text.cast("string"), 256), F.lit(""))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            times = b.column("times")
            n = times.value_lengths().to_numpy(zero_copy_only=False)
            np.add.at(total, b.column("buckets").flatten().to_numpy(), times.flatten().to_numpy() * np.repeat(b.column("copies").to_numpy(), n))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("copies", "buckets", "times").mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((y + 1) * (s + buckets)) / float((x + 1) * (t + buckets)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """digest, copies, n_words, n_features, weight of each distinct text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            times, n = b.column("times"), b.column("n_features").to_numpy()
            size = times.value_lengths().to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(gains[b.column("buckets").flatten().to_numpy()] * times.flatten().to_numpy())])
            end = np.cumsum(size)
            weight = (total[end] - total[end - size]) // np.maximum(n, 1)
            yield pa.record_batch([*(b.column(c) for c in ("digest", "copies", "n_words", "n_features")), pa.array(weight)], ["digest", "copies", "n_words", "n_features", "weight"])

    return found.mapInArrow(kernel, "digest string, copies long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, drawn: int, folder: str) -> DataFrame:
    """scored with rank from 1 for the first rows by score; each task sorts a range of scores, and ranges are numbered by the rows before them."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = scored.where("eligible").repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": place})
    parts = C.staged(parts, folder, "ordered")
    before, at = [], 0
    for r in parts.groupBy("part").count().orderBy("part").collect():  # a row for each task of the sort
        before.append((r.part, at))
        at += r["count"]
    offsets = scored.sparkSession.createDataFrame(before, "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    first = parts.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    return first.select("doc_id", "n_features", "weight", "score", "rank").unionByName(scored.where("not eligible").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, folder: str, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; rank from 1 for those drawn: of the rows with least_words words or more, percent of
    a hundred (rounded down) with the highest scores, ties to the lesser id."""
    found = C.staged(text_features(docs, low, high, buckets, text_col), folder, "features", compression="zstd")
    wanted = C.staged(text_features(target, low, high, buckets, target_text_col), folder, "target")
    gains = gains_of(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weights = C.staged(weighed(found, gains), folder, "weights", compression="zstd")
    ids = C.staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest")), folder, "ids", compression="zstd")
    n = weights.agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("n_words") >= least_words, F.col("copies"))).alias("some")).first()
    rows = C.join_frequent_apart(ids, weights, ["digest"], weights.where(F.col("copies") >= C.FREQUENT * (n.n or 0)))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    scored = C.staged(rows.select("doc_id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("eligible")), folder, "scored", compression="zstd")
    return ranked(scored, percent * (n.some or 0) // 100, folder)


ORACLE = """
WITH bytes AS (SELECT i AS b, list_reduce(list_prepend(i, range(8)), lambda c, u: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
table256 AS (SELECT list(v ORDER BY b) AS v FROM bytes),
texts AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
rows_ AS (SELECT kind, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
features AS (SELECT kind, r, unnest(words) AS word FROM rows_),
spelled AS (SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT word FROM features)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, v[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM spelled, table256),
counted AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM features JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM counted),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain FROM counted, totals),
means AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
 FROM rows_ LEFT JOIN means USING (r) WHERE kind = 0),
drawn AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM drawn
"""
