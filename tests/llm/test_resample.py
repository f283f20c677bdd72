"""Resampling against plain Python on small odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factspark.llm import common, resample

WORDS = ["alpha", "Beta", "gamma2", "über", "Ünder", "don't", "x" * 70, "日本語", "end.", "ÉCLAIR"]


def rows_of():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    copy = " ".join(["alpha beta"] * 15)
    return [*rows, *((100 + i, copy) for i in range(60)), (7, copy), (7, rows[0][1]), (None, copy), (None, None), (200, None), (201, ""), (202, " .,;\t"), (203, "word " * 30_000)]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text, low, high):
    w = tokens(text)
    return [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, low, high, buckets=10_000):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in grams(t, low, high))

    s, t = count(x for _, x in rows), count(target)
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in set(s) | set(t)}
    out = []
    for id_, text in rows:
        found = grams(text, low, high)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append([id_, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(tokens(text)) >= 20])
    some = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(some[: 10 * len(some) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 3), (2, 2)])
def test_resampling(spark, low, high):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "doc_id long, text string, copies int, digest string, weight int").repartition(5)
    target = ["alpha beta gamma2", "Über alpha", None, "", "alpha beta gamma2"]
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), common.work_dir(spark, "test"), low=low, high=high).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, target, low, high)


def test_crc_of_ranges():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4800, 400)
    end = start + rng.integers(1, 200, 400)
    assert resample.crc_of(buf, start, end).tolist() == [zlib.crc32(buf[a:b]) for a, b in zip(start, end, strict=True)]


def test_features_of_a_batch_without_words():
    row, bucket, n = resample.features(pa.array(["", None, " , "]), 1, 2, 100)
    assert (len(row), len(bucket), n.tolist()) == (0, 0, [0, 0, 0])


@pytest.mark.parametrize("empty", ["documents", "target", "both"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty != "target" else [(1, "one two " * 20)], "doc_id long, text string")
    target = spark.createDataFrame([] if empty != "documents" else [("one",)], "text string")
    got = resample.resample(docs, target, common.work_dir(spark, "test")).collect()
    assert len(got) == (empty == "target")


def test_the_draw_prefers_the_target(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdef" if i % 4 else "uvwxyz") for _ in range(40))) for i in range(800)], "doc_id long, text string")
    target = spark.createDataFrame([("u v w x y z",)] * 400, "text string")
    drawn = [r.doc_id for r in resample.resample(docs, target, common.work_dir(spark, "test")).where("rank is not null").collect()]
    assert len(drawn) == 80
    assert sum(i % 4 == 0 for i in drawn) > 2 * len(drawn) / 4
