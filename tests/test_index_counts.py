import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factspark.functions.text import index_terms
from factspark.operators import textindex
from factspark.operators.retrieval import K1, B
from factspark.operators.textindex import TextIndex
from factspark.sources.staging import shared_folder

ODD = [None, "", " \n", "a", "Crème brûlée CRÈME", "x1 x1  x1 y", "数量 ５ ²", "áb", "İstanbul ẞ", "one--two_three", " é\u0085z", "w " * 700]


def test_terms_counted_in_python_are_those_of_the_index(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    want = {r.id: Counter(r.w) for r in df.select("id", index_terms(F.col("text")).alias("w")).collect()}
    got = {r.id: r for r in textindex.counted_terms(df.coalesce(1)).collect()}
    assert {i: {t.term: t.tf for t in r.terms} for i, r in got.items()} == want
    assert {i: r.length for i, r in got.items()} == {i: c.total() for i, c in want.items()}


def test_postings_of_blocks_hold_all_terms_of_their_documents(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 6)
    rng = random.Random(3)
    texts = {i: " ".join(rng.choices(["a", "b", "net", "été", "q9"], k=rng.choice([0, 1, 4, 90]))) for i in range(80)}
    index = TextIndex(spark, shared_folder(spark, "test"))
    index.merge(spark.createDataFrame([*texts.items(), (5, ""), (None, "a")], "id long, text string"))
    rows = index.table("postings").collect()
    got = {(e.id, r.term): (e.tf, e.length) for r in rows for e in r.entries}
    assert got == {(i, t): (n, len(x.split())) for i, x in texts.items() for t, n in Counter(x.replace("é", "e").split()).items()}
    assert all((r.df, r.max_tf, r.min_length) == (len(r.entries), max(e.tf for e in r.entries), min(e.length for e in r.entries)) for r in rows)
    assert len({r.block for r in rows}) > 5 and sum(r.df for r in rows) == len(got)
    assert {r.term: r.df for r in index.table("terms").collect()} == Counter(t for _, t in got)


def test_a_block_returns_what_can_be_among_the_best():
    """All documents of a block used to be returned, for each question and term, to be summed and ranked after an exchange."""
    entries = [[{"id": 7, "tf": 2, "length": 4}, {"id": 3, "tf": 1, "length": 9}], [{"id": 3, "tf": 5, "length": 9}, {"id": 8, "tf": 1, "length": 50}]]
    asking = [[{"query_id": 1, "weight": 0.5, "mean": 6.0, "least": None}, {"query_id": 2, "weight": 0.5, "mean": 6.0, "least": 1.0}], [{"query_id": 2, "weight": 1.5, "mean": 6.0, "least": 1.0}]]
    question = pa.struct([("query_id", pa.int64()), ("weight", pa.float64()), ("mean", pa.float64()), ("least", pa.float64())])
    entry = pa.struct([("id", pa.int64()), ("tf", pa.int32()), ("length", pa.int32())])
    table = pa.table([pa.array([4, 4], pa.int32()), pa.array(entries, pa.list_(entry)), pa.array(asking, pa.list_(question))], ["seq", "entries", "asking"])

    def part(weight, tf, length):
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / 6.0))

    got = {(r["query_id"], r["id"], r["seq"]): -r["score"] for r in textindex.scores_in_block(table).to_pylist()}
    want = {(1, 7, 4): part(0.5, 2, 4), (1, 3, 4): part(0.5, 1, 9), (2, 3, 4): part(0.5, 1, 9) + part(1.5, 5, 9)}
    assert part(0.5, 2, 4) < 1 and part(1.5, 1, 50) < 1 and got == pytest.approx(want)
