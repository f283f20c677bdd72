import random

import pytest
from pyspark.sql import functions as F

from factspark.operators import textindex
from factspark.operators.retrieval import bm25
from factspark.operators.textindex import TextIndex
from factspark.sources.staging import shared_folder

WORDS = [f"w{i}" for i in range(60)] + ["Crème", "brûlée", "x1", "net", "sales"]


def texts(rng, ids):
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return {i: rng.choice([None, ""]) if rng.random() < 0.03 else " ".join(rng.choices(WORDS, weights, k=rng.choice([1, 5, 30, 200]))) for i in ids}


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.fixture
def questions(spark):
    asked = [(1, "net sales w3"), (2, "w0 w1 w2 w59"), (3, "creme BRULEE"), (4, "nothing here zzz"), (5, ""), (6, None), (7, "w7 w7 w8"), (8, "w0")]
    return spark.createDataFrame(asked, "query_id long, question string")


def test_merges_equal_ranking_the_texts(spark, questions, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 8)
    rng = random.Random(5)
    index, now = TextIndex(spark, shared_folder(spark, "test")), {}
    for step, (changed, deleted) in enumerate([(range(250), []), (range(200, 320), range(0, 40)), (range(30, 60), [300, 999, 35])]):
        new = texts(rng, changed)
        now = {i: t for i, t in now.items() if i not in set(deleted)} | new
        df = spark.createDataFrame([*new.items(), (None, "net sales")], "id long, text string")
        assert index.merge(df, spark.createDataFrame([(i,) for i in deleted], "id long")) == step + 1
        true = bm25(spark.createDataFrame(list(now.items()), "id long, text string"), questions, k=7)
        assert rows(index.search(questions, k=7, first_blocks=2)) == rows(true)
    every = bm25(spark.createDataFrame(list(now.items()), "id long, text string"), questions, k=None)
    assert rows(index.search(questions, k=None)) == rows(every)
    before = rows(index.search(questions, k=7))
    # a merge that died before its corpus row is no part of the index
    index.write(spark.createDataFrame([("net", 5)], "term string, df long"), "terms", 4)
    assert rows(index.search(questions, k=7)) == before
    index.compact()
    assert index.segments() == [4]
    assert rows(index.search(questions, k=7, first_blocks=1)) == before
    totals = index.table("corpus").agg(F.sum("documents").alias("n")).first()
    assert totals.n == len(now)


def test_blocks_are_skipped(spark, monkeypatch):
    """A rare term's best block outbids the others, so the second pass reads none of them."""
    monkeypatch.setattr(textindex, "BLOCK", 4)
    data = [(i, "common " * (i % 7 + 1) + "filler " * 40) for i in range(200)] + [(900 + i, "common rare rare") for i in range(5)]
    index = TextIndex(spark, shared_folder(spark, "test"))
    index.merge(spark.createDataFrame(data, "id long, text string"))
    seen = []
    whole = TextIndex.scored
    monkeypatch.setattr(TextIndex, "scored", lambda self, entries: seen.append(entries.count()) or whole(self, entries))
    got = index.search(spark.createDataFrame([(1, "rare common")], "query_id long, question string"), k=3, first_blocks=2)
    assert [r[2] for r in rows(got)] == [900, 901, 902]
    assert seen[1] <= 2 < index.table("postings").where("term = 'common'").count()


def test_empty_index(spark, questions):
    index = TextIndex(spark, shared_folder(spark, "test"))
    assert index.search(questions).count() == 0
    index.merge(spark.createDataFrame([], "id long, text string"))
    assert index.search(questions).count() == 0
    index.merge(spark.createDataFrame([(1, "net"), (1, "sales")], "id long, text string"))
    assert [r[2] for r in rows(index.search(questions))] == [1]
