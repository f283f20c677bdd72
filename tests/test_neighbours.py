import numpy as np
import pytest

from factspark.operators import neighbours
from factspark.operators.retrieval import batch_scorer, nearest, rerank

VECTORS, QUERIES = "id long, embedding array<double>", "query_id long, embedding array<double>"


def test_nearest_compares_equal_lengths_only(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [None, 1.0]), (8, [nan, 0.0]), (9, [inf, 0.0]), (None, [1.0, 0.0])]
    asked = [(10, [1.0, 0.0]), (11, [2.0]), (12, [1.0, None]), (None, [1.0, 0.0]), (13, None), (14, [])]
    got = nearest(spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, QUERIES), 5).collect()
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got) == [(10, 3, 1.0, 1), (10, 4, 1.0, 2), (11, 1, 1.0, 1)]


def test_a_scorer_that_fails_keeps_the_fused_order(spark):
    fused = spark.createDataFrame([(q, i, i, f"q{q}", f"text {9 - i}") for q in (1, 2) for i in (1, 2, 3)], "query_id long, id long, rank int, question string, text string").repartition(2, "query_id")

    def order(df):
        return sorted((r.query_id, r["rank"], r.id) for r in df.collect())

    def fails(questions, texts):
        raise ValueError("no model")

    kept = [(q, i, i) for q in (1, 2) for i in (1, 2)]
    assert order(rerank(fused, 2, batch_scorer(fails))) == kept
    assert order(rerank(fused, 2, batch_scorer(lambda q, t: [1.0]))) == kept
    assert order(rerank(fused, 2, batch_scorer(lambda q, t: [float("nan")] * len(t)))) == kept
    assert order(rerank(fused, 2, batch_scorer(lambda q, t: [float(x[-1] == "6") for x in t]))) == [(1, 1, 3), (1, 2, 1), (2, 1, 3), (2, 2, 1)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 24))
    x = np.vstack([rng.normal(size=(700, 24)), middles[rng.integers(0, 40, 800)] + 0.4 * rng.normal(size=(800, 24)), np.repeat(middles[:1], 60, axis=0)])
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_graph_recall_against_exact_neighbours(spark, cloud):
    extra = [(9000, None), (9001, [1.0, 2.0]), (9002, [1.0, 2.5]), (None, cloud[0][1]), (9003, [float("nan")] * 24)]
    vectors = spark.createDataFrame(cloud + extra, VECTORS)
    asked = spark.createDataFrame([(i, v) for i, v in cloud if i % 10 == 0] + [(20_000, [x + 0.01 for x in cloud[5][1]]), (9001, [1.0, 2.0])], QUERIES)
    true = {(r.query_id, r.id): r.distance for r in nearest(vectors, asked, 5, drop_self=True).collect()}
    got = {(r.query_id, r.id): r.distance for r in neighbours.near_graph(vectors, asked, 5, drop_self=True).collect()}
    assert len(got) == len(true)
    assert len(true.keys() & got.keys()) / len(true) >= 0.95
    assert all(abs(true[p] - got[p]) < 1e-6 for p in true.keys() & got.keys())
    assert {(9001, 9002)} == {p for p in got if p[0] == 9001}


def test_equal_vectors_give_the_least_ids(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(99, [0.0, 3.0])], VECTORS)
    got = neighbours.near_graph(same, spark.createDataFrame([(0, [1.0, 0.0]), (49, [1.0, 0.0])], QUERIES), 3, drop_self=True).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (49, 1, 0), (49, 2, 1), (49, 3, 2)]


def test_rows_moved_grow_with_the_table(spark, cloud):
    """A node meets its own edges, as many back, and itself: the rows sent in a round are bounded by the table's."""
    for n in (300, 1200):
        nodes = spark.createDataFrame(cloud[:n], "node long, v array<double>")
        edges = neighbours.graph(nodes, neighbours.shared_folder(spark, "test"), degree=8, rounds=2)
        assert edges.count() <= 8 * n
        assert edges.groupBy("a").count().where("count > 8").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])]])
def test_small_tables(spark, rows):
    vectors = spark.createDataFrame(rows, VECTORS)
    assert neighbours.near_graph(vectors, vectors.withColumnRenamed("id", "query_id"), 3, drop_self=True).count() == 0
