"""Near copies among vectors against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from factspark.llm import common, neardup


def table_of(seed=1, crowd=150):
    """Spread vectors, a crowd of near copies, chains, exact and scaled copies, and odd rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 24))
    rows = [x, x[0] + 0.03 * rng.normal(size=(crowd, 24)), x[1] + 0.25 * rng.normal(size=(40, 24)), np.repeat(x[2:3], 70, axis=0), x[3:13] * 7.5]
    chain = [x[20]]
    for _ in range(6):
        step = rng.normal(size=24)
        chain.append(chain[-1] + 0.29 * np.linalg.norm(chain[-1]) * step / np.linalg.norm(step))
    rows.append(np.array(chain))
    all_rows = [v.tolist() for part in rows for v in part]
    ids = rng.permutation(len(all_rows)).tolist()
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [None] + [1.0] * 23), (9004, [float("nan")] * 24), (9005, [float("inf")] + [1.0] * 23), (9006, [1.0, 2.0]), (9007, []), (None, x[2].tolist()), (None, None), (ids[0], all_rows[0]), (ids[1], x[5].tolist())]
    return [*zip(ids, all_rows, strict=True), *odd]


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == 24 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in good])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for a, row in zip(good, near, strict=True):
        links[a] = int(row.sum())
    changed = True
    while changed:
        changed = False
        for a, row in zip(good, near, strict=True):
            low = min([root[a], *(root[good[j]] for j in np.flatnonzero(row))])
            for b in [a, *(good[j] for j in np.flatnonzero(row))]:
                changed |= root[b] != low
                root[b] = low
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root[i]] = min(least.get(root[i], id_), id_)
    named = [least.get(root[i]) for i in range(len(rows))]
    return sorted(((id_, n, c, id_ == c if id_ is not None and c is not None else n == 0) for (id_, _), n, c in zip(rows, links, named, strict=True)), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, node long, v int, copies int, digest string"


@pytest.mark.parametrize("shard_rows", [2048, 60])
def test_near_copies_against_all_pairs(spark, shard_rows):
    rows = table_of()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA).repartition(4)
    folder = common.work_dir(spark, "test")
    got = neardup.link(df, folder, shard_rows=shard_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    audit = spark.read.parquet(f"{folder}/audit").first()
    assert audit.recall >= 0.999
    assert audit.links > 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    rows = table_of(3, 60)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/e/*.parquet')")
    assert sorted(con.execute(neardup.ORACLE).fetchall(), key=str) == brute(rows)


def test_repeated_vectors_are_one_node(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = {tuple(r)[1:] for r in neardup.link(df, common.work_dir(spark, "test")).collect() if r.vec_id > 1}
    assert got == {(199, 1, False), (99, 0, False)}


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)], [(4, [1.0])], [(1, [0.0]), (2, [0.0])]])
def test_tables_without_links(spark, rows):
    got = neardup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), common.work_dir(spark, "test")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, 0, i, True) for i, _ in rows), key=str)


def test_rows_go_wherever_a_partner_may_be_at_home():
    rng = np.random.default_rng(4)
    x = neardup.unit(np.vstack([rng.normal(size=(400, 8)), rng.normal(size=(20, 8)).repeat(20, axis=0) + 0.1 * rng.normal(size=(400, 8))]))
    centres = neardup.learn_centres(x, 12)
    home, _ = neardup.nearest_centres(x, centres, 1)
    visit = neardup.shards_to_visit(x, centres, math.sqrt(2 - 2 * 0.95))
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert visit[a, home[b, 0]].all()
    assert visit.mean() < 1


def test_pruned_lists_lead_to_every_row():
    rng = np.random.default_rng(9)
    x = neardup.unit(np.vstack([rng.normal(size=(500, 16)), 3 * rng.normal(size=16) + 0.2 * rng.normal(size=(300, 16))])).astype(np.float32)
    row, to = neardup.build(x, 1)
    assert len(row) <= 800 * (neardup.DEGREE + neardup.WAYS_BACK)
    edges = {i: to[row == i].tolist() for i in range(800)}
    seen, todo = {0}, [0]
    while todo:
        new = {j for i in todo for j in edges[i]} - seen
        seen |= new
        todo = list(new)
    assert len(seen) == 800


def test_no_member_of_a_crowd_is_missed():
    rng = np.random.default_rng(12)
    middle = rng.normal(size=64)
    x = neardup.unit(np.vstack([rng.normal(size=(1500, 64)), middle + 0.1 * rng.normal(size=(700, 64))]))
    row, to = neardup.build(x.astype(np.float32), 3)
    shard = neardup.Shard(x, row, to, np.ones(len(x), bool))
    asked = np.arange(1500, 1700)
    i, j = shard.near(x[asked], np.full(200, -1), 0.95, neardup.BEAM)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(x[asked].astype(np.float32) @ x.T.astype(np.float32) >= 0.95)), strict=True))
