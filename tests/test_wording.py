import difflib
import random

import pytest
from pyspark.sql import functions as F

from factspark.operators import relate, wording
from factspark.plans.queries import QUERIES

WORDS = ["revenue", "net profit", "Net  Profit", "ebitda", "margin", "growth", "of the group", "India", "indian", "FY", "été", "数量", "a", "ab", "abc", "aab"]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def tidy(x):
    return (x or "").lower().strip(" \t\n\x0b\x0c\r")


def texts(n, seed=1):
    rnd = random.Random(seed)
    out = [None, "", " ", "x", "X ", "y" * 300, "y" * 299 + "z", "q" * 250 + "w" * 250]
    for _ in range(n):
        t = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5)))
        if rnd.random() < 0.6:
            i = rnd.randrange(len(t))
            t = t[:i] + rnd.choice(["", "#", "s", t[i] * 2]) + t[i + 1 :]
        out += [t] * rnd.randint(1, 2)
    return out + [f"Customer#{i:09d}" for i in range(60)]


@pytest.mark.parametrize("threshold", [0.35, 0.7, 0.81, 0.92, 1.0])
def test_all_pairs_of_wordings(spark, threshold):
    rows = texts(120)
    got = {(r.a, r.b): (r.ab, r.ba) for r in wording.similar_wordings(spark.createDataFrame([(t, 1) for t in rows], "text string, n int"), threshold).collect()}
    kept = sorted({tidy(t) for t in rows} - {""})
    true = {}
    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            both = ratio(a, b), ratio(b, a)
            if max(both) >= threshold:
                true[a, b] = both
    assert got == true
    assert true or threshold == 1.0


def test_numbered_names_meet_by_what_is_left_without_a_sign():
    assert wording.by_variants(18, 18, 0.92) and not wording.by_variants(18, 16, 0.92)
    assert len(wording.variants("abc", 0.92)) == 4 and wording.variants("x" * 60, 0.92) == set()
    assert all(tag and side != wording.SAME for tag, side, _, _ in wording.looked_up(18, 0.92))
    assert all(k <= 0.5 * n for n in range(25, 400) for tag, _, _, k in wording.looked_up(n, 0.92) if not tag)


def test_empty_table_and_wrong_thresholds(spark):
    empty = spark.createDataFrame([], "text string")
    assert wording.similar_wordings(empty, 0.5).collect() == []
    for t in (0, -1, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            wording.similar_wordings(empty, t)


def test_all_plausible_pairs_of_facts(spark):
    rnd = random.Random(3)
    names, metrics = texts(25, 5), ["revenue", "revenues", "EBITDA", "ebitda margin", None, "数量"]
    rows = [(i, rnd.choice(names), rnd.choice(metrics)) for i in range(200)]
    facts = spark.createDataFrame(rows, "id long, subject string, predicate string")
    found = {(r.a_id, r.b_id): (r.subject_sim, r.predicate_sim) for r in wording.similar_facts(facts).collect()}

    def alike(a, b):
        return a == b or max(ratio(a, b), ratio(b, a)) >= relate.PLAUSIBLE

    def sim(a, b):
        return 1.0 if a == b else ratio(a, b)

    true = {}
    for i, s, p in rows:
        for j, s2, p2 in rows:
            x, y, u, v = tidy(s), tidy(s2), tidy(p), tidy(p2)
            if i != j and alike(x, y) and alike(u, v):
                true[i, j] = sim(x, y), sim(u, v)
    assert found == true and len(true) > 1000


def test_rules_decide_the_same_as_over_all_pairs(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        bounds = rnd.choice([("2022-04-01", "2023-03-31"), ("2021-04-01", "2022-03-31"), (None, None), ("", "2023-03-31")])
        rows.append((f"f{i:03d}", rnd.choice(["Acme Industries Ltd", "Acme Industries Ltd.", "ACME industries ltd", "Zeta", None]), rnd.choice(["revenue", "revenue YoY growth", "revenues"]), rnd.choice([100.0, 100.5, 110.0, 200.0, None]), rnd.choice(["INR crore", "%", "", None]), *bounds, rnd.choice(["FY23", "fy23 ", "FY22", None, ""]), rnd.choice(["consolidated", None]), rnd.choice(["actual", None])))
    facts = spark.createDataFrame(rows, "id string, subject string, predicate string, normalized_value double, normalized_unit string, period_start string, period_end string, period_label string, scope string, status string")
    every = facts.select(F.col("id").alias("a_id")).crossJoin(facts.select(F.col("id").alias("b_id"))).where("a_id <> b_id")
    fields = ("fact_a_id", "fact_b_id", "relationship_type", "confidence", "context_dimension")
    true, _ = relate.relate(every, facts)
    got, _ = relate.relate(wording.decidable(facts), facts)
    assert sorted(map(tuple, got.select(*fields).collect())) == sorted(map(tuple, true.select(*fields).collect()))
    assert got.count() > 50


def test_queries_against_all_pairs(spark, tmp_path):
    names = [f"Supplier#{i:09d}" for i in (*range(40), 111, 211, 999)]
    spark.createDataFrame([(i, n, i % 2, 100.0 + i) for i, n in enumerate(names)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(n,) for n in names], "c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    low = [n.lower() for n in names]
    near = {(a, b) for a in low for b in low if a < b and max(ratio(a, b), ratio(b, a)) >= relate.IDENTICAL}
    assert {(r.a, r.b) for r in QUERIES["similar_customer_names"](spark, str(tmp_path)).collect()} == near
    true = {}
    facts = [(str(2 * i + c), i % 2, low[i], ["closing account balance", "closing account balance."][c], (100.0 + i) * (1.005 if c else 1.0)) for i in range(len(names)) for c in (0, 1)]
    for a, na, sa, pa, va in facts:
        for b, nb, sb, pb, vb in facts:
            if a < b and na == nb:
                # the lesser id first: if its orientation is plausible at all, its similarities count
                if min(1.0 if x == y else ratio(x, y) for x, y in ((sa, sb), (pa, pb))) >= relate.IDENTICAL:
                    gap = abs(va - vb) / max(abs(va), abs(vb), 1e-9)
                    true[a, b] = "CORROBORATES" if gap <= 0.01 else "LIKELY_CONTRADICTION" if gap <= 0.15 else "CONTRADICTS"
    got = {(r.fact_a_id, r.fact_b_id): r.relationship_type for r in QUERIES["relate_near_wording"](spark, str(tmp_path)).collect()}
    assert got == true and len(set(true.values())) == 3
