import difflib
import math
import random

from pyspark.sql import functions as F

from factspark.functions import pages, text
from factspark.operators import catalog, layout, merge, relate, retrieval
from factspark.plans import answer, ingest
from factspark.sources import files, models
from factspark.streaming.ingest import stream_pages

BASE = dict(subject="Delhivery", predicate="revenue from services", normalized_value=8141.538, normalized_unit="INR crore", period_start="2023-04-01", period_end="2024-03-31", period_label="FY24", scope="consolidated", status="actual")
SCHEMA = "id string, subject string, predicate string, normalized_value double, normalized_unit string, period_start string, period_end string, period_label string, scope string, status string"


def verdict(spark, a, b):
    facts = spark.createDataFrame([{**BASE, **a, "id": "a"}, {**BASE, **b, "id": "b"}], SCHEMA)
    pairs = relate.plausible(relate.pair_up(spark.createDataFrame([("a", "b")], "a_id string, b_id string"), facts))
    row = relate.classify(pairs).first()
    return (row.relationship_type, row.context_dimension) if row else None


def test_rules(spark):
    assert verdict(spark, {}, {"normalized_value": 8142.0}) == ("CORROBORATES", "none")
    assert verdict(spark, {"normalized_value": 59.0, "normalized_unit": "%", "scope": None, "status": None}, {"normalized_value": 60.0, "normalized_unit": "%", "scope": None, "status": None}) == ("LIKELY_CONTRADICTION", "none")
    assert verdict(spark, {"normalized_value": 100.0}, {"normalized_value": 500.0}) == ("CONTRADICTS", "none")
    assert verdict(spark, {}, {"scope": "standalone"}) == ("CONTEXT_RECONCILES", "scope")
    assert verdict(spark, {"status": "first_advance_estimate"}, {"status": "estimate"}) == ("CONTEXT_RECONCILES", "estimate_vintage")
    assert verdict(spark, {}, {"period_start": "2022-04-01", "period_end": "2023-03-31"})[0] is None
    assert verdict(spark, {"predicate": "Adj. EBITDA"}, {"predicate": "EBITDA"})[0] is None
    assert verdict(spark, {"predicate": "shipments YoY growth"}, {"predicate": "shipments QoQ growth"})[0] is None


def test_similarity_is_that_of_difflib(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc de", k=rng.randint(0, 12))), "".join(rng.choices("abc de", k=rng.randint(0, 12)))) for _ in range(60)] + [("tide", "diet"), ("diet", "tide")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", relate.similarity(F.col("a"), F.col("b")).alias("s"), relate.may_reach(F.col("a"), F.col("b"), 0.5).alias("may"))
    for r in df.collect():
        want = difflib.SequenceMatcher(None, r.a.lower().strip(), r.b.lower().strip()).ratio()
        assert r.s == want and (r.may or want < 0.5)


def test_fusion(spark):
    def ranks(ids):
        return spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "query_id long, id string, rank int")

    assert [r.id for r in retrieval.fuse([ranks("abc"), ranks("acb")]).orderBy("rank").collect()][0] == "a"
    rows = {r.id: r.score for r in retrieval.fuse([ranks("ab"), ranks("zb")]).collect()}
    assert rows["b"] > rows["z"]
    assert retrieval.fuse([ranks(""), ranks("")]).count() == 0


def test_bm25_formula(spark):
    texts = {1: "Café revenue grew", 2: "revenue revenue fell", 3: "nothing here", 4: "cafe cafe cafe again", 5: "other words", 6: "more words"}
    got = retrieval.bm25(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(1, "revenue cafe")], "query_id long, question string")).collect()
    tokens = {i: t.lower().replace("é", "e").split() for i, t in texts.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)

    def score(i):
        out = 0.0
        for term in ("revenue", "cafe"):
            df = sum(term in t for t in tokens.values())
            w = math.log((6 - df + 0.5) / (df + 0.5))
            tf = tokens[i].count(term)
            out -= (w if w > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[i]) / mean))
        return round(out, 6)

    assert {r.id: r.score for r in got} == {i: score(i) for i in (1, 2, 4)}


def test_rows_and_clusters(spark):
    kind = "page_id long, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    pages = [(1, [(50.0, 10.0, 70.0, 20.0, "Revenue"), (10.0, 10.0, 40.0, 20.0, "FY24")]), (2, [(0.0, 10.0, 5.0, 20.0, "a"), (0.0, 50.0, 5.0, 60.0, "b")]), (3, [(0.0, 10.0, 5.0, 20.0, "a"), (9.0, 11.5, 12.0, 20.0, "b")]), (4, [])]
    rows = layout.row_table(spark.createDataFrame(pages, kind))
    got = {(r.page_id, r.row): r.text for r in rows.collect()}
    assert got == {(1, 0): "FY24 Revenue", (2, 0): "a", (2, 1): "b", (3, 0): "a b"}
    assert {r.page_id: r.text for r in layout.clustered_text(layout.clusters(rows)).collect()}[2] == "a\n\nb"


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    for merged in (merge.first_wins(old, new, ["id"], "v"), merge.last_wins(old, new, ["id"], "v"), merge.update_columns(old, new, ["id"], ["v"], "v")):
        assert merged.count() == 3
    assert merge.inserted(old, new, ["id"]) == 1


def test_replies(spark):
    replies = [('```json\n{"facts": []}\n```',), ('Here: {"facts": [{"subject": "x"}]} done',), ("no object",)]
    good, bad = models.parse_extraction(spark.createDataFrame(replies, "reply string"))
    assert good.count() == 2 and bad.count() == 1


def test_token_bucket():
    t = [0.0]
    bucket = models.TokenBucket(60, now=lambda: t[0])
    assert bucket.wait_for(60) == 0 and bucket.wait_for(30) == 30
    t[0] = 30.0
    assert bucket.wait_for(30) == 0
    bucket.true_up(30, 0)
    assert bucket.level == 30


def test_fail_over():
    def bad(_):
        raise models.Unavailable

    assert models.call([bad, lambda p: p.upper()], "x") == "X"


def test_nearest_takes_all_ties(spark):
    far, near = [9.0, 0.0], [1.0, 0.0]
    rows = [(400 - i, near if i % 2 else far) for i in range(400)]
    vectors = spark.createDataFrame([(*r,) for r in rows] + [(500, None)], "id long, embedding array<double>")
    got = retrieval.nearest(vectors, spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<double>"), 5).orderBy("rank").collect()
    assert [r.id for r in got] == sorted(i for i, v in rows if v == near)[:5] and {r.distance for r in got} == {1.0}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 11)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = retrieval.nearest(df, df.withColumnRenamed("id", "query_id"), 4, drop_self=True).collect()
    for q, v in rows:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:4]
        assert sorted((r.distance, r.id) for r in got if r.query_id == q) == want
    assert retrieval.nearest(df.limit(0), df.withColumnRenamed("id", "query_id")).count() == 0


def test_page_complexity(spark):
    long = "word " * 100
    cases = {
        ("", 0, 0): (False, ""), ("text", 0, 4): (False, ""), ("text", 0, 5): (True, "low text density (0.0000) alongside visual content"), (long, 1, 0): (True, "1 embedded image(s)"), (long, 0, 40): (True, "40 vector drawing ops"),
        (long + "see Figure 3", 0, 0): (False, "chart/figure keyword present"), (long + "chartered prefigure", 0, 0): (False, ""), (None, 2, 41): (True, "2 embedded image(s); 41 vector drawing ops; low text density (0.0000) alongside visual content"),
    }
    df = spark.createDataFrame([(t, i, d) for t, i, d in cases], "t string, i int, d int")
    for r in df.select("*", pages.complexity(F.col("t"), F.col("i"), F.col("d"), F.lit(484704.0)).alias("c")).collect():
        assert (r.c.is_complex, r.c.reason) == cases[r.t, r.i, r.d]


def test_documents_newest_first_and_issues(spark):
    documents = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "id string, created_at int")
    facts = spark.createDataFrame([("f", "a"), ("g", "a")], "id string, document_id string")
    links = spark.createDataFrame([("f", "g"), ("f", "x")], "fact_a_id string, fact_b_id string")
    jobs = spark.createDataFrame([("j", "a", "done", 1), ("k", "a", "queued", 2)], "id string, document_id string, status string, created_at int")
    got = catalog.list_documents(documents, facts, links, jobs).collect()
    assert [r.id for r in got] == ["b", "c", "a"] and (got[2].fact_count, got[2].relationship_count, got[2].latest_job_status) == (2, 2, "queued") and got[0].fact_count == 0
    assert [r.id for r in catalog.list_issues(documents.withColumn("document_id", F.col("id")), limit=2).collect()] == ["b", "c"]


def test_answer_is_per_question(spark):
    names = ["red apple", "green pear", "red plum", "blue stone"]
    facts = spark.createDataFrame([(f"{p}{i}", f"{n} {p}", "file") for p in "ab" for i, n in enumerate(names)], "id string, retrieval_text string, document_filename string")
    evidence = spark.createDataFrame([("e1", "a red apple grew", "file", 3)], "id string, text string, document_filename string, pdf_page_number int")
    links = spark.createDataFrame([(f"r{i}", f"a{i}", f"a{(i + 1) % 4}", "CORROBORATES", f"of a{i}", i) for i in range(4)] + [("s", "b0", "b1", "CONTRADICTS", "of b", 9)], "id string, fact_a_id string, fact_b_id string, relationship_type string, reason string, created_at int")
    questions = spark.createDataFrame([(1, "apple a"), (2, "stone b"), (3, "?")], "query_id long, question string")

    def encoder(column):
        return F.when(F.contains(column, F.lit("?")), F.lit(None)).otherwise(models.hashed_encoder()(column))

    got = answer.answer(questions, facts, evidence, links, encoder)
    tops = {}
    for r in got["facts"].collect():
        tops.setdefault(r.query_id, set()).add(r.id)
    for r in got["relationships"].collect():
        assert tops[r.query_id] & {r.fact_a_id, r.fact_b_id}
    context = {r.query_id: r for r in got["context"].collect()}
    assert set(context) == {1, 2, 3} and context[3].context == text.NO_CONTEXT and context[3].n_facts == 0
    first = context[1].context.split("\n")
    assert first[0].startswith("FACT: ") and sum(x.startswith("RELATIONSHIP: ") for x in first) <= 5 and any(x == "EVIDENCE [file p.3]: a red apple grew" for x in first)
    replies = spark.createDataFrame([(1, "it is red")], "query_id long, answer string")
    answers = {r.query_id: r.answer for r in answer.answer(questions, facts, evidence, links, encoder, replies=replies)["answers"].collect()}
    assert answers == {1: "it is red", 2: None, 3: text.NO_ANSWER}


def test_pairs_that_a_classifier_leaves_open_stay_open(spark):
    facts = spark.createDataFrame([{**BASE, "id": "a"}, {**BASE, "id": "b", "period_label": "FY25", "period_start": "2024-04-01"}, {**BASE, "id": "c", "period_label": "FY26", "period_start": "2025-04-01"}], SCHEMA)
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "a_id string, b_id string")
    texts = spark.createDataFrame([("a", "x" * 900), ("b", "quote")], "fact_id string, text string")

    def some(open_):
        assert {"a_evidence", "b_evidence"} <= set(open_.columns)
        return open_.withColumn("relationship_type", F.when(F.length("a_evidence") == 500, "CORROBORATES")).withColumn("confidence", F.lit(0.9))

    edges, left = relate.relate(pairs, facts, classifier=some, evidence=texts)
    assert [(r.fact_a_id, r.method) for r in edges.collect()] == [("a", "model")] and [(r.a_id, r.b_id) for r in left.collect()] == [("b", "c")]
    known = edges.select("fact_a_id", "fact_b_id")
    assert relate.relate(pairs, facts, known=known, classifier=some, evidence=texts)[0].count() == 0


def test_ingest_from_files_to_relationships(spark, tmp_path):
    one = "Acme revenue was 120 crore in FY24. See Figure 1.\f\n12\nAcme profit was 7 crore in FY24."
    (tmp_path / "up").mkdir()
    for name, content in {"a_report.txt": one, "copy.txt": one, "b.txt": "Acme revenue was 120.5 crore in FY24. This page is here.", "x.bin": "no"}.items():
        (tmp_path / "up" / name).write_text(content)
    documents = files.read_uploads(spark, str(tmp_path / "up"), ".txt")
    assert documents.count() == 2  # equal contents are one document
    rows, issues = files.parse_pages(documents)
    assert rows.count() == 3 and issues.count() == 0 and {r.printed_page_label for r in rows.collect()} == {None, "12"}
    assert {r.complexity_reason for r in rows.collect()} == {"", "chart/figure keyword present"}
    assert sorted(r.page_count for r in files.page_counts(documents).collect()) == [1, 2]
    evidence = ingest.evidence_of(rows)
    facts = ingest.facts_of(rows, evidence).cache()
    assert {(r.subject, r.predicate, r.normalized_value, r.period_start) for r in facts.collect()} == {("Acme", "revenue", 1.2e9, "2023-04-01"), ("Acme", "profit", 7e7, "2023-04-01"), ("Acme", "revenue", 1.205e9, "2023-04-01")}
    assert all(r.quote_found and len(r.evidence_ids) == 1 for r in facts.collect())
    edges, _ = ingest.relationships_of(facts, facts)
    assert [(r.relationship_type, r.method) for r in edges.collect()] == [("CORROBORATES", "rule")]

    def broken(_):
        raise ValueError("not a page")

    bad, errors = files.parse_pages(documents, broken)
    assert bad.count() == 0 and {r.description for r in errors.collect()} == {"ValueError: not a page"}


def test_streamed_pages_survive_a_replay(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("u", "<p>1</p>"), ("v", "<p>1</p>"), ("w", None)], "url string, html string").write.parquet(source)
    stream_pages(spark, source, "url string, html string", target, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    stream_pages(spark, source, "url string, html string", target, str(tmp_path / "c2")).awaitTermination()  # all batches again
    assert spark.read.parquet(target).count() == 2


def test_vectors_are_put_in_place(spark):
    old = models.upsert_vectors(spark.createDataFrame([], "id string, text string, embedding array<float>, metadata map<string,string>"), spark.createDataFrame([("a", "one", 1), ("b", "two", None)], "id string, text string, n int"), n=F.col("n"))
    assert {r.id: r.metadata for r in old.collect()} == {"a": {"n": "1"}, "b": {}}
    new = models.upsert_vectors(old, spark.createDataFrame([("b", "three", [1, 2]), ("c", "", None)], "id string, text string, n array<int>"), n=F.col("n"))
    assert {r.id: (r.text, r.metadata) for r in new.collect()} == {"a": ("one", {"n": "1"}), "b": ("three", {"n": "[1, 2]"}), "c": ("", {})}


def test_json_is_asked_for_once_more():
    import json

    asked = []

    def model(prompt):
        asked.append(prompt)
        return '{"a": 1}' if len(asked) > 1 else "sorry"

    assert models.complete_json([model], "q", json.loads) == {"a": 1} and len(asked) == 2 and "sorry" in asked[1]
    asked[:] = []
    try:
        models.complete_json([lambda p: "never"], "q", json.loads)
        raise AssertionError
    except ValueError:
        pass


def test_keys_take_turns():
    t = [0.0]
    keys = models.Keys(["a", "b", "c"], now=lambda: t[0])
    assert [keys.take() for _ in range(4)] == ["a", "b", "c", "a"]
    keys.wait("b", 10)
    assert [keys.take() for _ in range(3)] == ["c", "a", "c"]
    t[0] = 11.0
    assert keys.take() == "a" and keys.take() == "b"


def test_charts_are_read_by_the_first_that_can():
    def down(image, context):
        raise models.Unavailable

    assert models.read_chart([down, lambda image, context: {"n": len(image), "c": context}], b"png", " page ") == {"n": 3, "c": "page"}
