"""One ingest run: files to jobs, faults as issues, resume, charts and readers."""

import uuid

import pytest
from pyspark.sql import functions as F

from factspark.plans.ingest import ingest, ingest_pages
from factspark.sources.files import text_parser
from factspark.sources.models import rule_extractor

PAGE = "id string, document_id string, pdf_page_number int, raw_text string, tables array<string>, is_complex boolean"
WORDS = "page_id string, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def outside():
    """A parser and an extractor that fail; made here, as workers can't import this file."""

    def parser(content):
        if content == b"broken":
            raise ValueError("not a file")
        return text_parser(content)

    def fragile(text):
        if "Quota" in text:
            raise RuntimeError("rate limit")
        return rule_extractor(text)

    return parser, fragile


def files_of(spark):
    a = b"Acme revenue was 120 crore in FY24.\fAcme ebitda was 20 crore in FY24, Quota.\f "
    b = b"Acme revenue was 130 crore in FY24 for all of its units."
    return spark.createDataFrame([("a", bytearray(a)), ("b", bytearray(b)), ("c", bytearray(b"broken"))], "id string, content binary")


def by_id(df, key="document_id"):
    return {r[key]: r for r in df.collect()}


def test_files_to_jobs_and_resume(spark, folder):
    parser, fragile = outside()
    run = ingest(files_of(spark), f"{folder}/1", parser, extractor=fragile, relate=True)
    jobs = by_id(run.jobs)
    assert [(jobs[d].status, jobs[d].pages_total, jobs[d].pages_done, jobs[d].pages_failed, jobs[d].facts_extracted) for d in "abc"] == [("completed", 3, 3, 1, 1), ("completed", 1, 1, 0, 1), ("failed", 0, 0, 0, 0)]
    assert jobs["a"].progress == 100 and run.relationships.count() == sum(j.relationships_found for j in jobs.values())
    assert sorted((r.document_id, r.issue_type) for r in run.issues.collect()) == [("a", "fact_extraction_error"), ("c", "page_processing_error")]
    assert "rate limit" in run.issues.where("document_id = 'a'").first().description

    known = run.pages.select("id", F.current_timestamp().alias("processed_at"))
    again = ingest(files_of(spark), f"{folder}/2", parser, known_pages=known, known_evidence=run.evidence, known_issues=run.issues.where("document_id = 'a'"), known_facts=run.facts)
    assert [r.pdf_page_number for r in again.pages.collect()] == [2]  # the page that failed, and no other
    assert [r.predicate for r in again.facts.collect()] == ["ebitda"]
    assert [r.document_id for r in again.issues.collect()] == ["c"]
    jobs = by_id(again.jobs)
    assert (jobs["a"].pages_done, jobs["a"].pages_failed, jobs["a"].facts_extracted, jobs["a"].stage) == (3, 0, 1, "finding_relationships")


def test_an_extractor_that_takes_its_error_is_corrected(spark, folder):
    def learns(text, error=None):
        if error is None:
            raise ValueError("no JSON")
        return rule_extractor(text) if "no JSON" in error else []

    rows = spark.createDataFrame([("p", "d", 1, "Acme revenue was 120 crore in FY24.", [], False)], PAGE)
    run = ingest_pages(rows, folder, extractor=learns)
    assert run.facts.count() == 1 and run.issues.count() == 0


def page_words(lines):
    return [(0.0, 10.0 * i, 50.0, 10.0 * i + 8, line) for i, line in enumerate(lines)]


def test_charts(spark, folder):
    long_ = ["Unit revenue was 123 crore in FY15 in all regions", "Unit margin was 456 lakh in FY16 in all regions"]
    rows = spark.createDataFrame([(f"p{i}", "d", i, None if i == 5 else f"text {i}", [], i != 4) for i in range(1, 7)], PAGE)
    words = spark.createDataFrame([("p1", page_words(long_)), ("p2", page_words(["Fig. 1"])), ("p3", page_words(["Fig. 2"])), ("p4", page_words(long_)), ("p6", [])], WORDS)

    def reader(asked):
        sure = F.col("page_id") == "p2"
        got = asked.where("page_id in ('p2', 'p3')")
        return got.select("page_id", sure.alias("has_data"), F.when(~sure, "A title").alias("title"), F.when(sure, "Plant output was 77 million in FY20").alias("values"), F.lit(None).cast("string").alias("note"), F.when(sure, 0.8).otherwise(0.2).alias("confidence"), F.lit(None).cast("string").alias("uncertainty"))

    run = ingest_pages(rows, folder, words=words, reader=reader)
    charts = {r.page_id: (r.extraction_confidence, r.text) for r in run.evidence.where("evidence_type = 'chart'").collect()}
    assert charts == {"p1": (0.6, "\n".join(long_)), "p2": (0.8, "Plant output was 77 million in FY20"), "p3": (0.2, "A title")}
    assert sorted(r.raw_value for r in run.facts.collect()) == ["123", "456", "77"]
    issues = sorted((r.issue_type, r.page_id, r.confidence) for r in run.issues.collect())
    assert issues == [("low_confidence_visual_extraction", "p3", 0.2), ("vision_model_unavailable", "p5", None)]  # once for the document
    assert by_id(run.jobs)["d"].facts_extracted == 3


def test_empty_tables(spark, folder):
    run = ingest_pages(spark.createDataFrame([], PAGE), folder, words=spark.createDataFrame([], WORDS))
    assert [df.count() for df in run[:5]] == [0] * 5
