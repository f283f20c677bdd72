"""The stream of job states against counters of a table, and against plain Python."""

import random
import time
import uuid

import pytest

from factspark.streaming.jobs import NEWS, job_counters, job_rows, stream_jobs

SHOWN = ["document_id", "status", "stage", "progress", "pages_total", "pages_done", "pages_failed", "facts_extracted", "relationships_found", "stalled"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*SHOWN).collect())


def random_news(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choices(["page", "found", "related", "failed", "odd", None], [80, 8, 3, 2, 1, 1])[0]
        page = rng.choice([None, *range(1, 9), 2500]) if kind == "page" else None
        out.append((rng.choice(["a", "b", "c", "", None]), None if rng.random() < 0.02 else seq, kind, page, rng.choice([None, 3, 9]), rng.choice([True, True, False, None]), rng.choice([None, 0, 4]), rng.choice([None, 2])))
    return out


def plain(news):
    """The jobs, by one pass in order of seq."""
    jobs = {}
    for doc, seq, kind, page, pages, ok, facts, links in sorted((r for r in news if r[0] is not None and r[1] is not None), key=lambda r: r[1]):
        if kind not in ("page", "found", "related", "failed") or kind == "page" and page is None:
            continue
        job = jobs.setdefault(doc, {"pages": {}, "kind": None, "total": 0, "links": 0})
        if kind == "page":
            job["pages"][page] = (bool(ok), (facts or 0) if ok else 0)
        else:
            job["kind"] = kind
            if kind == "found":
                job["total"] = pages or 0
            if kind == "related":
                job["links"] = links or 0
    out = []
    for doc, job in jobs.items():
        done, total, kind = len(job["pages"]), job["total"], job["kind"]
        partly = 70 * min(done, max(total, 1)) // max(total, 1)
        if kind is None:
            shown = ("queued", "queued", 0)
        elif kind == "found":
            shown = ("processing", "finding_relationships", 75) if done >= total else ("processing", "processing_pages", partly)
        else:
            shown = ("completed", "completed", 100) if kind == "related" else ("failed", "failed", partly)
        out.append((doc, *shown, total, done, sum(not ok for ok, _ in job["pages"].values()), sum(n for _, n in job["pages"].values()), job["links"], False))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_counters_of_a_table(spark, seed):
    news = random_news(300, seed)
    assert rows_of(job_counters(spark.createDataFrame(news, NEWS))) == plain(news)


def test_empty_table(spark):
    assert rows_of(job_counters(spark.createDataFrame([], NEWS))) == []


def test_stream_equals_table_and_replay_changes_nothing(spark, tmp_path):
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("news", "jobs", "checkpoint"))
    news = random_news(200, 7)
    random.Random(1).shuffle(news)  # news of one page come in any order
    for part in (news[:90], news[90:], news[40:160]):  # the third comes again as a whole
        spark.createDataFrame(part, NEWS).coalesce(1).write.mode("append").parquet(source)
        stream_jobs(spark, spark.readStream.schema(NEWS).parquet(source), target, checkpoint).awaitTermination()
    assert rows_of(job_rows(spark, target)) == plain(news)


def test_a_job_without_news_is_stalled(spark, tmp_path):
    source, target = (f"file://{tmp_path}/{x}" for x in ("news", "jobs"))
    spark.createDataFrame([("open", 1, "found", None, 5, None, None, None), ("done", 2, "related", None, None, None, None, 1)], NEWS).coalesce(1).write.parquet(source)
    run = stream_jobs(spark, spark.readStream.schema(NEWS).parquet(source), target, f"file://{tmp_path}/{uuid.uuid4().hex}", stalled_after=1.0, trigger={"processingTime": "1 second"})
    try:
        end = time.time() + 60
        stalled = []
        while time.time() < end and not stalled:
            time.sleep(1)
            if not run.isActive:
                raise run.exception()
            if list(tmp_path.glob("jobs/batch=*/_SUCCESS")):
                stalled = [r.document_id for r in job_rows(spark, target).where("stalled").collect()]
    finally:
        run.stop()
    assert stalled == ["open"]
