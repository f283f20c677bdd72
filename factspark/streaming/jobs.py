"""State of ingest jobs as a stream: news of pages and stages in, counters of each job out.

News are rows (document_id, seq, kind, page, pages, ok, facts, relationships):

    kind      meaning                                                        uses
    found     the document was opened and has this many pages                pages
    page      a page was processed, or failed (ok false)                     page, ok, facts
    related   the relationships of its facts were found, the job is done     relationships
    failed    the document could not be read

Of several news of one page that with the greatest seq counts, so a page that failed and was retried counts once, and news that come
again change nothing. Of found, related and failed the one with the greatest seq tells the stage: a document that is found again is open
again. A failed page is a done page without facts. News without document_id or seq, of another kind, and of pages without a number are left out; of
equal seq those of the greater (ok, facts), kind, pages or relationships count.

State is kept for each document and block of PAGES_PER_KEY pages, so a document of a million pages is a thousand keys and not one; job_rows adds
the blocks up. It lives in RocksDB below the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NEWS = "document_id string, seq long, kind string, page int, pages int, ok boolean, facts int, relationships int"
BLOCKS = "document_id string, block int, pages_done long, pages_failed long, facts_extracted long, job_seq long, job_kind string, pages_total int, relationships_found int, stalled boolean"
#: Pages of one document that share a key of the state.
PAGES_PER_KEY = 1000
JOB_KINDS = ("found", "related", "failed")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Counters(StatefulProcessor):
    """Counters of one block: a map of its pages, their sums, the newest news of its job, and a timer that reports a block without news."""

    def __init__(self, stalled_after: float | None = None):
        self.stalled_after = stalled_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "seq long, ok boolean, facts int")
        self.sums = handle.getValueState("sums", "done long, failed long, facts long, job_seq long, job_kind string, found_seq long, pages int, related_seq long, relationships int, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple] = {}
        known = self.sums.exists()
        done, failed, facts, *job, timer = self.sums.get() if known else (0, 0, 0, *[None] * 7)
        stage, found, related = ((tuple(job[i : i + 2]) if job[i] is not None else None) for i in (0, 2, 4))
        for frame in rows:
            for seq, kind, page, pages, ok, n, links in zip(*(frame[c].tolist() for c in ("seq", "kind", "page", "pages", "ok", "facts", "relationships")), strict=True):
                if kind == "page":
                    newest[page] = max(newest.get(page, (seq, ok, n)), (seq, ok, n))
                else:  # news come in any order, so each number has the seq of the news that told it
                    stage = max(stage or (seq, kind), (seq, kind))
                    if kind == "found":
                        found = max(found or (seq, pages), (seq, pages))
                    elif kind == "related":
                        related = max(related or (seq, links), (seq, links))
        for page, (seq, ok, n) in newest.items():
            old = self.pages.getValue((page,)) if known and self.pages.containsKey((page,)) else None
            if old is not None and tuple(old) >= (seq, ok, n):
                continue
            done += old is None
            failed += (not ok) - (old is not None and not old[1])
            facts += n - (old[2] if old is not None else 0)
            self.pages.updateValue((page,), (seq, ok, n))
        if self.stalled_after is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.stalled_after)
            self.handle.registerTimer(timer)
        state = (done, failed, facts, *(stage or (None, None)), *(found or (None, None)), *(related or (None, None)))
        self.sums.update((*state, timer))
        yield self.row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.sums.get()
        if state[-1] == expiredTimerInfo.getExpiryTimeInMs():
            self.sums.update((*state[:-1], None))
            yield self.row(key, state[:-1], True)

    @staticmethod
    def row(key, state: tuple, stalled: bool) -> pd.DataFrame:
        done, failed, facts, seq, kind, _, pages, _, links = state
        values = (*key, done, failed, facts, seq, kind, pages, links, stalled)
        return pd.DataFrame({name.split()[0]: pd.Series([value], dtype=object) for name, value in zip(BLOCKS.split(", "), values, strict=True)})

    def close(self) -> None:
        pass


def clean_news(news: DataFrame) -> DataFrame:
    """News with their block; what can't be counted is left out, and missing counts are 0."""
    page = F.col("kind") == "page"
    rows = news.where(F.col("document_id").isNotNull() & F.col("seq").isNotNull() & (F.col("kind").isin(*JOB_KINDS) | page & F.col("page").isNotNull()))
    ok = F.coalesce("ok", F.lit(False))
    return rows.select(
        "document_id", F.when(page, F.floor(F.col("page") / PAGES_PER_KEY)).otherwise(0).cast("int").alias("block"), "seq", "kind", F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("pages", F.lit(0)).alias("pages"), ok.alias("ok"), F.when(ok, F.coalesce("facts", F.lit(0))).otherwise(0).alias("facts"), F.coalesce("relationships", F.lit(0)).alias("relationships"),
    )


def stream_jobs(spark: SparkSession, news: DataFrame, target: str, checkpoint: str, stalled_after: float | None = None, trigger: dict | None = None):
    """Starts a run over a stream of news and returns the query. Each batch writes the counters of the blocks that it changed to its own
    folder of target, which its replay writes again. With stalled_after, blocks without news for that many seconds are marked."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a started query keeps its own copy of the settings
    try:
        mode = "None" if stalled_after is None else "ProcessingTime"
        blocks = clean_news(news).groupBy("document_id", "block").transformWithStateInPandas(Counters(stalled_after), BLOCKS, "Update", mode)

        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

        return blocks.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def status_columns(kind: Column, done: Column, total: Column) -> dict[str, Column]:
    """Status, stage and progress: up to 70 by pages, 75 while relationships are looked for, 100 at the end."""
    all_done = (kind == "found") & (done >= total)
    return {
        "status": F.when(kind == "related", "completed").when(kind == "failed", "failed").when(kind == "found", "processing").otherwise("queued"),
        "stage": F.when(kind == "related", "completed").when(kind == "failed", "failed").when(all_done, "finding_relationships").when(kind == "found", "processing_pages").otherwise("queued"),
        "progress": F.when(kind == "related", 100).when(all_done, 75).when(kind.isNull(), 0).otherwise(F.floor(F.lit(70) * F.least(done, F.greatest(total, F.lit(1))) / F.greatest(total, F.lit(1)))).cast("int"),
    }


def job_rows(spark: SparkSession, target: str) -> DataFrame:
    """The job of each document, from the newest counters of each of its blocks; stalled if it is open and no block of it has news."""
    blocks = spark.read.schema(f"{BLOCKS}, batch long").parquet(target)
    fields = [c for c in blocks.columns if c not in ("document_id", "block", "batch")]
    last = blocks.groupBy("document_id", "block").agg(F.max_by(F.struct(*fields), "batch").alias("b")).select("document_id", "b.*")
    return summed(last)


def summed(blocks: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("job_kind", "pages_total", "relationships_found"), F.col("job_seq")).alias("j")
    sums = [F.sum(c).alias(c) for c in ("pages_done", "pages_failed", "facts_extracted")]
    jobs = blocks.groupBy("document_id").agg(*sums, newest, F.min("stalled").alias("quiet"))
    kind, total = F.col("j.job_kind"), F.coalesce("j.pages_total", F.lit(0)).cast("long")
    shown = jobs.withColumns({**status_columns(kind, F.col("pages_done"), total), "pages_total": total, "relationships_found": F.coalesce("j.relationships_found", F.lit(0)).cast("long")})
    open_ = F.col("status").isin("queued", "processing")
    return shown.withColumn("stalled", open_ & F.col("quiet")).drop("j", "quiet")


def job_counters(news: DataFrame) -> DataFrame:
    """The same jobs from a table of all news, without a stream."""
    rows = clean_news(news)
    pages = rows.where("kind = 'page'").groupBy("document_id", "page").agg(F.max(F.struct("seq", "ok", "facts")).alias("p"))
    sums = [F.count("*").alias("pages_done"), F.count_if(~F.col("p.ok")).alias("pages_failed"), F.sum("p.facts").alias("facts_extracted")]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("job_seq", "long"), ("job_kind", "string"), ("pages_total", "int"), ("relationships_found", "int"))]
    by_page = pages.groupBy("document_id").agg(*sums).select("*", *nothing)
    job = rows.where("kind <> 'page'").groupBy("document_id").agg(
        F.max("seq").alias("job_seq"), F.max(F.struct("seq", "kind"))["kind"].alias("job_kind"),
        F.max(F.when(F.col("kind") == "found", F.struct("seq", "pages")))["pages"].alias("pages_total"),
        F.max(F.when(F.col("kind") == "related", F.struct("seq", "relationships")))["relationships"].alias("relationships_found"),
    )
    by_job = job.select("document_id", *(F.lit(0).cast("long").alias(c) for c in ("pages_done", "pages_failed", "facts_extracted")), "job_seq", "job_kind", "pages_total", "relationships_found")
    return summed(by_page.unionByName(by_job).withColumn("stalled", F.lit(False)))
