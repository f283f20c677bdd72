"""Reading the tables: lists, searches, counts and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import value_text

UNFINISHED = ("queued", "processing")
FACT_ERROR = "fact_extraction_error"


def newest(df: DataFrame, limit: int = 200, by: str = "created_at", key: str = "id") -> DataFrame:
    """The newest rows; of equally new ones the lesser key first."""
    if limit < 0:
        raise ValueError("a limit is at least 0")
    return df.orderBy(F.desc(by), key).limit(limit)


def with_filename(facts: DataFrame, documents: DataFrame) -> DataFrame:
    return facts.join(documents.select(F.col("id").alias("document_id"), F.col("filename").alias("document_filename")), "document_id")


def list_documents(documents: DataFrame, facts: DataFrame, relationships: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with their facts, their relationships (on the side of fact a) and their latest job's status; newest first where they have a time."""
    n_facts = facts.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("fact_count"))
    owner = facts.select(F.col("id").alias("fact_a_id"), "document_id")
    # counted by fact before the join, so no more rows than facts are joined
    per_fact = relationships.groupBy("fact_a_id").agg(F.count("*").alias("n"))
    n_links = per_fact.join(owner, "fact_a_id").groupBy(F.col("document_id").alias("id")).agg(F.sum("n").alias("relationship_count"))
    latest = jobs.groupBy(F.col("document_id").alias("id")).agg(F.max_by("status", F.struct("created_at", "id")).alias("latest_job_status"))
    out = documents.join(n_facts, "id", "left").join(n_links, "id", "left").join(latest, "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fact_count", "relationship_count")})
    return out.orderBy(F.desc("created_at"), "id") if "created_at" in out.columns else out


def list_issues(issues: DataFrame, document_id: str | None = None, limit: int = 200) -> DataFrame:
    """The newest extraction issues, of one document or of all."""
    return newest(issues if document_id is None else issues.where(F.col("document_id") == document_id), limit)


def like(column: Column, search: str) -> Column:
    """A substring match that ignores the case of ASCII letters only; % and _ in the search act as wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = str.maketrans(upper, lower)
    return F.translate(column, upper, lower).like(f"%{search.translate(fold)}%")


def list_facts(facts: DataFrame, documents: DataFrame, document_id: str | None = None, search: str | None = None, limit: int = 200) -> DataFrame:
    rows = facts if document_id is None else facts.where(F.col("document_id") == document_id)
    if search:
        rows = rows.where(like(F.col("subject"), search) | like(F.col("predicate"), search) | like(F.col("raw_value"), search))
    return newest(with_filename(rows, documents), limit)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def evidence_in_context(evidence: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    page = pages.select(F.col("id").alias("page_id"), "pdf_page_number", "printed_page_label")
    return with_filename(evidence.join(page, "page_id"), documents)


def facts_with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with their evidence as a list in the order of their evidence ids; unknown ids are left out."""
    one = facts.select("id", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    found = one.join(evidence.select(F.col("id").alias("evidence_id"), F.struct(*[c for c in evidence.columns]).alias("e")), "evidence_id")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "e"))).alias("x")).select("id", F.transform("x", lambda v: v["e"]).alias("evidence"))
    return facts.join(lists, "id", "left").withColumn("value", value_text(F.col("raw_value"), F.col("raw_unit")))


def expanded_relationships(relationships: DataFrame, facts: DataFrame, relationship_type: str | None = None, limit: int = 200) -> DataFrame:
    """The newest relationships with both facts; a row without one of its facts is dropped."""
    rows = relationships if relationship_type is None else relationships.where(F.col("relationship_type") == relationship_type)
    rows = newest(rows, limit)
    for side in ("a", "b"):
        rows = rows.join(facts.select(F.col("id").alias(f"fact_{side}_id"), F.struct(*facts.columns).alias(f"fact_{side}")), f"fact_{side}_id")
    return rows


def touching(relationships: DataFrame, facts: DataFrame, newest_rows: int = 2000, limit: int = 5) -> DataFrame:
    """Of the newest relationships the first that touch one of these facts on either side."""
    return touching_each(relationships, facts.select(F.lit(0).alias("query_id"), "id"), newest_rows, limit).drop("query_id", "rank")


def touching_each(relationships: DataFrame, facts: DataFrame, newest_rows: int = 2000, limit: int = 5) -> DataFrame:
    """For each question (facts: query_id, id), of the newest relationships the first that touch one of its facts on either side, with their rank."""
    recent = newest(relationships, newest_rows)
    ends = recent.select(F.col("id").alias("link"), F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact"))
    hit = ends.join(facts.select("query_id", F.col("id").alias("fact")), "fact").select("query_id", "link").distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("created_at"), "id")
    found = hit.join(recent, F.col("link") == F.col("id")).drop("link").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= limit)


def failed_pages(issues: DataFrame, evidence: DataFrame) -> DataFrame:
    """document_id, page_id of pages whose facts could not be extracted."""
    errors = issues.where(F.col("issue_type") == FACT_ERROR).select("document_id", "evidence_id")
    return errors.join(evidence.select(F.col("id").alias("evidence_id"), F.col("page_id")), "evidence_id").where("page_id is not null").select("document_id", "page_id").distinct()


def clear_errors(issues: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """The issues left when the extraction errors of pages that will be retried are cleared."""
    gone = evidence.join(pages.select("page_id"), "page_id", "left_semi").select(F.col("id").alias("evidence_id")).distinct()
    is_error = F.col("issue_type") == FACT_ERROR
    return issues.where(~is_error).unionByName(issues.where(is_error).join(gone, "evidence_id", "left_anti").select(*issues.columns))


def incomplete_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*UNFINISHED))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "document_id"]), F.struct("created_at", "id")).alias("j")).select("document_id", "j.*")


def pending_pages(pages: DataFrame, known: DataFrame, failed: DataFrame) -> DataFrame:
    """Pages to process: not yet marked as processed, or failed before."""
    done = known.where("processed_at is not null").select(F.col("id"), F.lit(True).alias("done"))
    bad = failed.select(F.col("page_id").alias("id"), F.lit(True).alias("bad")).distinct()
    return pages.join(done, "id", "left").join(bad, "id", "left").where("done is null or bad").select(*pages.columns)


def progress(pages: DataFrame) -> DataFrame:
    """Per document: pages, processed pages and progress up to 70."""
    done = F.count("processed_at")
    return pages.groupBy("document_id").agg(F.count("*").alias("pages_total"), done.alias("pages_done"), F.floor(F.lit(70) * done / F.greatest(F.count("*"), F.lit(1))).alias("progress"))


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere: an audit for the foreign keys that files don't enforce."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
