"""Registered queries over the star-schema tables, with their SQL. Facts are derived from orders and customers by FACTS."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, normalize, pages, tables, text
from ..operators import catalog, layout, merge, neighbours, relate, retrieval, wording
from ..operators.textindex import TextIndex
from ..sources.staging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Facts that reach every branch of the normalisers; the same text runs in Spark and as the oracle's first part.
FACTS = """
SELECT k * 2 + copy AS id, k, copy, 'd' || CAST(custkey % 50 AS STRING) AS document_id, subject, predicate,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN -floor(price * scale * 100E0) / 100E0 ELSE floor(price * scale * 100E0) / 100E0 END AS numeric_value,
  CASE k % 8 WHEN 0 THEN 'INR million' WHEN 1 THEN 'Cr' WHEN 2 THEN 'USD billion' WHEN 3 THEN 'lakh' WHEN 4 THEN '%' WHEN 5 THEN 'employees' WHEN 6 THEN 'Bn' ELSE NULL END AS raw_unit,
  CASE k % 6 WHEN 0 THEN '$12 million' WHEN 1 THEN 'Rs. 12 Cr' WHEN 2 THEN '12Mn' WHEN 3 THEN '5 percent' WHEN 4 THEN '12' ELSE '100 thousand' END AS raw_value,
  CASE k % 10 WHEN 0 THEN 'FY' || lpad(CAST(y % 100 AS STRING), 2, '0') WHEN 1 THEN 'FY' || CAST(y AS STRING) || '-' || lpad(CAST((y + 1) % 100 AS STRING), 2, '0')
    WHEN 2 THEN 'FY' || CAST(y AS STRING) || '/' || lpad(CAST((y + 1) % 100 AS STRING), 2, '0') WHEN 3 THEN 'Q' || CAST(1 + k % 4 AS STRING) || ' FY' || lpad(CAST(y % 100 AS STRING), 2, '0')
    WHEN 4 THEN 'H' || CAST(1 + k % 2 AS STRING) || ' FY' || lpad(CAST(y % 100 AS STRING), 2, '0') WHEN 5 THEN CAST(y AS STRING)
    WHEN 6 THEN CAST(y + 25 AS STRING) || '-' || lpad(CAST((y + 26) % 100 AS STRING), 2, '0') WHEN 7 THEN 'March 31, ' || CAST(y AS STRING) WHEN 8 THEN 'as reported' ELSE NULL END AS period_label,
  CASE (k + copy * (k % 3)) % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' ELSE NULL END AS scope,
  CASE k % 5 WHEN 0 THEN 'per the First Advance Estimates' WHEN 1 THEN 'provisional' WHEN 2 THEN 'forecast' WHEN 3 THEN 'the actual figure' ELSE 'none given' END AS status_text
FROM (SELECT o_orderkey AS k, o_custkey AS custkey, c_name AS subject, o_totalprice AS price, CAST(year(o_orderdate) AS INT) AS y, copies.copy AS copy,
    CASE o_orderkey % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'ebitda' WHEN 2 THEN 'revenue YoY growth' ELSE 'revenue QoQ growth' END AS predicate,
    CASE WHEN copies.copy = 0 THEN 1.0E0 WHEN o_orderkey % 60 = 0 THEN 1.005E0 WHEN o_orderkey % 60 = 20 THEN 1.1E0 ELSE 2.0E0 END AS scale
  FROM {orders} orders JOIN {customer} customer ON o_custkey = c_custkey JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) copies ON copies.copy = 0 OR o_orderkey % 20 = 0) AS base
"""
ORACLE_FACTS = "WITH f AS (" + FACTS.format(orders="orders", customer="customer") + ")"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, made of source, over all cores where source has fewer files than cores, for work that costs far more than moving the rows; a table of many
    files is left as Spark splits it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(source.inputFiles()) < cores else df


def facts_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return spark.sql(FACTS, orders=spread(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), orders), customer=load(spark, sf_dir, "customer"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def case(pairs: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def sql_magnitude(x: str) -> str:
    return case([(rf"regexp_matches(lower({x}), '(?:\b|[0-9]){w}s?\b')", f"{f:.1f}") for w, f in sorted(normalize.MAGNITUDES.items(), key=lambda i: -len(i[0]))])


SQL_UNITS = rf""", m AS (SELECT *, coalesce(raw_unit, '') AS u, coalesce(raw_unit, '') || ' ' || raw_value AS b FROM f),
c AS (SELECT *, coalesce({sql_magnitude('u')}, {sql_magnitude('raw_value')}) AS mag, b LIKE '%\%%' ESCAPE '\' OR regexp_matches(b, '(?i)\bpercent(age)?\b') AS pct,
  upper(regexp_extract(b, '(?i)\b(INR|USD|EUR|GBP|Rs\.?|Rupees?)\b', 1)) AS w FROM m),
n AS (SELECT *, CASE WHEN b LIKE '%$%' THEN 'USD' WHEN w LIKE 'RS%' OR w LIKE 'RUPEE%' THEN 'INR' ELSE nullif(w, '') END AS cur FROM c),
v AS (SELECT *, CASE WHEN pct OR mag IS NULL THEN numeric_value WHEN cur IS NOT NULL THEN round(numeric_value * mag / 1e7, 4) ELSE numeric_value * mag END AS normalized_value,
  CASE WHEN numeric_value IS NULL THEN NULL WHEN pct THEN '%' WHEN mag IS NULL THEN nullif(trim(u), '') WHEN cur IS NOT NULL THEN cur || ' crore' ELSE 'count' END AS normalized_unit FROM n)"""


def fy(y: str) -> str:
    return f"(CASE WHEN CAST({y} AS INTEGER) < 100 THEN CAST({y} AS INTEGER) + 2000 ELSE CAST({y} AS INTEGER) END)"


def rx(p: str, g: int) -> str:
    return f"regexp_extract(period_label, '{p}', {g})"


H, Q, S, Y, D = r"(?i)\bH([12])\s*FY\s*(\d{2,4})\b", r"(?i)\bQ([1-4])\s*FY\s*(\d{2,4})\b", r"(?i)\bFY\s*(\d{4})\s*[-/]\s*(\d{2,4})\b", r"(?i)\bFY\s*(\d{2,4})\b", r"(?i)\b(March)\s+(\d{1,2}),?\s+(\d{4})\b"
SPAN_END = f"(CASE WHEN length({rx(S, 2)}) = 4 THEN {rx(S, 2)} ELSE substr({rx(S, 1)}, 1, 2) || {rx(S, 2)} END)"
SQL_PERIODS = f"""
  CASE WHEN regexp_matches(period_label, '{H}') THEN CASE WHEN {rx(H, 1)} = '1' THEN ({fy(rx(H, 2))} - 1) || '-04-01' ELSE ({fy(rx(H, 2))} - 1) || '-10-01' END
    WHEN regexp_matches(period_label, '{Q}') THEN CASE {rx(Q, 1)} WHEN '1' THEN ({fy(rx(Q, 2))} - 1) || '-04-01' WHEN '2' THEN ({fy(rx(Q, 2))} - 1) || '-07-01' WHEN '3' THEN ({fy(rx(Q, 2))} - 1) || '-10-01' ELSE {fy(rx(Q, 2))} || '-01-01' END
    WHEN regexp_matches(period_label, '{S}') THEN ({fy(SPAN_END)} - 1) || '-04-01' WHEN regexp_matches(period_label, '{Y}') THEN ({fy(rx(Y, 1))} - 1) || '-04-01'
    WHEN regexp_matches(period_label, '{D}') THEN {rx(D, 3)} || '-03-' || {rx(D, 2)} WHEN regexp_full_match(period_label, '(19|20)\\d{{2}}') THEN period_label || '-01-01'
    WHEN regexp_full_match(period_label, '20\\d{{2}}[-/]\\d{{2}}') THEN (CAST(substr(period_label, 1, 2) || substr(period_label, 6, 2) AS INTEGER) - 1) || '-04-01' END AS period_start,
  CASE WHEN regexp_matches(period_label, '{H}') THEN CASE WHEN {rx(H, 1)} = '1' THEN ({fy(rx(H, 2))} - 1) || '-09-30' ELSE {fy(rx(H, 2))} || '-03-31' END
    WHEN regexp_matches(period_label, '{Q}') THEN CASE {rx(Q, 1)} WHEN '1' THEN ({fy(rx(Q, 2))} - 1) || '-06-30' WHEN '2' THEN ({fy(rx(Q, 2))} - 1) || '-09-30' WHEN '3' THEN ({fy(rx(Q, 2))} - 1) || '-12-31' ELSE {fy(rx(Q, 2))} || '-03-31' END
    WHEN regexp_matches(period_label, '{S}') THEN {fy(SPAN_END)} || '-03-31' WHEN regexp_matches(period_label, '{Y}') THEN {fy(rx(Y, 1))} || '-03-31'
    WHEN regexp_matches(period_label, '{D}') THEN {rx(D, 3)} || '-03-' || {rx(D, 2)} WHEN regexp_full_match(period_label, '(19|20)\\d{{2}}') THEN period_label || '-12-31'
    WHEN regexp_full_match(period_label, '20\\d{{2}}[-/]\\d{{2}}') THEN CAST(substr(period_label, 1, 2) || substr(period_label, 6, 2) AS INTEGER) || '-03-31' END AS period_end"""
SQL_STATUS = case([(f"contains(lower(status_text), '{p}')", f"'{s}'") for p, s in normalize.STATUSES.items()])


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(facts_src(spark, sf_dir))


def normalise(f: DataFrame) -> DataFrame:
    f = f.withColumn("n", normalize.value_unit(F.col("numeric_value"), F.col("raw_unit"), F.col("raw_value"))).withColumn("p", normalize.period(F.col("period_label")))
    return f.withColumns({"normalized_value": F.col("n.value"), "normalized_unit": F.col("n.unit"), "period_start": F.col("p.start"), "period_end": F.col("p.end"), "status": normalize.status_of(F.col("status_text"))}).drop("n", "p")


@query(ORACLE_FACTS + SQL_UNITS + " SELECT id, normalized_value, normalized_unit FROM v")
def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("id", "normalized_value", "normalized_unit")


@query(ORACLE_FACTS + f" SELECT id, {SQL_PERIODS}, period_label FROM f")
def normalize_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("id", "period_start", "period_end", "period_label")


@query(ORACLE_FACTS + f" SELECT id, {SQL_STATUS} AS status FROM f")
def infer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir).select("id", "status")


@query(ORACLE_FACTS + SQL_UNITS + f", z AS (SELECT *, {SQL_PERIODS} FROM v) SELECT normalized_unit, period_start, count(*) AS facts, CAST(sum(CAST(CASE WHEN normalized_unit = 'count' THEN round(normalized_value) ELSE normalized_value END AS DECIMAL(28,4))) AS DOUBLE) AS total FROM z GROUP BY 1, 2")
def facts_by_unit_and_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are made as exact decimals and shown as doubles; counts are whole numbers, so the noise of their factors is cut."""
    exact = F.when(F.col("normalized_unit") == "count", F.round("normalized_value")).otherwise(F.col("normalized_value")).cast("decimal(28,4)")
    return normalized(spark, sf_dir).groupBy("normalized_unit", "period_start").agg(F.count("*").alias("facts"), F.sum(exact).cast("double").alias("total"))


@query(ORACLE_FACTS + """ SELECT id, 'fa_' || substr(sha256(document_id || '||' || 'e' || id || ',' || 'f' || id || '||' || subject || '||' || predicate || '||' || raw_value || '||' || coalesce(period_label, '')), 1, 24) AS fact_id,
  'pg_' || substr(sha256(document_id || '||' || k), 1, 24) AS page_id, 'doc_' || substr(sha256(document_id), 1, 20) AS doc_id,
  'rel_' || substr(sha256(least(subject, predicate) || '||' || greatest(subject, predicate)), 1, 24) AS relationship_id,
  'ev_' || substr(sha256(document_id || '||' || k || '||text||0||' || substr(subject, 1, 80)), 1, 24) AS evidence_id FROM f""")
def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_src(spark, sf_dir)
    c = F.col
    evidence = F.array(F.concat(F.lit("f"), c("id").cast("string")), F.concat(F.lit("e"), c("id").cast("string")))
    return f.select(
        "id", ids.fact_id(c("document_id"), evidence, c("subject"), c("predicate"), c("raw_value"), c("period_label")).alias("fact_id"), ids.page_id(c("document_id"), c("k")).alias("page_id"),
        ids.document_id(F.sha2("document_id", 256)).alias("doc_id"), ids.relationship_id(c("predicate"), c("subject")).alias("relationship_id"), ids.evidence_id(c("document_id"), c("k"), F.lit("text"), F.lit(0), c("subject")).alias("evidence_id"),
    )


NUMBER = "CASE WHEN normalized_value = floor(normalized_value) THEN CAST(CAST(floor(normalized_value) AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(normalized_value AS VARCHAR) END"


@query(ORACLE_FACTS + SQL_UNITS + f""" SELECT id, concat_ws(chr(10), 'Subject: ' || subject, 'Metric: ' || predicate, 'Value: ' || trim(raw_value || ' ' || coalesce(raw_unit, '')), 'Normalized value: ' || {NUMBER} || ' ' || normalized_unit,
  'Period: ' || period_label, 'Scope: ' || scope, 'Status: ' || {SQL_STATUS}, 'Source: ' || document_id) AS retrieval_text, trim(raw_value || ' ' || coalesce(raw_unit, '')) AS shown FROM v""")
def fact_retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = normalized(spark, sf_dir)
    shown = text.fact_text(*(F.col(c) for c in ("subject", "predicate", "raw_value", "raw_unit", "normalized_value", "normalized_unit", "period_label", "scope", "status", "document_id")))
    return f.select("id", shown.alias("retrieval_text"), text.value_text(F.col("raw_value"), F.col("raw_unit")).alias("shown"))


@query("SELECT doc_id, trim('Document: ' || coalesce(nullif(source, ''), 'unknown') || chr(10) || 'Page: ' || (doc_id % 7) || chr(10) || chr(10) || coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS retrieval_text FROM documents")
def evidence_retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.evidence_text(F.col("source"), F.col("doc_id") % 7, F.col("text")).alias("retrieval_text"))


@query(ORACLE_FACTS + """ SELECT id, document_id, document_id AS document_filename, subject, predicate FROM f WHERE subject ILIKE '%yoy%' OR predicate ILIKE '%yoy%' OR raw_value ILIKE '%yoy%' ORDER BY k DESC, id LIMIT 200""")
def facts_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_src(spark, sf_dir).withColumn("created_at", F.col("k"))
    documents = f.select(F.col("document_id").alias("id"), F.col("document_id").alias("filename")).distinct()
    return catalog.list_facts(f, documents, search="YOY").select("id", "document_id", "document_filename", "subject", "predicate")


@query("""SELECT c_custkey AS id, c_name AS filename, coalesce(fc, 0) AS fact_count, coalesce(rc, 0) AS relationship_count, st AS latest_job_status FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS fc, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS rc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) r ON r.o_custkey = c_custkey""")
def documents_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    documents = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    facts = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"))
    links = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_a_id"))
    jobs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return catalog.list_documents(documents, facts, links, jobs)


@query("SELECT c_custkey AS id, c_name AS filename FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY 1")
def in_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return catalog.by_ids(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename")), wanted)


def lines_as_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("page_id"), F.col("l_quantity").alias("quantity"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS document_id FROM lineitem), o AS (SELECT document_id, list(id ORDER BY id DESC) AS ids FROM e GROUP BY 1)
SELECT o_orderkey AS id, array_to_string(ids, ',') AS evidence, o_orderpriority AS value FROM orders LEFT JOIN o ON document_id = o_orderkey""")
def facts_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = lines_as_evidence(spark, sf_dir).select("id", "document_id").distinct()
    known = evidence.groupBy("document_id").agg(F.sort_array(F.collect_list("id"), asc=False).alias("evidence_ids"))
    facts = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("raw_value"), F.lit(None).cast("string").alias("raw_unit"))
    facts = facts.join(known, "document_id", "left")
    return catalog.facts_with_evidence(facts, evidence).select("id", F.when(F.col("evidence").isNotNull(), F.array_join(F.transform("evidence", lambda e: e["id"].cast("string")), ",")).alias("evidence"), "value")


@query("SELECT l_orderkey * 100 + l_linenumber AS id, p_name AS printed_page_label, o_orderpriority AS document_filename, l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def evidence_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("pdf_page_number"), F.col("p_name").alias("printed_page_label"))
    documents = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filename"))
    return catalog.evidence_in_context(lines_as_evidence(spark, sf_dir), page, documents).select("id", "printed_page_label", "document_filename", "quantity")


def links_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("fact_a_id"), F.col("l_partkey").alias("fact_b_id"), F.col("l_returnflag").alias("relationship_type"), F.col("l_shipdate").alias("created_at"))


SQL_LINKS = "WITH r AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS fact_a_id, l_partkey AS fact_b_id, l_returnflag AS relationship_type, l_shipdate AS created_at FROM lineitem)"


@query(SQL_LINKS + ", n AS (SELECT * FROM r WHERE relationship_type = 'R' ORDER BY created_at DESC, id, fact_b_id LIMIT 200) SELECT n.id, fact_a_id, fact_b_id, a.o_totalprice AS price_a, b.o_totalprice AS price_b FROM n JOIN orders a ON a.o_orderkey = fact_a_id JOIN orders b ON b.o_orderkey = fact_b_id")
def relationships_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return catalog.expanded_relationships(links_from_lines(spark, sf_dir), facts, "R").select("id", "fact_a_id", "fact_b_id", F.col("fact_a.price").alias("price_a"), F.col("fact_b.price").alias("price_b"))


@query(SQL_LINKS + ", n AS (SELECT * FROM r ORDER BY created_at DESC, id LIMIT 2000) SELECT id, fact_a_id, fact_b_id FROM n WHERE fact_a_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') OR fact_b_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY created_at DESC, id LIMIT 5")
def relationships_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return catalog.touching(links_from_lines(spark, sf_dir), facts).select("id", "fact_a_id", "fact_b_id")


def issues_and_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", catalog.FACT_ERROR).otherwise(F.col("event_type"))
    issues = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("document_id"), (F.col("event_id") - F.col("event_id") % 3).alias("evidence_id"), kind.alias("issue_type"))
    evidence = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 4000).alias("page_id"))
    return issues, evidence


SQL_ISSUES = "WITH i AS (SELECT event_id AS id, user_id % 20 AS document_id, event_id - event_id % 3 AS evidence_id, CASE WHEN event_type = 'error' THEN 'fact_extraction_error' ELSE event_type END AS issue_type FROM events), e AS (SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_id % 4000 END AS page_id FROM events)"


@query(SQL_ISSUES + " SELECT DISTINCT document_id, page_id FROM i JOIN e ON e.id = evidence_id WHERE issue_type = 'fact_extraction_error' AND page_id IS NOT NULL")
def failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.failed_pages(*issues_and_evidence(spark, sf_dir))


@query(SQL_ISSUES + " SELECT id, document_id, evidence_id, issue_type FROM i WHERE NOT (issue_type = 'fact_extraction_error' AND evidence_id IN (SELECT id FROM e WHERE page_id IN (SELECT page_id FROM e JOIN i USING (id) GROUP BY page_id HAVING arg_max(issue_type, id) = 'fact_extraction_error')))")
def clear_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose newest event is an error are retried."""
    issues, evidence = issues_and_evidence(spark, sf_dir)
    newest = evidence.join(issues.select("id", "issue_type"), "id").where("page_id is not null").groupBy("page_id").agg(F.max_by("issue_type", "id").alias("newest"))
    return catalog.clear_errors(issues, evidence, newest.where(F.col("newest") == catalog.FACT_ERROR).select("page_id"))


def jobs_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


SQL_JOBS = "WITH j AS (SELECT o_orderkey AS id, o_custkey AS document_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status, o_orderdate AS created_at FROM orders)"


@query(SQL_JOBS + " SELECT id, document_id, status FROM j WHERE status IN ('queued', 'processing')")
def incomplete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.incomplete_jobs(jobs_from_orders(spark, sf_dir)).select("id", "document_id", "status")


@query(SQL_JOBS + " SELECT document_id, id, status FROM j QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_jobs(jobs_from_orders(spark, sf_dir)).select("document_id", "id", "status")


@query("SELECT page_id AS id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) OR page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    known = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("processed_at"))
    failed = labels.where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return catalog.pending_pages(load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), known, failed)


@query("SELECT l_orderkey AS document_id, count(*) AS pages_total, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS pages_done, CAST(floor(70 * count(CASE WHEN l_returnflag <> 'N' THEN 1 END) / greatest(count(*), 1)) AS BIGINT) AS progress FROM lineitem GROUP BY 1")
def ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return catalog.progress(line.select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("processed_at")))


def news_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a document; sign-ups find it, purchases end it, other events report one of its pages, which errors fail."""
    event, page = F.col("event_type"), F.col("event_id") % 97
    kind = F.when(event == "signup", "found").when(event == "purchase", "related").otherwise("page")
    n = F.floor(F.coalesce("value", F.lit(0.0)) % 10).cast("int")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("document_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(page % 7 == 0, page + 1000).otherwise(page).cast("int").alias("page"),
        (F.lit(10) + n).alias("pages"), (event != "error").alias("ok"), n.alias("facts"), n.alias("relationships"),
    )


@query("""WITH n AS (SELECT 'u' || user_id AS document_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'found' WHEN 'purchase' THEN 'related' ELSE 'page' END AS kind, event_id % 97 AS page,
  event_type <> 'error' AS ok, CAST(floor(coalesce(value, 0) % 10) AS BIGINT) AS n FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
p AS (SELECT document_id, page, arg_max(ok, seq) AS ok, arg_max(n, seq) AS n FROM n WHERE kind = 'page' GROUP BY 1, 2),
c AS (SELECT document_id, count(*) AS pages_done, count(*) FILTER (NOT ok) AS pages_failed, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS facts_extracted FROM p GROUP BY 1),
j AS (SELECT document_id, arg_max(kind, seq) FILTER (kind <> 'page') AS kind, coalesce(10 + arg_max(n, seq) FILTER (kind = 'found'), 0) AS pages_total, coalesce(arg_max(n, seq) FILTER (kind = 'related'), 0) AS relationships_found FROM n GROUP BY 1),
a AS (SELECT document_id, kind, pages_total, relationships_found, coalesce(pages_done, 0) AS pages_done, coalesce(pages_failed, 0) AS pages_failed, coalesce(facts_extracted, 0) AS facts_extracted FROM j LEFT JOIN c USING (document_id))
SELECT document_id, pages_total, pages_done, pages_failed, facts_extracted, relationships_found, CASE kind WHEN 'related' THEN 'completed' WHEN 'found' THEN 'processing' ELSE 'queued' END AS status,
  CASE WHEN kind = 'related' THEN 'completed' WHEN kind = 'found' AND pages_done >= pages_total THEN 'finding_relationships' WHEN kind = 'found' THEN 'processing_pages' ELSE 'queued' END AS stage,
  CAST(CASE WHEN kind = 'related' THEN 100 WHEN kind IS NULL THEN 0 WHEN pages_done >= pages_total THEN 75 ELSE 70 * pages_done // greatest(pages_total, 1) END AS INTEGER) AS progress FROM a""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from a stream of news that is run to its end."""
    from ..streaming.jobs import NEWS, job_rows, stream_jobs

    folder = shared_folder(spark, "jobs")
    news_from_events(spark, sf_dir).write.parquet(f"{folder}/news")
    stream_jobs(spark, spark.readStream.schema(NEWS).parquet(f"{folder}/news"), f"{folder}/blocks", f"{folder}/checkpoint").awaitTermination()
    return job_rows(spark, f"{folder}/blocks").drop("stalled")


def event_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return merge.one_per_key(e.where("event_id % 2 = 0"), ["user_id"], "event_id"), e.where("event_id % 2 = 1")


SQL_HALVES = "WITH o AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1), n AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_id % 2 = 1), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), s AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)"


@query(SQL_HALVES + " SELECT * FROM l UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM l)")
def merge_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_wins(*event_halves(spark, sf_dir), ["user_id"], "event_id")


@query(SQL_HALVES + " SELECT * FROM o UNION ALL SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM o)")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_wins(*event_halves(spark, sf_dir), ["user_id"], "event_id")


@query(SQL_HALVES + " SELECT coalesce(o.user_id, l.user_id) AS user_id, coalesce(o.event_id, l.event_id) AS event_id, coalesce(o.event_type, l.event_type) AS event_type, CASE WHEN l.user_id IS NOT NULL THEN l.value ELSE o.value END AS value FROM o FULL JOIN l ON o.user_id = l.user_id")
def merge_update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.update_columns(*event_halves(spark, sf_dir), ["user_id"], ["value"], "event_id")


FOLD = "strip_accents(lower(coalesce({x}, '')))"
SQL_BM25 = rf"""t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({FOLD.format(x='text')}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT item_id AS query_id, unnest(list_distinct(flatten(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9%]+'), lambda x: length(x) > 1)[1:12], lambda x: list_filter(regexp_split_to_array({FOLD.format(x='x')}, '[^\p{{L}}\p{{N}}]+'), lambda y: y <> ''))))) AS term FROM benchmark),
c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM t), tf AS (SELECT id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT term, mean, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS weight FROM d, c),
s AS (SELECT query_id, id, round(-sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN w USING (term) JOIN q USING (term) GROUP BY 1, 2),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s QUALIFY rank <= 20)"""


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    documents = load(spark, sf_dir, "documents")
    return retrieval.bm25(spread(documents.select("doc_id", "text"), documents), questions, id_col="doc_id")


@query("WITH " + SQL_BM25 + " SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM lexical")
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir)


@query("WITH " + SQL_BM25 + " SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM lexical")
def fts_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from a kept index: two merges bring all documents, one of them with texts that the third replaces and ids that it deletes."""
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    index = TextIndex(spark, shared_folder(spark, "index"))
    old = docs.where("id % 3 = 0").select("id", F.concat_ws(" ", "lang", F.reverse("text")).alias("text"))
    index.merge(docs.where("id % 3 = 2").select("id", "text").union(old).union(docs.select((-F.col("id") - 1).alias("id"), "lang")))
    index.merge(docs.where("id % 3 = 1"))
    index.merge(docs.where("id % 3 = 0"), docs.select((-F.col("id") - 1).alias("id")))
    return index.search(questions)


@query()
def near_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near neighbours of every vector from the graph of neighbour descent; approximate, tested against the exact ones."""
    v = load(spark, sf_dir, "embeddings")
    return neighbours.near_graph(v.select(F.col("vec_id").alias("id"), "embedding"), v.select(F.col("vec_id").alias("query_id"), "embedding"), relate.CANDIDATES, drop_self=True)


def sql_nearest(queries: str, k: int, drop_self: bool) -> str:
    return f"""nd AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))), 6) AS distance
  FROM ({queries}) q JOIN embeddings v ON {'q.vec_id <> v.vec_id' if drop_self else 'true'}), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM nd QUALIFY rank <= {k})"""


@query("WITH " + sql_nearest("SELECT * FROM embeddings", 5, True) + " SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM dense")
def knn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return retrieval.nearest(v.select(F.col("vec_id").alias("id"), "embedding"), v.select(F.col("vec_id").alias("query_id"), "embedding"), relate.CANDIDATES, drop_self=True)


@query("WITH " + SQL_BM25 + ", " + sql_nearest("SELECT v.* FROM embeddings v WHERE vec_id IN (SELECT item_id FROM benchmark)", 20, False) + """, a AS (SELECT query_id, id, rank, 0 AS l FROM dense UNION ALL SELECT query_id, id, rank, 1 FROM lexical),
g AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS seen, sum(CAST(1.0 AS DOUBLE) / (60 + rank)) AS exact FROM a GROUP BY 1, 2) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 12) DESC, seen) AS INTEGER) AS rank FROM g QUALIFY rank <= 15""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, items = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "benchmark")
    queries = v.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    dense = retrieval.nearest(v.select(F.col("vec_id").alias("id"), "embedding"), queries)
    return retrieval.hybrid(dense, lexical(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(r"""SELECT doc_id, CASE WHEN len(x) = 0 THEN '""' ELSE array_to_string(list_transform(x, lambda t: '"' || t || '"'), ' OR ') END AS match FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9%]+'), lambda t: length(t) > 1)[1:12] AS x FROM documents)""")
def fts_query_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.query_string(F.col("text")).alias("match"))


def copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates that pair each copied fact with its copy, and the normalised facts that they name."""
    raw = facts_src(spark, sf_dir)
    pairs = raw.where("copy = 1").select((F.col("id") - 1).alias("a_id"), F.col("id").alias("b_id"))
    named = pairs.select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return normalise(raw.join(named, "id", "left_semi")), pairs


SQL_RULES = ORACLE_FACTS + SQL_UNITS + f""", z AS (SELECT *, {SQL_PERIODS}, {SQL_STATUS} AS status FROM v), p AS (SELECT a.id AS a_id, b.id AS b_id, lower(coalesce(a.scope, '')) = lower(coalesce(b.scope, '')) AS sc, coalesce(a.status, '') = coalesce(b.status, '') AS st,
  abs(a.normalized_value - b.normalized_value) / greatest(abs(a.normalized_value), abs(b.normalized_value), 1e-9) AS gap FROM z a JOIN z b ON b.id = a.id + 1 AND a.copy = 0 AND a.k % 20 = 0
  WHERE a.normalized_value IS NOT NULL AND b.normalized_value IS NOT NULL AND a.normalized_unit = b.normalized_unit AND ((a.period_start IS NOT NULL AND a.period_start = b.period_start AND a.period_end = b.period_end) OR (a.period_start IS NULL AND a.period_label = b.period_label)))
SELECT a_id AS fact_a_id, b_id AS fact_b_id, CASE WHEN sc AND st AND gap <= 0.01 THEN 'CORROBORATES' WHEN sc AND st AND gap <= 0.15 THEN 'LIKELY_CONTRADICTION' WHEN sc AND st THEN 'CONTRADICTS' ELSE 'CONTEXT_RECONCILES' END AS relationship_type,
  CAST(CASE WHEN sc AND st AND gap <= 0.01 THEN 0.95 WHEN sc AND st AND gap <= 0.15 THEN 0.6 WHEN sc AND st THEN 0.75 WHEN NOT sc THEN 0.7 ELSE 0.65 END AS DOUBLE) AS confidence, CASE WHEN sc AND st THEN 'none' WHEN NOT sc THEN 'scope' ELSE 'estimate_vintage' END AS context_dimension FROM p"""


@query(SQL_RULES)
def relate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = relate.relate(*reversed(copies(spark, sf_dir)))
    return edges.select("fact_a_id", "fact_b_id", "relationship_type", "confidence", "context_dimension")


@query("SELECT * FROM (" + SQL_RULES + ") WHERE relationship_type <> 'CORROBORATES'")
def relate_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second pass finds where the corroborations of the first are known already, the other way round."""
    facts, pairs = copies(spark, sf_dir)
    first, _ = relate.relate(pairs, facts)
    known = first.where("relationship_type = 'CORROBORATES'").select(F.col("fact_b_id").alias("fact_a_id"), F.col("fact_a_id").alias("fact_b_id"))
    edges, _ = relate.relate(pairs, facts, known)
    return edges.select("fact_a_id", "fact_b_id", "relationship_type", "confidence", "context_dimension")


@query()
def relate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible pairs among each part's name and the next part's."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.col("p_type").alias("predicate"))
    a = part.select(*(F.col(c).alias(f"a_{c}") for c in part.columns))
    b = part.select(*(F.col(c).alias(f"b_{c}") for c in part.columns))
    return relate.plausible(a.join(b, F.col("b_id") == F.col("a_id") + 1)).select("a_id", "b_id", "subject_sim", "predicate_sim")


@query()
def similar_customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of customers' names that count as the same wording without being equal."""
    return wording.similar_wordings(load(spark, sf_dir, "customer"), relate.IDENTICAL, "c_name")


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' balances as facts of two reports: names differ by few signs, the second report adds a stop to the metric and moves the values a little."""
    s = load(spark, sf_dir, "supplier").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    none = F.lit(None).cast("string")
    return s.select(
        (F.col("s_suppkey") * 2 + F.col("copy")).cast("string").alias("id"), F.col("s_name").alias("subject"), F.when(F.col("copy") == 0, "closing account balance").otherwise("Closing account balance.").alias("predicate"),
        (F.col("s_acctbal") * F.when(F.col("copy") == 0, 1.0).otherwise(1.005)).alias("normalized_value"), F.lit("USD crore").alias("normalized_unit"), none.alias("period_start"), none.alias("period_end"),
        F.concat(F.lit("FY"), (F.col("s_nationkey") % 25 + 10).cast("string")).alias("period_label"), none.alias("scope"), none.alias("status"),
    )


@query()
def relate_near_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of all balances that the rules decide, found by their wording instead of by neighbours."""
    facts = balances(spark, sf_dir)
    edges, _ = relate.relate(wording.decidable(facts), facts)
    return edges.select("fact_a_id", "fact_b_id", "relationship_type", "confidence", "context_dimension")


@query(ORACLE_FACTS + " SELECT a.id AS a_id, b.id AS b_id, " + " OR ".join(f"(contains(lower(a.predicate), '{m}') <> contains(lower(b.predicate), '{m}'))" for m in text.MARKERS) + " AS asymmetric FROM f a JOIN f b ON b.k = a.k + 1")
def asymmetric_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_src(spark, sf_dir)
    a, b = f.select(F.col("id").alias("a_id"), F.col("k").alias("ak"), F.col("predicate").alias("pa")), f.select(F.col("id").alias("b_id"), F.col("k").alias("bk"), F.col("predicate").alias("pb"))
    return a.join(b, F.col("bk") == F.col("ak") + 1).select("a_id", "b_id", text.asymmetric_marker(F.col("pa"), F.col("pb")).alias("asymmetric"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS c FROM documents)
SELECT doc_id, list_filter(list_concat(x[1:2], x[greatest(len(x) - 1, 1):greatest(len(x) - 1, 1) + 1]), lambda y: regexp_full_match(y, '[ivxlcdmIVXLCDM]{1,6}|\d{1,4}'))[1] AS label, n >= 6 AS may_hold_table, c >= 60 AND n >= 8 AS sufficient, c >= 20 AS extractable FROM l""")
def page_text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", pages.printed_label(t).alias("label"), pages.may_hold_table(t).alias("may_hold_table"), pages.sufficient(t).alias("sufficient"), text.extractable(t).alias("extractable"))


@query(r"""WITH g AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda r: list_transform(string_split(r, ' | '), lambda c: trim(c))) AS rows FROM documents), h AS (SELECT doc_id, rows, flatten(rows) AS cells, list_filter(flatten(rows), lambda c: c <> '') AS filled FROM g)
SELECT doc_id, len(rows) >= 2 AND list_max(list_transform(rows, lambda r: len(r))) >= 2 AND len(filled) >= 0.35 * len(cells) AND len(filled) > 0 AND NOT (coalesce(list_sum(list_transform(filled, lambda c: length(c))), 0) < 1.5 * len(filled) AND len(filled) > 15) AS meaningful, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)) AS serialized FROM h""")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, r" \| "))
    return load(spark, sf_dir, "documents").select("doc_id", rows.alias("rows")).select("doc_id", pages.meaningful_table(F.col("rows")).alias("meaningful"), pages.serialize_table(F.col("rows")).alias("serialized"))


@query("""WITH w AS (SELECT l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS row, CAST(l_partkey % 400 AS DOUBLE) AS top, CAST(l_partkey % 400 + 10 AS DOUBLE) AS bottom FROM lineitem),
g AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY p ORDER BY row) > 14 THEN 1 ELSE 0 END AS new FROM w) SELECT p AS page_id, row, CAST(sum(new) OVER (PARTITION BY p ORDER BY row) AS BIGINT) AS cluster FROM g""")
def spatial_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    line = load(spark, sf_dir, "lineitem")
    top = (F.col("l_partkey") % 400).cast("double")
    rows = line.select(F.col("l_orderkey").alias("page_id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).cast("long").alias("row"), top.alias("top"), (top + 10).alias("bottom"))
    return layout.clusters(rows).select("page_id", "row", "cluster")


@query("""WITH RECURSIVE w AS (SELECT p, x, y, t, row_number() OVER (PARTITION BY p ORDER BY y, x, t) AS n
  FROM (SELECT l_orderkey AS p, CAST(l_suppkey % 50 * 10 AS DOUBLE) AS x, CAST(l_partkey % 30 * 2 AS DOUBLE) AS y, 'w' || l_partkey AS t FROM lineitem)),
r AS (SELECT *, y AS anchor, 0 AS row FROM w WHERE n = 1 UNION ALL
  SELECT w.*, CASE WHEN w.y - anchor <= 3 THEN anchor ELSE w.y END, CASE WHEN w.y - anchor <= 3 THEN row ELSE row + 1 END FROM r JOIN w ON w.p = r.p AND w.n = r.n + 1),
g AS (SELECT p, row, min(y) AS top, max(y + 10) AS bottom, string_agg(t, ' ' ORDER BY x, y, t) AS line FROM r GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY p ORDER BY row) > 14 THEN 1 ELSE 0 END AS new FROM g),
d AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY row) AS cluster FROM c), b AS (SELECT p, cluster, string_agg(line, chr(10) ORDER BY row) AS block FROM d GROUP BY 1, 2)
SELECT p AS page_id, string_agg(block, chr(10) || chr(10) ORDER BY cluster) AS text FROM b GROUP BY 1""")
def spatial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, clusters and clustered text of words laid out from line items."""
    line = load(spark, sf_dir, "lineitem")
    x, y = (F.col("l_suppkey") % 50 * 10).cast("double"), (F.col("l_partkey") % 30 * 2).cast("double")
    word = F.struct(x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 10).alias("y1"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"))
    made = line.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    return layout.clustered_text(layout.clusters(layout.row_table(made)))


@query("SELECT conv_id, CAST(floor(sum(length(text)) / 3.6) + 500 AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.token_estimate(F.sum(F.length("text"))).alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c IS NULL THEN 'not reported' WHEN c >= 0.85 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM (SELECT *, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity / 45 END AS c FROM lineitem)")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("l_quantity") <= 45, F.col("l_quantity") / 45)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.confidence_label(c).alias("label"))


@query(r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS raw, doc_id % 5 // 4 AS i, doc_id % 61 AS d, doc_id % 3 AS t, CAST(doc_id % 7 * 19997 AS DOUBLE) AS area FROM documents),
x AS (SELECT *, length(raw) / greatest(area, 1.0) AS density FROM p), y AS (SELECT *, density < 0.03 AND length(regexp_replace(raw, '^\s+|\s+$', '', 'g')) < 400 AND (i >= 1 OR d >= 5) AS sparse FROM x)
SELECT doc_id, i >= 1 OR d >= 40 OR sparse AS is_complex, concat_ws('; ', CASE WHEN i >= 1 THEN i || ' embedded image(s)' END, CASE WHEN d >= 40 THEN d || ' vector drawing ops' END,
  CASE WHEN regexp_matches(raw, '(?i)\b(chart|figure|exhibit|graph|fig\.)\b') THEN 'chart/figure keyword present' END, CASE WHEN sparse THEN 'low text density (' || printf('%.4f', density) || ') alongside visual content' END,
  CASE WHEN t >= 1 THEN t || ' table(s) detected' END) AS reason FROM y""")
def page_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = load(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    out = pages.complexity(F.col("text"), F.floor(n % 5 / 4), n % 61, (n % 7 * 19997).cast("double"), n % 3)
    return d.select("doc_id", out.alias("c")).select("doc_id", "c.*")


@query("SELECT event_id, CASE WHEN value > 50 THEN 0.6 WHEN value > 20 THEN 0.4 ELSE value / 20 END AS confidence, event_type <> 'click' AND CASE WHEN value > 50 THEN 0.6 WHEN value > 20 THEN 0.4 ELSE value / 20 END >= 0.35 AS accepted, coalesce(nullif(concat_ws(chr(10), nullif(event_type, 'view'), nullif(props, '')), ''), 'Chart') AS summary FROM events")
def chart_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = pages.chart_confidence(F.col("value") > 50, F.col("value") > 20, F.col("value") / 20)
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", confidence.alias("confidence"), pages.chart_accepted(F.col("event_type") != "click", confidence).alias("accepted"), pages.chart_summary(kind, F.col("props"), F.lit(None).cast("string")).alias("summary"))


@query("""WITH n AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS a, l_partkey AS b, l_shipdate AS made FROM lineitem ORDER BY made DESC, id LIMIT 2000),
f AS (SELECT o_custkey % 25 AS query_id, o_orderkey AS id FROM orders), h AS (SELECT DISTINCT query_id, n.id FROM n JOIN f ON f.id IN (n.a, n.b))
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY made DESC, id) AS INTEGER) AS rank FROM h JOIN n USING (id) QUALIFY rank <= 5""")
def relationships_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("query_id"), F.col("o_orderkey").alias("id"))
    return catalog.touching_each(links_from_lines(spark, sf_dir), facts).select("query_id", "id", "rank")


@query("SELECT o_orderkey AS id, o_custkey AS document_id, o_orderpriority AS issue_type FROM orders ORDER BY o_orderdate DESC, id LIMIT 200")
def issues_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    issues = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("issue_type"), F.col("o_orderdate").alias("created_at"))
    return catalog.list_issues(issues).select("id", "document_id", "issue_type")


@query("SELECT event_id, user_id FROM events ANTI JOIN supplier ON user_id = s_suppkey WHERE user_id IS NOT NULL")
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user is no supplier."""
    return catalog.missing_parents(load(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", load(spark, sf_dir, "supplier"), "s_suppkey")


@query("SELECT * FROM (SELECT doc_id, unnest(['doc_id', 'lang', 'n_chars', 'source']) AS key, unnest([CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), source]) AS value FROM documents) WHERE value IS NOT NULL")
def vector_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's metadata as its vector carries them: strings, without nulls."""
    from ..sources.models import clean_metadata

    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(clean_metadata(**{c: F.col(c) for c in ("doc_id", "lang", "n_chars", "source")})))


def pages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    table = F.when(F.col("source").isNotNull(), F.array(F.concat("source", F.lit(" | "), "lang"))).otherwise(F.array().cast("array<string>"))
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")).alias("document_id"), F.col("doc_id").alias("pdf_page_number"), F.col("text").alias("raw_text"), table.alias("tables"))


@query("""WITH p AS (SELECT doc_id, 'd' || (doc_id % 50) AS document_id, 'text' AS evidence_type, text, CAST(0.9 AS DOUBLE) AS c FROM documents
  UNION ALL SELECT doc_id, 'd' || (doc_id % 50), 'table', source || ' | ' || lang, CAST(0.85 AS DOUBLE) FROM documents WHERE source IS NOT NULL)
SELECT 'ev_' || substr(sha256(document_id || '||' || doc_id || '||' || evidence_type || '||0||' || substr(text, 1, 80)), 1, 24) AS id, document_id, doc_id AS page_id, evidence_type, c AS extraction_confidence
FROM p WHERE regexp_matches(coalesce(text, ''), '[^ \\t-\\r]')""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ingest import evidence_of

    return evidence_of(pages_from_documents(spark, sf_dir)).select("id", "document_id", "page_id", "evidence_type", "extraction_confidence")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web page for each order: a table of its lines, whose first column spans all of them, under a head that spans two columns."""
    # dealt before they are grouped, to all cores: the pages cost far more than the rows' size tells
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").repartition(tasks, "l_orderkey")
    lines = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("x"))
    n = F.size("x").cast("string")
    first = F.concat(F.lit('<td rowspan="'), n, F.lit('">'), F.col("x")[0]["l_returnflag"], F.lit("<table><tr><td>inner</table></td>"))
    row = F.transform("x", lambda r, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit("<td>"), r["l_partkey"].cast("string"), F.lit("<td> by&nbsp;<b>"), r["l_linestatus"], F.lit("</b>\n&amp; co</tr>")))
    html = F.concat(F.lit("<html><p>Order</p><table><thead><tr><th colspan=2>Lines: "), n, F.lit("</th><th>Mode</th></tr></thead><tbody>"), F.array_join(row, ""), F.lit("</tbody></table>"))
    return lines.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, arg_min(l_returnflag, (l_linenumber, l_partkey, l_returnflag, l_linestatus)) AS flag FROM lineitem GROUP BY 1)
SELECT l_orderkey AS page_id, CAST(0 AS INTEGER) AS position, 'Lines: ' || n || ' | Lines: ' || n || ' | Mode' || chr(10) || string_agg(flag || ' | ' || l_partkey || ' | by ' || l_linestatus || ' & co', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS text
FROM lineitem JOIN l USING (l_orderkey) GROUP BY l_orderkey, n""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of web pages as evidence text; those that are no tables, like the one cell within a cell, are left out."""
    found = order_pages(spark, sf_dir).select("page_id", F.filter(tables.html_tables("html"), pages.meaningful_table).alias("t"))
    return found.select("page_id", F.posexplode("t").alias("position", "rows")).select("page_id", "position", pages.serialize_table(F.col("rows")).alias("text"))


def pages_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with one sentence that holds a fact."""
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    sentence = F.concat("n_name", F.lit(" revenue was "), (key % 900 + 1).cast("string"), F.lit(" crore in FY"), (key % 20 + 10).cast("string"), F.lit("."))
    return c.select(key.cast("string").alias("id"), F.concat(F.lit("c"), key.cast("string")).alias("document_id"), F.lit(1).alias("pdf_page_number"), sentence.alias("raw_text"), F.array().cast("array<string>").alias("tables"))


@query("""SELECT 'c' || c_custkey AS document_id, split_part(n_name, ' ', 1) AS subject, trim(substr(n_name, length(split_part(n_name, ' ', 1)) + 1) || ' revenue') AS predicate, CAST(c_custkey % 900 + 1 AS DOUBLE) AS numeric_value,
  (c_custkey % 900 + 1) * 1e7 AS normalized_value, 'count' AS normalized_unit, (2009 + c_custkey % 20) || '-04-01' AS period_start, (2010 + c_custkey % 20) || '-03-31' AS period_end, true AS quote_found
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def ingest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to evidence to normalised facts, by the default extractor."""
    from .ingest import evidence_of, facts_of

    rows = pages_from_customers(spark, sf_dir)
    return facts_of(rows, evidence_of(rows)).select("document_id", "subject", "predicate", "numeric_value", "normalized_value", "normalized_unit", "period_start", "period_end", "quote_found")


@query("""SELECT 'c' || c_custkey AS document_id, split_part(n_name, ' ', 1) AS subject, trim(substr(n_name, length(split_part(n_name, ' ', 1)) + 1) || ' revenue') AS predicate, CAST(c_custkey % 900 + 1 AS VARCHAR) AS raw_value,
  'crore' AS raw_unit, CAST(c_custkey % 900 + 1 AS DOUBLE) AS numeric_value, 'FY' || (c_custkey % 20 + 10) AS period_label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def facts_by_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all pages, extracted from SQL by the table function."""
    from ..sources import udtf

    udtf.register(spark)
    return spark.sql("SELECT p.document_id, f.subject, f.predicate, f.raw_value, f.raw_unit, f.numeric_value, f.period_label FROM {pages} p, LATERAL extract_facts(p.raw_text) f", pages=pages_from_customers(spark, sf_dir))


@query("""WITH o AS (SELECT 'c' || o_custkey AS document_id, o_orderkey AS k, o_orderstatus <> 'F' OR o_orderkey % 9 = 0 AS p FROM orders)
SELECT document_id, count(*) AS pages_total, count(*) AS pages_done, CAST(0 AS BIGINT) AS pages_failed, CAST(sum(CASE WHEN NOT p THEN 0 WHEN k % 10 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS facts_extracted,
  CAST(0 AS BIGINT) AS relationships_found, 'processing' AS status, 'finding_relationships' AS stage, 75 AS progress, CAST(max(CASE WHEN p AND k % 10 = 5 THEN 1 ELSE 0 END) AS BIGINT) AS issues FROM o GROUP BY 1""")
def ingest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ingest run in which each customer is a document and each order a page. Pages of status F are done before, but for those with an error. Every
    fifth page holds a chart: half of them have enough words for it, the others need a reader that isn't there, which is told once for each document."""
    from .ingest import ingest_pages

    o = load(spark, sf_dir, "orders").where("o_orderkey is not null and o_custkey is not null").withColumn("k", F.col("o_orderkey"))
    k, text = F.col("k"), F.col("k").cast("string")
    document = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("document_id")

    def sentence(head: str, number, unit: str, year) -> F.Column:
        return F.concat(F.lit(head), number.cast("string"), F.lit(f" {unit} in FY"), year.cast("string"))

    rows = o.select(text.alias("id"), document, k.cast("int").alias("pdf_page_number"), sentence("Total revenue was ", k % 900 + 1, "crore", k % 20 + 10).alias("raw_text"), F.array().cast("array<string>").alias("tables"), (k % 5 == 0).alias("is_complex"))

    def word(y: float, t) -> F.Column:
        return F.struct(F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(90.0).alias("x1"), F.lit(y + 8).alias("y1"), t.alias("text"))

    long_ = F.array(word(0.0, sentence("Unit revenue was ", k % 900 + 100, "crore", F.lit(15))), word(10.0, sentence("Unit margin was ", k % 800 + 100, "lakh", F.lit(16))))
    words = o.where("k % 5 = 0").select(text.alias("page_id"), F.when(k % 10 == 0, long_).otherwise(F.array(word(0.0, F.lit("chart")))).alias("words"))
    known = o.where("o_orderstatus = 'F'").select(text.alias("id"), F.col("o_orderdate").alias("processed_at"))
    evidence = o.select(F.concat(F.lit("e"), text).alias("id"), text.alias("page_id"))
    errors = o.where("k % 9 = 0").select(F.concat(F.lit("i"), text).alias("id"), document, text.alias("page_id"), F.concat(F.lit("e"), text).alias("evidence_id"), F.lit(catalog.FACT_ERROR).alias("issue_type"), F.lit("no reply").alias("description"), F.lit(None).cast("double").alias("confidence"))
    run = ingest_pages(spread(rows, load(spark, sf_dir, "orders")), shared_folder(spark, "ingest"), known_pages=known, known_evidence=evidence, known_issues=errors, words=words)
    n = run.issues.groupBy("document_id").agg(F.count("*").alias("issues"))
    return run.jobs.drop("stalled").join(n, "document_id", "left").fillna(0, ["issues"])


@query()
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved context of questions about parts: facts by name, evidence by type, relationships of line items; tested against a plain version."""
    from .answer import answer

    part = load(spark, sf_dir, "part")
    facts = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("retrieval_text"), F.col("p_brand").alias("document_filename"))
    evidence = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("text"), F.col("p_brand").alias("document_filename"), F.col("p_size").alias("pdf_page_number"))
    questions = load(spark, sf_dir, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("What of "), "p_name").alias("question"))
    links = links_from_lines(spark, sf_dir).withColumn("reason", F.col("relationship_type"))
    return answer(questions, facts, evidence, links)["context"]
