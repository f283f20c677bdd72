"""From pages to evidence, facts and relationships."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, normalize, pages, text
from ..operators import catalog, layout
from ..operators import relate as relations
from ..operators.neighbours import near_graph
from ..operators.retrieval import nearest
from ..sources import files, models
from ..sources.staging import written
from ..streaming.jobs import NEWS, job_counters

CONFIDENCE = {"text": 0.9, "table": 0.85}


def evidence_of(page_rows: DataFrame, charts: DataFrame | None = None) -> DataFrame:
    """Evidence of pages (id, document_id, pdf_page_number, raw_text, tables) and of charts (page_id, document_id, pdf_page_number, text, confidence)."""
    shape = ("document_id", "page_id", "pdf_page_number", "evidence_type", "position", "text", "extraction_confidence")
    base = page_rows.select("document_id", F.col("id").alias("page_id"), "pdf_page_number", "raw_text", "tables")
    words = base.select("document_id", "page_id", "pdf_page_number", F.lit("text").alias("evidence_type"), F.lit(0).alias("position"), F.col("raw_text").alias("text"), F.lit(CONFIDENCE["text"]).alias("extraction_confidence"))
    tables = base.select("document_id", "page_id", "pdf_page_number", F.lit("table").alias("evidence_type"), F.posexplode("tables").alias("position", "text"), F.lit(CONFIDENCE["table"]).alias("extraction_confidence")).select(*shape)
    out = words.unionByName(tables)
    if charts is not None:
        out = out.unionByName(charts.select("document_id", "page_id", "pdf_page_number", F.lit("chart").alias("evidence_type"), F.lit(0).alias("position"), "text", F.col("confidence").alias("extraction_confidence")))
    out = out.where(normalize.strip(F.coalesce("text", F.lit(""))) != "")
    key = ids.evidence_id(F.col("document_id"), F.col("pdf_page_number"), F.col("evidence_type"), F.col("position"), F.col("text"))
    return out.withColumn("id", key)


def facts_of(page_rows: DataFrame, evidence: DataFrame, extractor=models.rule_extractor) -> DataFrame:
    """Normalised facts: one call for each page, over its text and tables; every fact has evidence."""
    return normalised_facts(models.extract_facts(page_units(page_rows, evidence), extractor))


def page_units(page_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """document_id, page_id, text, evidence_ids: what is asked of each page."""
    per_page = evidence.groupBy("page_id").agg(F.array_sort(F.collect_list("id")).alias("evidence_ids"))
    return page_rows.select("document_id", F.col("id").alias("page_id"), pages.page_prompt(F.col("raw_text"), F.col("tables")).alias("text")).join(per_page, "page_id").select("document_id", "page_id", "text", "evidence_ids")


def normalised_facts(extracted: DataFrame) -> DataFrame:
    found = extracted.where(F.size("evidence_ids") >= 1).select("document_id", "evidence_ids", F.col("text").alias("page_text"), F.explode("facts").alias("f")).select("document_id", "evidence_ids", "page_text", "f.*")
    value = normalize.value_unit(F.col("numeric_value"), F.col("raw_unit"), F.col("raw_value"))
    out = found.withColumn("n", value).withColumn("p", normalize.period(F.col("period_label"))).withColumn("status", normalize.given_or_inferred_status(F.col("status"), F.col("raw_value"), F.col("period_label"), F.col("qualifiers")))
    out = out.withColumns({"normalized_value": F.col("n.value"), "normalized_unit": F.col("n.unit"), "period_start": F.col("p.start"), "period_end": F.col("p.end"), "period_label": F.col("p.label"), "quote_found": F.contains("page_text", "supporting_quote"), "extraction_confidence": F.col("confidence")})
    key = ids.fact_id(F.col("document_id"), F.col("evidence_ids"), F.col("subject"), F.col("predicate"), F.col("raw_value"), F.col("period_label"))
    shown = text.fact_text(*(F.col(c) for c in ("subject", "predicate", "raw_value", "raw_unit", "normalized_value", "normalized_unit", "period_label", "scope", "status")), F.lit(None).cast("string"))
    return out.withColumn("id", key).withColumn("retrieval_text", shown).drop("n", "p", "page_text", "confidence").dropDuplicates(["id"])


#: New facts times facts, as far as they are compared exactly; beyond, candidates come from the graph of near neighbours.
EXACT_PAIRS = 10**10


def relationships_of(new_facts: DataFrame, facts: DataFrame, encoder=None, known: DataFrame | None = None, classifier=None, exact_pairs: int = EXACT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """New relationships of some facts with all, and pairs left for review: five nearest others of each, then wording and rules. Where more than exact_pairs pairs of
    facts would be compared, the five nearest are those of an approximate graph, whose work grows with the number of facts."""
    encoder = encoder or models.hashed_encoder()

    def encoded(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.xxhash64("id").alias(name), F.col("id").alias("fact"), encoder(F.col("retrieval_text")).alias("embedding"))

    base, asked = encoded(facts, "id"), encoded(new_facts, "query_id")
    find = nearest if base.count() * asked.count() <= exact_pairs else near_graph
    near = find(base.select("id", "embedding"), asked.select("query_id", "embedding"), relations.CANDIDATES, drop_self=True)
    pairs = near.join(asked.select("query_id", F.col("fact").alias("a_id")), "query_id").join(base.select("id", F.col("fact").alias("b_id")), "id")
    return relations.relate(pairs, facts, known, classifier)


#: What stands for a chart in which a reader finds nothing; from how many signs a chart's words are asked for facts.
NO_CHART, CHART_TEXT = "(no data found in the chart)", 21
ISSUE = "id string, document_id string, page_id string, evidence_id string, issue_type string, description string, confidence double"


def charts_of(page_rows: DataFrame, words: DataFrame, reader=None) -> DataFrame:
    """A row for each complex page: page_id, document_id, pdf_page_number, text, confidence, accepted, issue_type, description.

    words (page_id, words) are laid out by place first. Where that text is enough, or no reader is given, it is the chart's text; else
    reader takes page_id, text (a DataFrame) and returns page_id, has_data, title, values, note, confidence, uncertainty for pages that it could read.
    accepted says whether the text may be asked for facts. Pages that need a reader and get no answer have the issue vision_model_unavailable,
    unsure readings low_confidence_visual_extraction."""
    complex_ = page_rows.where("is_complex").select(F.col("id").alias("page_id"), "document_id", "pdf_page_number", "raw_text")
    own_words = words.join(complex_.select("page_id"), "page_id", "left_semi")
    laid = layout.clustered_text(layout.clusters(layout.row_table(own_words))).withColumnRenamed("text", "spatial")
    rows = complex_.join(laid, "page_id", "left").withColumn("spatial", F.coalesce("spatial", F.lit(""))).withColumn("enough", pages.sufficient(F.col("spatial")))
    spatial_only = F.col("spatial") != ""
    if reader is None:
        rows = rows.withColumns({"read": F.lit(None).cast("double"), "has_data": F.lit(False), "summary": F.lit(None).cast("string"), "unsure": F.lit(None).cast("string")})
    else:
        asked = rows.where(~F.col("enough")).select("page_id", F.when(spatial_only, F.col("spatial")).otherwise(F.col("raw_text")).alias("text"))
        summary = pages.chart_summary(F.col("title"), F.col("values"), F.col("note"), NO_CHART)
        rows = rows.join(reader(asked).select("page_id", F.coalesce("confidence", F.lit(0.0)).alias("read"), "has_data", summary.alias("summary"), F.col("uncertainty").alias("unsure")), "page_id", "left")
    enough, answered = F.col("enough"), F.col("read").isNotNull() & ~F.col("enough")
    sure = pages.chart_accepted(F.col("has_data"), F.col("read"))
    return rows.select(
        "page_id", "document_id", "pdf_page_number", F.when(answered, F.col("summary")).otherwise(F.col("spatial")).alias("text"),
        F.when(answered, F.col("read")).otherwise(pages.chart_confidence(enough, spatial_only, F.lit(None).cast("double"))).alias("confidence"),
        F.when(answered, sure).otherwise(F.length("spatial") >= CHART_TEXT).alias("accepted"),
        F.when(enough | answered & sure, None).when(answered, "low_confidence_visual_extraction").otherwise("vision_model_unavailable").alias("issue_type"),
        F.when(answered, F.coalesce("unsure", F.lit("The chart could not be read with confidence."))).otherwise("No reader answered; the words of the page stand for the chart.").alias("description"),
    )


class Ingested(NamedTuple):
    """The rows that one run adds, all issues that are left, and the job of each document."""

    pages: DataFrame
    evidence: DataFrame
    facts: DataFrame
    issues: DataFrame
    jobs: DataFrame
    relationships: DataFrame | None
    review: DataFrame | None


def ingest(uploads: DataFrame, folder: str, parser: files.Parser = files.text_parser, **options) -> Ingested:
    """Files (id, content, as read_uploads gives them) to pages, evidence, facts, issues and jobs; see ingest_pages."""
    parsed, refused = files.parse_pages(uploads, parser)
    return ingest_pages(written(parsed, f"{folder}/parsed"), folder, refused=written(refused, f"{folder}/refused"), **options)


def ingest_pages(page_rows: DataFrame, folder: str, refused: DataFrame | None = None, known_pages: DataFrame | None = None, known_evidence: DataFrame | None = None, known_issues: DataFrame | None = None, known_facts: DataFrame | None = None, words: DataFrame | None = None, reader=None, extractor=models.rule_extractor, attempts: int = 2, relate: bool = False) -> Ingested:
    """One run over pages (id, document_id, pdf_page_number, raw_text, tables; is_complex where words are given).

    Pages that are processed and whose facts could be extracted are left out (known_pages: id, processed_at; known_issues, known_evidence); the errors of pages
    that are tried again are cleared. A page whose extractor fails attempts times is done, without facts, and has an issue; a document that could not be
    read (refused: document_id, issue_type, description) has a failed job. With relate the new facts are compared with known_facts and each other.
    The rows of each step are written below folder once, so no page is parsed or asked twice."""
    spark = page_rows.sparkSession
    pending = page_rows
    issues = spark.createDataFrame([], ISSUE) if known_issues is None else known_issues.select(*(x.split()[0] for x in ISSUE.split(", ")))
    if known_pages is not None:
        failed = spark.createDataFrame([], "document_id string, page_id string") if known_evidence is None else catalog.failed_pages(issues, known_evidence)
        pending = catalog.pending_pages(page_rows, known_pages, failed)
    pending = written(pending, f"{folder}/pending")
    if known_evidence is not None:
        issues = catalog.clear_errors(issues, known_evidence, pending.select(F.col("id").alias("page_id")))
    charts = None if words is None else written(charts_of(pending, words, reader), f"{folder}/charts")
    evidence = written(evidence_of(pending, charts), f"{folder}/evidence")
    units = page_units(pending, evidence.where("evidence_type <> 'chart'"))
    if charts is not None:
        chart_rows = evidence.where("evidence_type = 'chart'").join(charts.where("accepted").select("page_id"), "page_id", "left_semi")
        units = units.unionByName(chart_rows.select("document_id", "page_id", "text", F.array("id").alias("evidence_ids")))
    extracted = written(models.extract_facts(units, extractor, attempts), f"{folder}/extracted")
    facts = written(normalised_facts(extracted.drop("error")), f"{folder}/facts")
    issues = issues.unionByName(new_issues(pending, evidence, extracted, charts, refused))
    news = job_news(page_rows, pending, extracted, facts, evidence, refused)
    links = review = None
    if relate:
        links, review = relationships_of(facts, facts if known_facts is None else known_facts.select(*facts.columns).unionByName(facts).dropDuplicates(["id"]))
        links = written(links, f"{folder}/relationships")
        owner = facts.select(F.col("id").alias("fact_a_id"), "document_id")
        per = links.join(owner, "fact_a_id").groupBy("document_id").agg(F.count("*").cast("int").alias("relationships"))
        done = news.where("kind = 'found'").select("document_id").join(per, "document_id", "left")
        news = news.unionByName(done.select("document_id", F.lit(2).cast("long").alias("seq"), F.lit("related").alias("kind"), F.coalesce("relationships", F.lit(0)).alias("relationships")), allowMissingColumns=True)
    return Ingested(pending, evidence, facts, issues, job_counters(news), links, review)


def new_issues(pending: DataFrame, evidence: DataFrame, extracted: DataFrame, charts: DataFrame | None, refused: DataFrame | None) -> DataFrame:
    """Issues of this run; a missing reader is told once for each document, on its first such page."""
    none = F.lit(None).cast("string")

    def issue(df: DataFrame, page, found, kind, text, confidence) -> DataFrame:
        key = ids.evidence_id(F.col("document_id"), F.coalesce(page, F.lit("")), kind, F.lit(0), F.coalesce(text, F.lit("")))
        return df.select(key.alias("id"), "document_id", page.alias("page_id"), found.alias("evidence_id"), kind.alias("issue_type"), text.alias("description"), confidence.alias("confidence"))

    nothing = F.lit(None).cast("double")
    out = issue(extracted.where("error is not null"), F.col("page_id"), F.col("evidence_ids")[0], F.lit(catalog.FACT_ERROR), F.col("error"), nothing)
    if refused is not None:
        out = out.unionByName(issue(refused, none, none, F.col("issue_type"), F.col("description"), nothing))
    if charts is not None:
        told = charts.where("issue_type is not null").join(evidence.where("evidence_type = 'chart'").select("page_id", F.col("id").alias("evidence_id")), "page_id", "left")
        place = F.struct("pdf_page_number", "page_id")
        once = told.where("issue_type = 'vision_model_unavailable'").groupBy("document_id").agg(F.min_by(F.struct(*[c for c in told.columns if c != "document_id"]), place).alias("t")).select("document_id", "t.*")
        rows = told.where("issue_type <> 'vision_model_unavailable'").unionByName(once.select(*told.columns))
        out = out.unionByName(issue(rows, F.col("page_id"), F.col("evidence_id"), F.col("issue_type"), F.col("description"), F.when(F.col("issue_type") != "vision_model_unavailable", F.col("confidence"))))
    return out


def job_news(page_rows: DataFrame, pending: DataFrame, extracted: DataFrame, facts: DataFrame, evidence: DataFrame, refused: DataFrame | None) -> DataFrame:
    """News of a run for the job counters, from pages done before (without facts of this run) and now."""
    found = page_rows.groupBy("document_id").agg(F.count("*").cast("int").alias("pages")).select("document_id", F.lit(1).cast("long").alias("seq"), F.lit("found").alias("kind"), "pages")
    owner = evidence.select(F.col("id").alias("evidence_id"), "page_id")
    n = facts.select("id", F.col("evidence_ids")[0].alias("evidence_id")).join(owner, "evidence_id").groupBy(F.col("page_id").alias("id")).agg(F.count("*").cast("int").alias("facts"))
    bad = extracted.where("error is not null").select(F.col("page_id").alias("id"), F.lit(True).alias("bad")).distinct()
    done = page_rows.select("id", "document_id", F.col("pdf_page_number").cast("int").alias("page")).join(n, "id", "left").join(bad, "id", "left")
    pages_done = done.select("document_id", F.lit(1).cast("long").alias("seq"), F.lit("page").alias("kind"), "page", (F.col("bad").isNull() | F.col("facts").isNotNull()).alias("ok"), F.coalesce("facts", F.lit(0)).alias("facts"))
    news = page_rows.sparkSession.createDataFrame([], NEWS).unionByName(found, allowMissingColumns=True).unionByName(pages_done, allowMissingColumns=True)
    if refused is not None:
        unread = refused.join(found.select("document_id"), "document_id", "left_anti").select("document_id").distinct()
        news = news.unionByName(unread.select("document_id", F.lit(1).cast("long").alias("seq"), F.lit("failed").alias("kind")), allowMissingColumns=True)
    return news
