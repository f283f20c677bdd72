"""Uploaded files as rows, with a parser behind a small interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id, page_id
from ..functions.pages import complexity, file_title, may_hold_table, meaningful_table, printed_label, serialize_table
from ..functions.tables import read_html

#: content bytes -> a page each: text, width, height, images, drawings, tables (rows of cells)
Parser = Callable[[bytes], list[dict]]
PARSED = "document_id string, pdf_page_number int, raw_text string, width double, height double, images int, drawings int, tables array<array<array<string>>>"


def read_uploads(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Documents in a folder, one for each content hash; other suffixes are refused by the glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    sha = F.sha2("content", 256)
    rows = files.select(document_id(sha).alias("id"), name.alias("filename"), sha.alias("sha256"), file_title(name).alias("title"), F.col("path").alias("file_path"), F.col("modificationTime").alias("created_at"), "content")
    return rows.dropDuplicates(["id"])


def text_parser(content: bytes) -> list[dict]:
    """The default: UTF-8 text with form feeds between pages."""
    return [{"raw_text": t, "width": 612.0, "height": 792.0, "images": 0, "drawings": 0, "tables": []} for t in content.decode("utf-8", "replace").split("\f")]


def html_parser(content: bytes) -> list[dict]:
    """One page of UTF-8 HTML: the text outside of tables, and the tables as grids."""
    text, tables = read_html(content.decode("utf-8", "replace"))
    return [{"raw_text": text, "width": 612.0, "height": 792.0, "images": 0, "drawings": 0, "tables": tables}]


def parse_pages(documents: DataFrame, parser: Parser = text_parser) -> tuple[DataFrame, DataFrame]:
    """(pages, issues). A file that the parser refuses gives an issue and no page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, content in zip(frame["id"], frame["content"], strict=True):
                try:
                    out += [{"document_id": doc, "pdf_page_number": i, **page} for i, page in enumerate(parser(bytes(content)), 1)]
                except Exception as error:  # one broken file must not end the job; it becomes an issue
                    out.append({"document_id": doc, "pdf_page_number": 0, "raw_text": f"{type(error).__name__}: {error}"[:500], "width": 0.0, "height": 0.0, "images": 0, "drawings": 0, "tables": []})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PARSED.replace("array<array<array<string>>>", "x").split(", ")])

    parsed = documents.select("id", "content").mapInPandas(run, PARSED)
    tables = F.when(may_hold_table(F.col("raw_text")), F.filter("tables", meaningful_table)).otherwise(F.array().cast("array<array<array<string>>>"))
    good = parsed.where("pdf_page_number > 0")
    pages = good.select(page_id(F.col("document_id"), F.col("pdf_page_number")).alias("id"), "document_id", "pdf_page_number", printed_label(F.col("raw_text")).alias("printed_page_label"), "raw_text", "width", "height", "images", "drawings", F.transform(tables, serialize_table).alias("tables"))
    score = complexity(F.col("raw_text"), F.col("images"), F.col("drawings"), F.col("width") * F.col("height"), F.size("tables"))
    pages = pages.withColumn("c", score).select("*", F.col("c.is_complex").alias("is_complex"), F.col("c.reason").alias("complexity_reason")).drop("c")
    issues = parsed.where("pdf_page_number = 0").select("document_id", F.lit("page_processing_error").alias("issue_type"), F.col("raw_text").alias("description"))
    return pages, issues


def page_counts(documents: DataFrame, parser: Parser = text_parser) -> DataFrame:
    """id, page_count; 0 for files that can't be read."""
    pages, _ = parse_pages(documents, parser)
    counts = pages.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("page_count"))
    return documents.select("id").join(counts, "id", "left").fillna(0, ["page_count"])
