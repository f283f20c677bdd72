"""Fact extraction as a table function for SQL: `LATERAL extract_facts(text)`, or over a table by partitions.

  SELECT p.id, f.* FROM pages p, LATERAL extract_facts(p.text) f
  SELECT * FROM extract_facts(TABLE(pages) PARTITION BY document_id ORDER BY pdf_page_number)

The first form gives the facts of each text. The second takes a table with a column text, keeps its other columns, and numbers the facts of a partition in the order of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import FACT_TEXT_MAX, FACT_TEXT_MIN
from .models import rule_extractor

#: A fact's fields, named and typed as in models.EXTRACTED_FACT.
FIELDS = [
    *(T.StructField(n, T.StringType()) for n in ("subject", "predicate", "raw_value", "raw_unit")), T.StructField("numeric_value", T.DoubleType()), *(T.StructField(n, T.StringType()) for n in ("period_label", "scope", "status")),
    T.StructField("qualifiers", T.MapType(T.StringType(), T.StringType())), T.StructField("supporting_quote", T.StringType()), T.StructField("confidence", T.DoubleType()),
]
BLANK = " \t\n\x0b\x0c\r"


def extracted(text: str | None, extractor: Callable[[str], list[dict]]) -> list[tuple]:
    """A text's facts as rows; none of a text too short to hold any."""
    if text is None or len(text.strip(BLANK)) < FACT_TEXT_MIN:
        return []
    return [tuple(fact.get(f.name) for f in FIELDS) for fact in extractor(text[:FACT_TEXT_MAX])]


def register(spark: SparkSession, name: str = "extract_facts", extractor: Callable[[str], list[dict]] = rule_extractor) -> None:
    """Registers the table function in a session."""

    class ExtractFacts:
        def __init__(self):
            self.n = 0

        @staticmethod
        def analyze(source: AnalyzeArgument) -> AnalyzeResult:
            if not source.isTable:
                if not isinstance(source.dataType, (T.StringType, T.NullType)):
                    raise ValueError(f"{name} takes a string or a table, not {source.dataType.simpleString()}")
                return AnalyzeResult(schema=T.StructType(FIELDS))
            if "text" not in source.dataType.names:
                raise ValueError(f"{name} takes a table with a column text")
            taken = {f.name for f in FIELDS} | {"position"}
            if clash := sorted(taken & set(source.dataType.names)):
                raise ValueError(f"{name} adds columns that the table has: {', '.join(clash)}")
            kept = [f for f in source.dataType.fields if f.name != "text"]
            return AnalyzeResult(schema=T.StructType([*kept, T.StructField("position", T.LongType()), *FIELDS]))

        def eval(self, source):
            if source is None or isinstance(source, str):
                yield from extracted(source, extractor)
                return
            kept = tuple(v for k, v in source.asDict(recursive=False).items() if k != "text")
            for fact in extracted(source["text"], extractor):
                yield (*kept, self.n, *fact)
                self.n += 1

    spark.udtf.register(name, F.udtf(ExtractFacts))
