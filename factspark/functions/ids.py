"""Content-addressed identifiers, as columns. Missing parts count as empty, since concat_ws would skip them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefixes, the separator, and how many hexadecimal digits are kept.
PAGE, EVIDENCE, FACT, RELATIONSHIP, DOCUMENT, SEPARATOR, DIGITS, DOCUMENT_DIGITS, SEED_CHARS = "pg_", "ev_", "fa_", "rel_", "doc_", "||", 24, 20, 80


def hashed(prefix: str, *parts: Column) -> Column:
    text = F.concat_ws(SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, DIGITS))


def document_id(sha256: Column) -> Column:
    return F.concat(F.lit(DOCUMENT), F.substring(sha256, 1, DOCUMENT_DIGITS))


def page_id(document: Column, number: Column) -> Column:
    return hashed(PAGE, document, number)


def evidence_id(document: Column, page: Column, kind: Column, index: Column, seed: Column) -> Column:
    return hashed(EVIDENCE, document, page, kind, index, F.substring(seed, 1, SEED_CHARS))


def fact_id(document: Column, evidence_ids: Column, subject: Column, predicate: Column, raw_value: Column, period_label: Column) -> Column:
    return hashed(FACT, document, F.array_join(F.array_sort(evidence_ids), ","), subject, predicate, raw_value, period_label)


def relationship_id(a: Column, b: Column) -> Column:
    return hashed(RELATIONSHIP, F.least(a, b), F.greatest(a, b))
