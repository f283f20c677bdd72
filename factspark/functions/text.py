"""Texts for retrieval, display and ranking, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import empty_as_null, strip

# Markers that set two metrics apart, and limits of lengths and counts.
MARKERS = ("yoy", "y-o-y", "year-on-year", "year over year", "qoq", "q-o-q", "quarter-on-quarter", "quarter over quarter", "mom", "m-o-m", "month-on-month", "adj", "adjusted")
QUERY_TERMS, FACT_TEXT_MIN, FACT_TEXT_MAX = 12, 20, 20_000
CHARS_PER_TOKEN, TOKENS_EXTRA = 3.6, 500
NO_ANSWER = "Nothing in the stored documents bears on this question. Add a document that does, or ask in other words."
NO_CONTEXT = "(nothing was retrieved)"


def folds() -> tuple[str, str]:
    """Small letters that are an ASCII letter with one accent, and those letters."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    pairs = [(c, d[0]) for c, d in parts.items() if len(d) == 2 and d[0].isascii() and d[0].islower() and unicodedata.combining(d[1])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = folds()


def number_text(x: Column) -> Column:
    """A double without an exponent: whole numbers with one decimal, others as they are."""
    return F.when(x == F.floor(x), F.concat(F.floor(x).cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(x.cast("decimal(38,16)").cast("string"), r"0+$", ""))


def fact_text(subject: Column, predicate: Column, raw_value: Column, raw_unit: Column, value: Column, unit: Column, period: Column, scope: Column, status: Column, source: Column) -> Column:
    def line(name: str, x: Column) -> Column:
        return F.when(x.isNotNull() & (x != ""), F.concat(F.lit(f"{name}: "), x))

    shown = value_text(raw_value, raw_unit)
    normal = F.when(value.isNotNull() & unit.isNotNull() & (unit != ""), F.concat_ws(" ", number_text(value), unit))
    return F.concat_ws("\n", F.concat(F.lit("Subject: "), subject), F.concat(F.lit("Metric: "), predicate), line("Value", shown), line("Normalized value", normal), line("Period", period), line("Scope", scope), line("Status", status), line("Source", source))


def evidence_text(title: Column, page: Column, text: Column) -> Column:
    head = F.concat(F.lit("Document: "), F.coalesce(empty_as_null(title), F.lit("unknown")), F.lit("\nPage: "), page.cast("string"))
    return strip(F.concat(head, F.lit("\n\n"), F.coalesce(text, F.lit(""))))


def value_text(raw_value: Column, raw_unit: Column) -> Column:
    return empty_as_null(strip(F.concat(F.coalesce(raw_value, F.lit("")), F.lit(" "), F.coalesce(raw_unit, F.lit("")))))


def asymmetric_marker(a: Column, b: Column) -> Column:
    """Whether some marker occurs in exactly one of two predicates."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(a, m) != F.contains(b, m))


def query_terms(question: Column) -> Column:
    """The first twelve terms of more than one sign."""
    return F.slice(F.filter(F.regexp_extract_all(question, F.lit(r"([A-Za-z0-9%]+)"), F.lit(1)), lambda t: F.length(t) > 1), 1, QUERY_TERMS)


def query_string(question: Column) -> Column:
    """The terms quoted and joined by OR; a quoted empty term, which matches nothing, if there is none."""
    terms = query_terms(question)
    return F.when(F.size(terms) == 0, '""').otherwise(F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def folded(text: Column) -> Column:
    """Lower case without accents; most texts have none, which is told at once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def term_count(text: Column) -> Column:
    """How many terms index_terms gives."""
    return F.regexp_count(folded(text), F.lit(r"[\p{L}\p{N}]+"))


def index_terms(text: Column) -> Column:
    """Terms of a text or query for the index: lower case, accents folded, runs of letters and digits."""
    plain = folded(text)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def extractable(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= FACT_TEXT_MIN


def prompt_text(text: Column) -> Column:
    return F.substring(text, 1, FACT_TEXT_MAX)


def confidence_label(x: Column) -> Column:
    return F.when(x.isNull(), "not reported").when(x >= 0.85, "high").when(x >= 0.5, "medium").otherwise("low")


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)) + TOKENS_EXTRA


def answer_or_none(n_facts: Column, n_evidence: Column, answer: Column) -> Column:
    return F.when((n_facts == 0) & (n_evidence == 0), NO_ANSWER).otherwise(answer)
