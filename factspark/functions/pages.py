"""What can be told of a page from its text, tables and counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import empty_as_null, strip

# Thresholds for complex pages, tables and chart texts.
DRAWINGS, SOME_DRAWINGS, DENSITY, SPARSE_CHARS, TABLE_DIGITS = 40, 5, 0.03, 400, 6
TABLE_FILL, TABLE_CELL, TABLE_CELLS = 0.35, 1.5, 15
CHART_WORDS = r"(?i)\b(chart|figure|exhibit|graph|fig\.)\b"
CHART_CHARS, CHART_DIGITS, CHART_CONFIDENCE = 60, 8, 0.35


def printed_label(text: Column) -> Column:
    """A page number or roman numeral alone on one of the first two or last two lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"), strip), lambda x: x != "")
    n = F.size(lines)
    ends = F.concat(F.slice(lines, 1, 2), F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return F.get(F.filter(ends, lambda x: x.rlike(r"^([ivxlcdmIVXLCDM]{1,6}|\d{1,4})$")), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9]"))


def may_hold_table(text: Column) -> Column:
    return digits(text) >= TABLE_DIGITS


def complexity(text: Column, images: Column, drawings: Column, area: Column, tables: Column | None = None) -> Column:
    """struct(is_complex, reason) from a page's text, its images and drawings, its area and its tables. Sparse text alone says nothing of a page
    without anything to see; naming a chart is a reason that makes no page complex."""
    raw = F.coalesce(text, F.lit(""))
    density = F.length(raw) / F.greatest(area, F.lit(1.0))
    sparse = (density < DENSITY) & (F.length(strip(raw)) < SPARSE_CHARS) & ((images >= 1) | (drawings >= SOME_DRAWINGS))
    reasons = [
        F.when(images >= 1, F.concat(images.cast("string"), F.lit(" embedded image(s)"))),
        F.when(drawings >= DRAWINGS, F.concat(drawings.cast("string"), F.lit(" vector drawing ops"))),
        F.when(raw.rlike(CHART_WORDS), "chart/figure keyword present"),
        F.when(sparse, F.format_string("low text density (%.4f) alongside visual content", density)),
    ]
    if tables is not None:
        reasons.append(F.when(tables >= 1, F.concat(tables.cast("string"), F.lit(" table(s) detected"))))
    return F.struct(((images >= 1) | (drawings >= DRAWINGS) | sparse).alias("is_complex"), F.concat_ws("; ", *reasons).alias("reason"))


def meaningful_table(rows: Column) -> Column:
    """Whether rows of cells are a table: two by two at least, mostly filled, not shreds of single signs."""
    cells = F.flatten(rows)
    filled = F.filter(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    length = F.aggregate(filled, F.lit(0).cast("long"), lambda n, c: n + F.length(c))
    sound = (F.size(rows) >= 2) & (width >= 2) & (F.size(filled) >= TABLE_FILL * F.size(cells)) & (F.size(filled) > 0)
    return F.coalesce(sound & ~((length < TABLE_CELL * F.size(filled)) & (F.size(filled) > TABLE_CELLS)), F.lit(False))


def serialize_table(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), " | ")), "\n")


def sufficient(text: Column, chars: int = CHART_CHARS, least_digits: int = CHART_DIGITS) -> Column:
    return (F.length(strip(F.coalesce(text, F.lit("")))) >= chars) & (digits(text) >= least_digits)


def page_prompt(text: Column, tables: Column) -> Column:
    """A page's text, then each table under its own heading, blank lines between."""
    named = F.transform(tables, lambda t, i: F.concat(F.lit("--- TABLE "), (i + 1).cast("string"), F.lit(" ---\n"), t))
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(text, F.lit(""))), named), lambda x: strip(x) != ""), "\n\n")


def chart_confidence(enough: Column, spatial_only: Column, model: Column) -> Column:
    return F.when(enough, F.lit(0.6)).when(spatial_only, F.lit(0.4)).otherwise(model)


def chart_accepted(has_data: Column, confidence: Column) -> Column:
    return F.coalesce(has_data & (confidence >= CHART_CONFIDENCE), F.lit(False))


def chart_summary(title: Column, values: Column, note: Column, default: str = "Chart") -> Column:
    return F.coalesce(empty_as_null(F.concat_ws("\n", *map(empty_as_null, (title, values, note)))), F.lit(default))


def file_title(name: Column) -> Column:
    """A file's name without its suffix, underscores and hyphens as spaces."""
    return F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  ")


def clamped_dpi(dpi: Column) -> Column:
    return F.least(F.greatest(dpi, F.lit(72)), F.lit(300))
