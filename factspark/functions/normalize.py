"""Values, units, periods and statuses in one form, as pure column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for magnitudes with their factors, currency signs, the order of statuses, English months.
MAGNITUDES = {"thousand": 1e3, "lakh": 1e5, "lac": 1e5, "million": 1e6, "mn": 1e6, "crore": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9}
SIGNS = {"₹": "INR", "$": "USD", "€": "EUR", "£": "GBP"}
CURRENCY_WORDS = r"(?i)\b(INR|USD|EUR|GBP|Rs\.?|Rupees?)\b"
STATUSES = {
    "first advance estimate": "first_advance_estimate", "second advance estimate": "second_advance_estimate", "advance estimate": "advance_estimate",
    "provisional": "provisional", "projection": "projection", "projected": "projection", "forecast": "forecast", "target": "target", "estimate": "estimate", "actual": "actual",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CRORE = 1e7


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else null."""
    head, *rest = cases
    return reduce(lambda so_far, case: so_far.when(*case), rest, F.when(*head))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def empty_as_null(text: Column) -> Column:
    return F.when(text != "", text)


def magnitude(text: Column) -> Column:
    """The factor of the first magnitude word, longer words before shorter ones; it may follow a digit without a space."""
    low = F.lower(text)
    by_length = sorted(MAGNITUDES, key=len, reverse=True)
    return first_of([(low.rlike(rf"(?:\b|(?<=\d)){word}s?\b"), F.lit(MAGNITUDES[word])) for word in by_length])


def currency(text: Column) -> Column:
    word = F.upper(F.regexp_extract(text, CURRENCY_WORDS, 1))
    named = F.when(word.startswith("RS") | word.startswith("RUPEE"), "INR").otherwise(empty_as_null(word))
    return F.coalesce(first_of([(text.contains(sign), F.lit(code)) for sign, code in SIGNS.items()]), named)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def value_unit(number: Column, unit: Column, raw: Column) -> Column:
    """struct(value, unit): money in crore with its currency, bare magnitudes as counts, percentages and the rest as they are."""
    unit, raw = F.coalesce(unit, F.lit("")), F.coalesce(raw, F.lit(""))
    both = F.concat_ws(" ", unit, raw)
    percent = both.contains("%") | both.rlike(r"(?i)\bpercent(age)?\b")
    facts = F.struct(number.cast("double").alias("number"), unit.alias("unit"), F.coalesce(magnitude(unit), magnitude(raw)).alias("factor"), currency(both).alias("money"), percent.alias("percent"))

    def decided(x: Column) -> Column:
        n, factor, money = x["number"], x["factor"], x["money"]
        value = F.when(x["percent"] | factor.isNull(), n).when(money.isNotNull(), F.round(n * factor / CRORE, 4)).otherwise(n * factor)
        kind = F.when(x["percent"], "%").when(factor.isNull(), empty_as_null(strip(x["unit"]))).when(money.isNotNull(), F.concat(money, F.lit(" crore"))).otherwise("count")
        return F.struct(value.alias("value"), F.when(n.isNotNull(), kind).alias("unit"))

    return let(facts, decided)


#: Forms of period labels, the first that fits counts; what each captures, parted by bars, behind the form's name.
PERIODS = (
    ("half", r"\bH([12])\s*FY\s*(\d{2,4})\b", "$1|$2"),
    ("quarter", r"\bQ([1-4])\s*FY\s*(\d{2,4})\b", "$1|$2"),
    ("span", r"\bFY\s*(\d{4})\s*[-/]\s*(\d{2,4})\b", "$1|$2"),
    ("year", r"\bFY\s*(\d{2,4})\b", "$1"),
    ("day", rf"\b({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", "$1|$2|$3"),
    ("calendar", r"^((?:19|20)\d{2})$", "$1"),
    ("bare", r"^(20\d{2})[-/](\d{2})$", "$1|$2"),
)


def period(label: Column) -> Column:
    """struct(start, end, label) of a period label; fiscal years run from April to March and are named by their end.
    A label is matched once into its form and numbers; the rest is arithmetic on years."""
    text = strip(label)
    found = first_of([(text.rlike(f"(?i){pattern}"), F.concat(F.lit(f"{name}|"), F.regexp_replace(text, f"(?is)^.*?{pattern.removeprefix('^')}.*$", shown))) for name, pattern, shown in PERIODS])

    def full(year: Column) -> Column:
        return F.when(year < 100, year + 2000).otherwise(year)

    def bounds(p: Column) -> Column:
        form, one, two, three = (F.get(p, F.lit(i)) for i in range(4))
        a, b = one.cast("int"), two.cast("int")
        # the fiscal year's end, for the forms that name one
        joined = F.when(F.length(two) == 4, two).otherwise(F.concat(F.substring(one, 1, 2), two)).cast("int")
        end = full(F.when(form.isin("half", "quarter"), b).when(form.isin("span", "bare"), joined).when(form == "year", a))
        # quarters of the fiscal year that are covered: first and last
        first = F.when(form == "half", 2 * a - 1).when(form == "quarter", a).otherwise(1)
        last = F.when(form == "half", 2 * a).when(form == "quarter", a).otherwise(4)

        def at(year: Column, quarter: Column, rests: tuple[str, ...]) -> Column:
            return F.concat(F.when(quarter == 4, year).otherwise(year - 1).cast("string"), F.element_at(F.array(*map(F.lit, rests)), quarter))

        month = first_of([(F.lower(one) == name, F.lit(f"{i:02d}")) for i, name in enumerate(MONTHS, 1)])
        date = F.concat_ws("-", three, month, F.lpad(two, 2, "0"))
        start = F.when(form == "day", date).when(form == "calendar", F.concat(one, F.lit("-01-01"))).otherwise(at(end, first, ("-04-01", "-07-01", "-10-01", "-01-01")))
        stop = F.when(form == "day", date).when(form == "calendar", F.concat(one, F.lit("-12-31"))).otherwise(at(end, last, ("-06-30", "-09-30", "-12-31", "-03-31")))
        return F.struct(start.alias("start"), stop.alias("end"))

    none = F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    return let(F.struct(F.when(found.isNotNull(), F.split(found, r"\|")).alias("p"), F.when(label != "", text).alias("label")), lambda x: let(F.when(x["p"].isNotNull(), bounds(x["p"])).otherwise(none), lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"), x["label"].alias("label"))))


def status_of(*texts: Column) -> Column:
    """The first status whose phrase occurs in the texts, more exact ones first."""
    low = F.lower(F.concat_ws(" ", *(empty_as_null(t) for t in texts)))
    return first_of([(low.contains(phrase), F.lit(status)) for phrase, status in STATUSES.items()])


def given_or_inferred_status(given: Column, raw_value: Column, period_label: Column, qualifiers: Column) -> Column:
    return F.coalesce(empty_as_null(given), status_of(raw_value, period_label, F.array_join(F.transform(F.map_entries(qualifiers), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")))
