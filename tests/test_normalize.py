import pytest
from pyspark.sql import functions as F

from factspark.functions import ids, normalize, text

UNITS = [
    (73000.5, "INR million", "₹73,000.5 million", 7300.05, "INR crore"), (612.0, "Cr", "₹612 Cr", 612.0, "INR crore"), (80.0, "lakh", "₹80 lakh", 0.8, "INR crore"), (3.4, "EUR billion", "€3.4 billion", 340.0, "EUR crore"),
    (2.0, "bn", "£2 bn", 200.0, "GBP crore"), (7.25, "%", "7.25 per cent", 7.25, "%"), (41.0, None, "rose 41 percent", 41.0, "%"), (310.0, "trucks", "310 trucks", 310.0, "trucks"), (12.5, "Sq ft", "12.5Mn Sq ft", 12500000.0, "count"),
    (9.0, "thousand", "9 thousand", 9000.0, "count"), (None, "INR million", "", None, None), (-17.0, "Cr", "Rs. (17 Cr)", -17.0, "INR crore"), (0.0, "%", "0%", 0.0, "%"), (5.0, "  ", "5", 5.0, None),
]
PERIODS = [
    ("FY21", "2020-04-01", "2021-03-31"), ("fy 2019-20", "2019-04-01", "2020-03-31"), ("FY2021/22", "2021-04-01", "2022-03-31"), ("2022-23", "2022-04-01", "2023-03-31"), ("the year FY2030 alone", "2029-04-01", "2030-03-31"),
    ("Q1 FY24", "2023-04-01", "2023-06-30"), ("Q2FY24", "2023-07-01", "2023-09-30"), ("Q3 FY2024", "2023-10-01", "2023-12-31"), ("Q4 FY22", "2022-01-01", "2022-03-31"), ("H1 FY23", "2022-04-01", "2022-09-30"), ("H2 FY23", "2022-10-01", "2023-03-31"),
    ("June 5, 2023", "2023-06-05", "2023-06-05"), ("as at\nDecember 31 2022", "2022-12-31", "2022-12-31"), ("2021", "2021-01-01", "2021-12-31"), ("1887", None, None), ("as reported", None, None), (None, None, None),
    ("Q4 FY2023-24", "2023-01-01", "2023-03-31"), ("FY1999-00", "1899-04-01", "1900-03-31"), ("February 30, 2024", "2024-02-30", "2024-02-30"), ("FY2023-2024", "2023-04-01", "2024-03-31"),
]
STATUSES = [("a First Advance Estimate of output", "first_advance_estimate"), ("an advance estimate", "advance_estimate"), ("actual, after the forecast", "forecast"), ("sales", None)]


def test_units(spark):
    df = spark.createDataFrame(UNITS, "n double, u string, r string, v double, k string")
    for row in df.select("*", normalize.value_unit(F.col("n"), F.col("u"), F.col("r")).alias("got")).collect():
        assert row.got.value == pytest.approx(row.v) if row.v is not None else row.got.value is None
        assert row.got.unit == row.k


def test_periods(spark):
    df = spark.createDataFrame(PERIODS, "label string, a string, b string")
    for row in df.select("*", normalize.period(F.col("label")).alias("p")).collect():
        assert (row.p.start, row.p.end, row.p.label) == (row.a, row.b, row.label)


def test_status(spark):
    df = spark.createDataFrame(STATUSES, "t string, s string")
    assert all(r.s == r.got for r in df.select("*", normalize.status_of(F.col("t")).alias("got")).collect())


def test_ids_are_symmetric_and_depend_on_the_page(spark):
    c = F.lit
    r = spark.range(1).select(ids.relationship_id(c("fa_1"), c("fa_2")).alias("a"), ids.relationship_id(c("fa_2"), c("fa_1")).alias("b"), ids.page_id(c("d"), c(5)).alias("p"), ids.page_id(c("d"), c(6)).alias("q")).first()
    assert r.a == r.b and r.p != r.q and len(r.p) == 27


def test_query_string(spark):
    r = spark.createDataFrame([("What is FY24's revenue, 60%?",), ("",)], "q string").select(text.query_string(F.col("q")).alias("s")).collect()
    assert r[0].s == '"What" OR "is" OR "FY24" OR "revenue" OR "60%"' and r[1].s == '""'


def test_accents_are_folded(spark):
    words = {"Škoda": "skoda", "Łódź": "łodz", "Kőszeg": "koszeg", "MĀORI": "maori", "naïve": "naive", "plain": "plain", "straße": "straße"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.index_terms(F.col("w")).alias("t"), text.term_count(F.col("w")).alias("n")).collect()
    assert {r.w: r.t for r in got} == {w: [x] for w, x in words.items()} and all(r.n == 1 for r in got)
