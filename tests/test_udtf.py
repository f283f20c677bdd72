import pytest
from pyspark.sql import functions as F

from factspark.sources import udtf
from factspark.sources.models import extract_facts

ROWS = [
    ("d1", 2, "Acme revenue was 5 crore in FY23. Acme Ltd profit was (12.5) million in FY22."), ("d1", 1, "Delta India revenue stood at 40% in FY21 and more words."), ("d2", 1, "short"), ("d2", 2, None), ("d2", 3, ""),
    ("d2", 4, "Omega sales were 7,000 units and nothing else to tell here."), (None, 1, "Acme revenue was 5 crore in FY23. "), ("d3", 1, "x" * 19_990 + " Acme revenue was 5 crore in FY23."),
]


@pytest.fixture
def pages(spark):
    udtf.register(spark)
    df = spark.createDataFrame(ROWS, "document_id string, pdf_page_number int, text string")
    df.createOrReplaceTempView("udtf_pages")
    return df


def facts(df):
    return sorted(map(str, df.collect()))


def test_the_same_facts_as_the_data_frame_way(spark, pages):
    names = [f.name for f in udtf.FIELDS]
    true = extract_facts(pages).select("document_id", "pdf_page_number", F.explode("facts").alias("f")).select("document_id", "pdf_page_number", *(F.col(f"f.{n}") for n in names))
    got = spark.sql(f"SELECT p.document_id, p.pdf_page_number, {', '.join('f.' + n for n in names)} FROM udtf_pages p, LATERAL extract_facts(p.text) f")
    assert facts(got) == facts(true)
    assert got.count() > 3


def test_facts_of_a_partition_are_numbered_in_order(spark, pages):
    got = spark.sql("SELECT * FROM extract_facts(TABLE(udtf_pages) PARTITION BY document_id ORDER BY pdf_page_number)")
    assert got.columns == ["document_id", "pdf_page_number", "position", *(f.name for f in udtf.FIELDS)]
    rows = sorted((r.document_id or "", r.position, r.pdf_page_number) for r in got.collect())
    assert [r for r in rows if r[0] == "d1"] == [("d1", 0, 1), ("d1", 1, 2), ("d1", 2, 2)]
    assert all(r[1] == 0 for r in rows if r[0] != "d1")


@pytest.mark.parametrize("call", ["extract_facts(5)", "extract_facts(TABLE(SELECT 1 AS x))", "extract_facts(TABLE(SELECT 'a' AS text, 'b' AS subject))"])
def test_wrong_arguments_are_told(spark, pages, call):
    with pytest.raises(Exception, match="extract_facts"):
        spark.sql(f"SELECT * FROM {call}").collect()
