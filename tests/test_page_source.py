import os

import pytest
from pyspark.sql import functions as F

from factspark.sources import pages
from factspark.sources.files import text_parser


def put(folder, name, text, time):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(text if isinstance(text, bytes) else text.encode())
    os.utime(path, ns=(time, time))


@pytest.fixture
def folder(spark, tmp_path):
    def parser(content):
        if content == b"broken":
            raise ValueError("no pages here")
        return text_parser(content)

    pages.register(spark, parser=parser)
    for i in range(6):
        put(tmp_path, f"sub/{i}.txt" if i % 2 else f"{i}.txt", "\f".join(f"page {p} of {i}" for p in range(1, i + 2)), 1000 + i)
    put(tmp_path, "x.txt", "broken", 2000)
    put(tmp_path, "e.txt", "", 2001)
    for hidden in ("_tmp/9.txt", ".9.txt", "9.pdf"):
        put(tmp_path, hidden, "hidden", 1)
    return str(tmp_path)


TRUE = [(f"{i}.txt", p, f"page {p} of {i}") for i in range(6) for p in range(1, i + 2)] + [("x.txt", 0, "ValueError: no pages here"), ("e.txt", 1, "")]


def rows(df):
    return sorted((r.document_id, r.pdf_page_number, r.raw_text) for r in df.collect())


def test_pages_of_all_files_in_partitions_by_bytes(spark, folder):
    df = spark.read.format(pages.NAME).option("bytes", 40).load(folder)
    assert rows(df) == sorted(TRUE)
    assert 1 < df.rdd.getNumPartitions() <= 8
    assert spark.read.format(pages.NAME).load(folder).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("where", ["document_id = '3.txt'", "document_id in ('1.txt', '5.txt') and pdf_page_number >= 2", "pdf_page_number < 2 and raw_text like '%3'", "document_id > '4' and length(raw_text) > 3", "document_id is null", "document_id = 'none'"])
def test_filters(spark, folder, where):
    all_rows = spark.createDataFrame(TRUE, "document_id string, pdf_page_number int, raw_text string")
    assert rows(spark.read.format(pages.NAME).load(folder).where(where)) == rows(all_rows.where(where))


def test_a_filter_skips_files(spark, folder):
    reader = pages.PageReader({"path": folder}, text_parser)
    left = list(reader.pushFilters([pages.EqualTo(("document_id",), "3.txt"), pages.GreaterThan(("bytes",), 1), pages.In(("pdf_page_number",), (2, 3))]))
    assert left == [pages.GreaterThan(("bytes",), 1)]
    found = reader.partitions()
    assert [[os.path.basename(p) for p, _ in part.files] for part in found] == [["3.txt"]]
    assert [r[1] for part in found for r in reader.read(part)] == [2, 3]


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path_factory):
    out, state = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("state"))

    def run():
        source = spark.readStream.format(pages.NAME).load(folder)
        query = source.writeStream.format("parquet").option("checkpointLocation", state).trigger(processingTime="0 seconds").start(out)
        query.processAllAvailable()
        query.stop()
        return rows(spark.read.parquet(out))

    assert run() == sorted(TRUE)
    put(folder, "new.txt", "late\fpage", 3000)
    assert run() == sorted([*TRUE, ("new.txt", 1, "late"), ("new.txt", 2, "page")])


def test_wrong_options_are_told(spark, folder, tmp_path):
    with pytest.raises(Exception, match="at least 1"):
        spark.read.format(pages.NAME).option("bytes", 0).load(folder).collect()
    with pytest.raises(Exception, match="mounted"):
        spark.read.format(pages.NAME).load("s3://bucket/x").collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format(pages.NAME).load(str(empty)).agg(F.count("*")).first()[0] == 0
