import random

from pyspark.sql import functions as F

from factspark.functions import pages, tables
from factspark.plans import queries
from test_tables import tiled

BITS = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th colspan=2>", "<td rowspan='2' COLSPAN=\"3\">", "<TD rowspan=0 rowspan=2>", "<td colspan>", "<td colspan=''>", "<tbody>", "</tbody >", "<thead class='x y'>", "<br>", "<br/>", "<br />", "<p\n>", "<h1>", "</H1>", "<b>", "</b>"]
BITS += ["a", " b\n", "&amp;", "&lt;td&gt;", "&#65", "&nbs", "x > y", " ", "é", "/>", '"', "</p>", "<li>"]
ODD = ["<", "<!-- <td> -->", "<script>'<td>'</script>", "<style>", "<td title='<td>'>", "<td/>", "<table/>", "</td x>", "<td colspan=2/>", "<a href=x/y>", "<td a=1b=2>", "<td colspan = 2>", "<!doctype html>", "<?x?>", "</>", "</ td>", "<td\x0browspan=2>", "<template>", "<title>", "<td rowspan='2'colspan=2>", "<td colspan=&#50;>", "<td x='a>b'>", "<td"]


def read(html):
    outside, found = tables.Reader().read(html)
    return "".join(outside), [[(s, [("".join(t), d, w) for t, d, w in cells]) for s, cells in rows] for rows in found]


def plain(html):
    if (got := tables.read_plain(html)) is not None:
        outside, found = got
        return "".join(outside), [[(s, [("".join(t), d, w) for t, d, w in cells]) for s, cells in rows] for rows in found]


def test_plain_pages_read_as_any_markup():
    rng = random.Random(1)
    for _ in range(4000):
        html = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))
        assert plain(html) == read(html), html


def test_other_markup_is_told_or_read_the_same():
    rng, left = random.Random(2), 0
    for _ in range(4000):
        html = "".join(rng.choice(BITS if rng.random() < 0.8 else ODD) for _ in range(rng.randint(1, 12)))
        got = plain(html)
        left += got is None
        assert got is None or got == read(html), html
    assert left > 1000
    for x in ODD:
        assert plain(f"<table><tr><td>{x}<td>b") in (None, read(f"<table><tr><td>{x}<td>b"))


def test_tables_of_spans_are_plain():
    for seed in range(20):
        rng = random.Random(seed)
        grid, html = tiled(rng, rng.randint(1, 7), rng.randint(1, 7))
        assert tables.read_plain(html) is not None and tables.read_html(html)[1] == [grid]


def test_pages_are_read_once(spark, tmp_path):
    """Spark filters out empty arrays below an explode; the pages must not be read for that a second time, nor in the few tasks that the lines' size asks for."""
    rows = [(k, k * 7 + i, i, "R" if k % 2 else "N", "F") for k in range(30) for i in range(k % 4 + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = queries.page_tables(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
    got = {(r.page_id, r.position): r.text for r in df.collect()}
    assert set(got) == {(k, 0) for k in range(30)}
    assert got[2, 0] == "Lines: 3 | Lines: 3 | Mode\nN | 14 | by F & co\nN | 15 | by F & co\nN | 16 | by F & co"
    again = queries.order_pages(spark, str(tmp_path)).select("page_id", F.filter(tables.html_tables("html"), pages.meaningful_table).alias("t"))
    assert {r.page_id: len(r.t) for r in again.collect()} == dict.fromkeys(range(30), 1)
