import random

import pytest
from pyspark.sql import functions as F

from factspark.functions.tables import html_tables, read_html
from factspark.sources.files import html_parser, parse_pages, read_uploads


def tiled(rng, rows, columns):
    """A grid covered by random rectangles, and its HTML."""
    grid, cells, n = [[None] * columns for _ in range(rows)], [[] for _ in range(rows)], 0
    for y in range(rows):
        for x in range(columns):
            if grid[y][x] is not None:
                continue
            wide = 1
            while x + wide < columns and grid[y][x + wide] is None and rng.random() < 0.3:
                wide += 1
            deep = 1
            while y + deep < rows and rng.random() < 0.3:
                deep += 1
            for j in range(y, y + deep):
                for i in range(x, x + wide):
                    grid[j][i] = f"c{n}"
            cells[y].append(f'<td rowspan="{deep}" colspan={wide}> c{n}\n</td>' if rng.random() < 0.5 else f"<th colspan='{wide}' rowspan='{deep}'>c<i>{n}</i>")
            n += 1
    return grid, "<table><caption>no cell</caption>" + "".join("<tr>" + "".join(c) + rng.choice(["</tr>", ""]) for c in cells) + "</table>"


@pytest.mark.parametrize("seed", range(60))
def test_spans_fill_the_grid_they_were_cut_from(seed):
    rng = random.Random(seed)
    grid, html = tiled(rng, rng.randint(1, 7), rng.randint(1, 7))
    assert read_html("<p>a</p>" + html + "<p>b")[1] == [grid]
    assert read_html("<p>a</p>" + html + "<p>b")[0] == "a\nb"


@pytest.mark.parametrize(
    ("html", "grids"),
    [
        ("", []), ("no table", []), ("<table></table>", [[]]), ("<table><tr></table>", [[[]]]), ("<td>stray</td>", []),
        ("<table><tr><td>a<td>b<tr><td>c", [[["a", "b"], ["c", ""]]]),
        ("<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</table>", [[["xy", "z"]], [["in"]]]),
        ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</table>", [[["a", "b"], ["c", "d"]]]),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", [[["a", "b"], ["a", "c"], ["a", "d"]]]),
        ("<table><tr><td colspan=0>a<td rowspan=x colspan=-2>b<tr><td>&lt;c&gt;&amp;&#65;<td>e<br>f</table>", [[["a", "b"], ["<c>&A", "e f"]]]),
        ("<table><tr><td>a<script>var x='<td>';</script><style>b</style>c</table>", [[["ac"]]]),
        ("<table><td>no row<td>two</table>", [[["no row", "two"]]]),
    ],
)
def test_odd_markup(html, grids):
    assert read_html(html)[1] == grids


def test_huge_spans_are_bounded():
    rows = read_html("<table><tr><td colspan=99999999 rowspan=99999999>a<tr><td>b</table>")[1][0]
    assert [len(r) for r in rows] == [1001, 1001]


def test_null_pages_have_no_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td>a</table>")], "id long, html string")
    assert {r.id: r.t for r in df.select("id", html_tables("html").alias("t")).collect()} == {1: [], 2: [], 3: [[["a"]]]}


def test_html_files_give_pages_with_tables(spark, tmp_path):
    table = "<table><tr><th>Metric</th><th>FY23 (Rs. crore)</th></tr><tr><td>Revenue<td>1,234.5</tr><tr><td>Profit<td>56.7%</table>"
    (tmp_path / "a.html").write_text(f"<h1>Results</h1><p>Table 1: revenue and profit in the year 2023, 10 20 30 40 50 60</p>{table}")
    pages, issues = parse_pages(read_uploads(spark, str(tmp_path), ".html"), html_parser)
    row = pages.select("raw_text", F.col("tables")[0].alias("t")).first()
    assert row.raw_text.startswith("Results\nTable 1")
    assert row.t == "Metric | FY23 (Rs. crore)\nRevenue | 1,234.5\nProfit | 56.7%"
    assert issues.count() == 0
