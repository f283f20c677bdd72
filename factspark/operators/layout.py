"""Rows and clusters of words on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How far words of one row, and rows of one cluster, may lie apart.
ROW_TOLERANCE, CLUSTER_GAP = 3.0, 14.0


def grouped_rows(words: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """Rows of an array of words (x0, y0, x1, y1, text): sorted by y then x, a word joins the row while its y is within the
    tolerance of the row's first word; each row is sorted by x. A fold over one page's words, without Python."""
    by_place = F.array_sort(F.transform(words, lambda w: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["text"].alias("text"))))
    kind = "struct<y0:double,x0:double,x1:double,y1:double,text:string>"
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.expr(f"cast(array() as array<{kind}>)").alias("row"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("rows"))

    def step(s: Column, w: Column) -> Column:
        joins = s["anchor"].isNotNull() & (F.abs(w["y0"] - s["anchor"]) <= tolerance)
        closed = F.when(joins | (F.size(s["row"]) == 0), s["rows"]).otherwise(F.concat(s["rows"], F.array(s["row"])))
        return F.struct(F.when(joins, s["anchor"]).otherwise(w["y0"]).alias("anchor"), F.when(joins, F.concat(s["row"], F.array(w))).otherwise(F.array(w)).alias("row"), closed.alias("rows"))

    folded = F.aggregate(by_place, start, step, lambda s: F.when(F.size(s["row"]) == 0, s["rows"]).otherwise(F.concat(s["rows"], F.array(s["row"]))))
    return F.transform(folded, lambda row: F.array_sort(F.transform(row, lambda w: F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["text"].alias("text")))))


def row_table(pages: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """page_id, row, top, bottom, text for pages (page_id, words)."""
    rows = pages.select("page_id", F.posexplode(grouped_rows(F.col("words"), tolerance)).alias("row", "ws"))
    return rows.select("page_id", "row", F.array_min(F.transform("ws", lambda w: w["y0"])).alias("top"), F.array_max(F.transform("ws", lambda w: w["y1"])).alias("bottom"), F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"))


def clusters(rows: DataFrame, gap: float = CLUSTER_GAP) -> DataFrame:
    """Adds cluster: a new one begins where a row's top lies over gap below the bottom of the row before."""
    order = W.partitionBy("page_id").orderBy("row")
    new = F.coalesce(F.col("top") - F.lag("bottom").over(order) > gap, F.lit(False)).cast("int")
    return rows.withColumn("new", new).withColumn("cluster", F.sum("new").over(order)).drop("new")


def clustered_text(rows: DataFrame) -> DataFrame:
    """page_id, text: rows on lines, a blank line between clusters."""
    parts = rows.groupBy("page_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("r")).select("page_id", "cluster", F.array_join(F.transform("r", lambda v: v["text"]), "\n").alias("t"))
    return parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "t"))).alias("c")).select("page_id", F.array_join(F.transform("c", lambda v: v["t"]), "\n\n").alias("text"))
