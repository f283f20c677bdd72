"""Merge policies for tables in files: a new table from the old one and the incoming rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def first_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with unknown keys are added, the earliest of each; known keys stay as they are."""
    return old.unionByName(one_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> int:
    return new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").count()


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Incoming rows replace those with their keys; of several for one key the latest counts."""
    latest = one_per_key(new, keys, F.desc(order))
    return old.join(latest.select(*keys), keys, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def update_columns(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str], order: str) -> DataFrame:
    """Known keys get new values in some columns only, unknown keys come in whole."""
    latest = one_per_key(new, keys, F.desc(order)).withColumn("__new", F.lit(True))
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), latest.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    columns = []
    for c in old.columns:
        fresh = F.col("b.__new").isNotNull() & (F.col("a.__old").isNull() if c not in updated else F.lit(True))
        columns.append(F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(*columns)
