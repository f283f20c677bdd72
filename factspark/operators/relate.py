"""Typed relationships between facts: candidates, wording, rules."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import relationship_id
from ..functions.normalize import first_of
from ..functions.text import asymmetric_marker

# Thresholds of similarity and of relative difference, with each verdict's confidence.
PLAUSIBLE, IDENTICAL, ROUNDING, CLOSE, CANDIDATES, EVIDENCE_CHARS = 0.35, 0.92, 0.01, 0.15, 5, 500
CONFIDENCE = {"CORROBORATES": 0.95, "LIKELY_CONTRADICTION": 0.60, "CONTRADICTS": 0.75, "scope": 0.70, "estimate_vintage": 0.65}
FIELDS = ("id", "subject", "predicate", "normalized_value", "normalized_unit", "period_start", "period_end", "period_label", "scope", "status")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict[tuple[str, str], float] = {}

    def ratio(x: str | None, y: str | None) -> float:
        if x is None or y is None:
            return 1.0
        if (x, y) not in memo:
            memo[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
        return memo[x, y]

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def tidy(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"^\s+|\s+$", "")


def similarity(a: Column, b: Column) -> Column:
    """The share of matching signs of two wordings; not symmetric, so always from the source fact to the candidate."""
    a, b = tidy(a), tidy(b)
    # equal wordings need no look in Python
    return F.when(a == b, 1.0).otherwise(_ratio(F.when(a != b, a), F.when(a != b, b)))


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """A bound by lengths alone: no similarity can exceed 2 * min / (sum)."""
    la, lb = F.length(tidy(a)), F.length(tidy(b))
    return F.when(la + lb == 0, F.lit(True)).otherwise(2 * F.least(la, lb) >= threshold * (la + lb))


def plausible(pairs: DataFrame) -> DataFrame:
    """Pairs (columns a_..., b_...) of different facts with related wording; adds subject_sim and predicate_sim."""
    near = pairs.where((F.col("a_id") != F.col("b_id")) & may_reach(F.col("a_subject"), F.col("b_subject"), PLAUSIBLE) & may_reach(F.col("a_predicate"), F.col("b_predicate"), PLAUSIBLE))
    sims = near.withColumns({"subject_sim": similarity(F.col("a_subject"), F.col("b_subject")), "predicate_sim": similarity(F.col("a_predicate"), F.col("b_predicate"))})
    return sims.where((F.col("subject_sim") >= PLAUSIBLE) & (F.col("predicate_sim") >= PLAUSIBLE))


def pair_up(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates (a_id, b_id) with both facts' fields."""
    out = candidates
    for side in ("a", "b"):
        out = out.join(facts.select(*(F.col(c).alias(f"{side}_{c}") for c in FIELDS)), f"{side}_id")
    return out


def same_period(a: str = "a_", b: str = "b_") -> Column:
    def some(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    bounds = some(f"{a}period_start") & some(f"{a}period_end") & some(f"{b}period_start") & some(f"{b}period_end")
    equal = (F.col(f"{a}period_start") == F.col(f"{b}period_start")) & (F.col(f"{a}period_end") == F.col(f"{b}period_end"))
    labels = some(f"{a}period_label") & some(f"{b}period_label") & (tidy(F.col(f"{a}period_label")) == tidy(F.col(f"{b}period_label")))
    return F.coalesce(F.when(bounds, equal).otherwise(labels), F.lit(False))


def classify(pairs: DataFrame) -> DataFrame:
    """Adds relationship_type, confidence, context_dimension and reason to pairs with similarities; null type: undecided."""
    alike = ~asymmetric_marker(F.col("a_predicate"), F.col("b_predicate")) & (F.col("subject_sim") >= IDENTICAL) & (F.col("predicate_sim") >= IDENTICAL)
    va, vb, unit = F.col("a_normalized_value"), F.col("b_normalized_value"), F.col("a_normalized_unit")
    comparable = va.isNotNull() & vb.isNotNull() & F.coalesce((unit != "") & (unit == F.col("b_normalized_unit")), F.lit(False))
    decided = alike & same_period() & comparable
    scope, status = tidy(F.col("a_scope")) == tidy(F.col("b_scope")), tidy(F.col("a_status")) == tidy(F.col("b_status"))
    gap = F.abs(va - vb) / F.greatest(F.abs(va), F.abs(vb), F.lit(1e-9))
    same = decided & scope & status
    rules = [
        (same & (gap <= ROUNDING), "CORROBORATES", "CORROBORATES", "none", "values agree within rounding"),
        (same & (gap <= CLOSE), "LIKELY_CONTRADICTION", "LIKELY_CONTRADICTION", "none", "values differ a little with no qualifier that explains it"),
        (same, "CONTRADICTS", "CONTRADICTS", "none", "values are materially different"),
        (decided & ~scope, "CONTEXT_RECONCILES", "scope", "scope", "the reporting scope differs"),
        (decided & ~status, "CONTEXT_RECONCILES", "estimate_vintage", "estimate_vintage", "the disclosed status differs"),
    ]
    shown = F.concat(F.lit(" ("), va.cast("string"), F.lit(" vs "), vb.cast("string"), F.lit(" "), unit, F.lit(")"))
    return pairs.withColumns({
        "relationship_type": first_of([(when, F.lit(kind)) for when, kind, *_ in rules]),
        "confidence": first_of([(when, F.lit(CONFIDENCE[c])) for when, _, c, *_ in rules]),
        "context_dimension": first_of([(when, F.lit(d)) for when, _, _, d, _ in rules]),
        "reason": first_of([(when, F.concat(F.lit(f"Same metric and period; {text}"), shown)) for when, *_, text in rules]),
    })


def relate(candidates: DataFrame, facts: DataFrame, known: DataFrame | None = None, classifier=None, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new relationships, undecided pairs for review). Each pair is taken once: from the lesser id if that orientation is plausible, else from
    the other. A classifier may decide what the rules leave open; pairs that it gives no type, or does not give back, stay open. With evidence (fact_id,
    text) open pairs carry the first EVIDENCE_CHARS signs of each side's, as a_evidence and b_evidence."""
    judged = classify(plausible(pair_up(candidates.select("a_id", "b_id").distinct(), facts)))
    pair = F.struct(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"))
    first = judged.withColumn("pair", pair).groupBy("pair").agg(F.min_by(F.struct(*judged.columns), "a_id").alias("j")).select("j.*")
    open_ = first.where("relationship_type is null")
    done = first.where("relationship_type is not null").withColumn("method", F.lit("rule"))
    if evidence is not None:
        cut = evidence.groupBy("fact_id").agg(F.substring(F.min("text"), 1, EVIDENCE_CHARS).alias("text"))
        for side in ("a", "b"):
            open_ = open_.join(cut.select(F.col("fact_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_evidence")), f"{side}_id", "left")
    if classifier is not None:
        decided = classifier(open_).where("relationship_type is not null").withColumn("method", F.lit("model"))
        done = done.unionByName(decided.select(*done.columns))
        open_ = open_.join(decided.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    compat = F.when(F.col("confidence") >= 0.9, "rule").otherwise("llm")
    edges = done.where("relationship_type <> 'UNRELATED'").select(relationship_id(F.col("a_id"), F.col("b_id")).alias("id"), F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "relationship_type", "confidence", "context_dimension", "reason", "method", compat.alias("method_ref_compat"))
    if known is not None:
        edges = edges.join(known.select(relationship_id(F.col("fact_a_id"), F.col("fact_b_id")).alias("id")), "id", "left_anti")
    return edges, open_
