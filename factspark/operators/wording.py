"""All pairs of alike wordings, found by rare shared keys instead of by comparing every two.

Two wordings of together S signs, M of them matched on either side, have the ratio 2M / S. So a ratio of at least t needs M >= tS/2, and with it

  - M common signs, counted with repeats;
  - 5M - 2S - 2 common runs of three signs: M matched signs in a row make M - 2 runs, and each of the S - 2M unmatched signs breaks at most two.

Runs serve pairs that are long enough for the second number to be positive (only possible for t > 0.8), signs the others. If two sets of n and m pieces share c, then the
n - c + 1 first of one and the m - c + 1 first of the other, in any common order, share a piece; rare pieces come first here. Each wording is therefore dealt by few
rare pieces, only wordings that meet are compared, and no pair that reaches the threshold is lost.

For t > 0.8, pairs that leave at most one sign unmatched on either side, such as numbered names, meet by what is left of a wording without one of its signs: their pieces
are mostly the same in all names, so none is rare. Two wordings of one length that differ from place p to place s leave the same either without a's p and b's s or the
other way round, and both only if they alternate two signs there; then the meeting with the earlier place in a counts, so no pair has to be made distinct. Other pairs with a wording of up to SHORT signs meet by pieces only if their lengths are those that the pieces were counted out for.

What is left to chance: many long wordings that share nearly all of their pieces, yet are not alike, are compared two by two.
"""

from __future__ import annotations

import difflib
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, written
from .relate import IDENTICAL, PLAUSIBLE, tidy

#: Frequencies of pieces are kept by hash, so that their table has this many rows at most; any order of pieces gives the same pairs.
BUCKETS = 1 << 16
RUN, SHORT, EPSILON = 3, 24, 1e-9
#: The side of a pair that a dealt piece stands for.
SHORTER, LONGER, SAME = 0, 1, 2
#: From this length on difflib leaves out frequent signs, so such wordings are left to it.
AUTOJUNK = 200


def pieces(text: str, q: int) -> list[str]:
    """Runs of q signs, the repeats of a run told apart by a number."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(text) - q + 1):
        gram = text[i : i + q]
        seen[gram] += 1
        out.append(f"{q}{gram}\0{seen[gram]}")
    return out


def bucket(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) % BUCKETS


def turn(threshold: float) -> float:
    """The joint length from which on runs are looked up instead of signs."""
    return math.ceil(3 / (2.5 * threshold - 2)) if threshold > 0.8 else math.inf


def partner_lengths(n: int, threshold: float) -> tuple[int, int]:
    """The lengths that a partner of a wording of n signs can have, as M is at most the lesser length."""
    return max(1, math.ceil(n * threshold / (2 - threshold) - EPSILON)), math.floor(n * (2 - threshold) / threshold + EPSILON)


def matched(total: int, threshold: float) -> int:
    """The least number of matched signs of a pair with so many signs together."""
    return math.ceil(threshold * total / 2 - EPSILON)


def by_variants(n: int, m: int, threshold: float) -> bool:
    return threshold > 0.8 and max(n, m) - matched(n + m, threshold) <= 1


def first_pieces(n: int, total: int, threshold: float, q: int) -> int:
    """How many of its rarest pieces a wording of n signs needs to meet all partners with which it has at least so many signs."""
    common = threshold * total / 2 if q == 1 else 2.5 * threshold * total - 2 * total - 2
    return n - q + 1 - max(1, math.ceil(common - EPSILON)) + 1


def looked_up(n: int, threshold: float, present: set[int] | None = None) -> list[tuple[str, int, int, int]]:
    """(tag, side, q, how many of the rarest pieces) by which a wording of n signs is dealt; pieces with the same tag meet, those of the shorter side those of the longer.
    Partners have one of the lengths that are present, if those are given."""
    low, high = partner_lengths(n, threshold)
    limit, out, least = turn(threshold), [], low
    if threshold > 0.8:
        for m in range(low, high + 1):
            if min(n, m) <= SHORT and not by_variants(n, m, threshold) and (present is None or m in present):
                q = RUN if n + m >= limit else 1
                out.append((f"{min(n, m)},{max(n, m)},", SAME if n == m else LONGER if n > m else SHORTER, q, first_pieces(n, n + m, threshold, q)))
        if n <= SHORT:
            return [x for x in out if x[3] > 0]
        least = max(low, SHORT + 1)
    if n + least < limit:
        out.append(("", SAME, 1, first_pieces(n, n + least, threshold, 1)))
    if n + high >= limit:
        out.append(("", SAME, RUN, first_pieces(n, max(n + least, limit), threshold, RUN)))
    return [x for x in out if x[3] > 0]


def variants(text: str, threshold: float) -> set[str]:
    """The wording and what is left of it without one of its signs, where some pair of its length meets that way."""
    n = len(text)
    if not by_variants(n, n, threshold):
        return set()
    return {"v" + text, *("v" + text[:i] + text[i + 1 :] for i in range(n))}


def dealt_variants(wordings: DataFrame, threshold: float, present: set[int]) -> DataFrame | None:
    """piece, at, text: the variants by which some wordings of the present lengths can reach the threshold, each once; at is the place of the sign left out, from 1, or
    0 for the wording itself. None if there are no such lengths."""

    def reached(n: int, m: int) -> bool:
        return by_variants(n, m, threshold) and matched(n + m, threshold) <= min(m, n - 1)

    shortened = sorted(n for n in present if reached(n, n) or (n - 1 in present and reached(n, n - 1)))
    whole = sorted(n for n in present if n + 1 in present and reached(n + 1, n))
    if not shortened:
        return None
    text, n = F.col("text"), F.length("text")
    place = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.substring(text, i, F.lit(1)) != F.substring(text, i - 1, F.lit(1))))
    left = F.transform(place, lambda i: F.struct(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)).alias("piece"), i.alias("at")))
    out = wordings.where(n.isin(shortened)).select(F.explode(left).alias("v"), "text").select("v.piece", "v.at", "text")
    return out.union(wordings.where(n.isin(whole)).select(text.alias("piece"), F.lit(0).alias("at"), "text")) if whole else out


def piece_counts(wordings: DataFrame) -> np.ndarray:
    """How often the pieces of each bucket occur; BUCKETS numbers, whatever the table's size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for text in frame["text"]:
                np.add.at(total, [bucket(p) for q in (1, RUN) for p in pieces(text, q)], 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = wordings.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out


def signs(texts: pa.Array, n: int) -> np.ndarray:
    """The signs of texts of n signs each: a row for each place, a column for each text."""
    data = texts.cast(pa.large_string())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    if at[-1] - at[0] == n * len(texts):  # a byte each
        codes = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]]
    else:
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return np.ascontiguousarray(codes.reshape(len(texts), n).T)


def longest_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start in x, start in y) of the longest common block of each pair of columns; of equally long ones the first in x and then in y."""
    wide, pairs = y.shape
    size, at_x, at_y = (np.zeros(pairs, np.int64) for _ in range(3))
    late = np.arange(wide - 1, -1, -1, dtype=np.uint16)[:, None]
    run = np.zeros((wide + 1, pairs), np.uint16)  # of the block that ends at a sign of y, one row on
    for i in range(len(x)):
        now = np.zeros_like(run)
        np.multiply(run[:-1] + np.uint16(1), x[i] == y, out=now[1:])
        run = now
        first = (run[1:] * np.uint16(wide) + late).max(axis=0)  # the longest, and of those the first in y
        more = np.flatnonzero(first // wide > size)
        if len(more):
            k, left = np.divmod(first[more].astype(np.int64), wide)
            size[more], at_x[more], at_y[more] = k, i + 1 - k, wide - left - k
    return size, at_x, at_y


def certain_heads(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs each pair of columns begins alike with, where a look shows that to be the longest common block, else 0. It is, if some sign of it is nowhere else
    in either wording, so that any other block ends before that sign or begins after it, and no more signs follow that sign than the head has."""
    shared, rest = min(len(a), len(b)), max(len(a), len(b)) - 1
    differ = a[:shared] != b[:shared]
    head = np.where(differ.any(axis=0), differ.argmax(axis=0), shared)
    sign = a[:shared, :1]
    for q in np.flatnonzero((a[:shared] == sign).all(axis=1) & (b[:shared] == sign).all(axis=1))[::-1]:
        sure = (head > q) & (head >= rest - q) & ((a == sign[q]).sum(axis=0) == 1) & ((b == sign[q]).sum(axis=0) == 1)
        if sure.any():
            return np.where(sure, head, 0)
    return np.zeros_like(head)


def matched_signs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs difflib.SequenceMatcher matches in each pair of columns: those of the longest common block, and so on left and right of it; for fewer than
    AUTOJUNK signs, of one type whose two greatest numbers are no signs."""
    most, head, every = np.iinfo(a.dtype).max, certain_heads(a, b), np.arange(a.shape[1])
    out = head.copy()
    parts = [every, head, head, np.full_like(every, len(a)), np.full_like(every, len(b))]
    while True:
        pair, a0, b0, a1, b1 = (v[(parts[1] < parts[3]) & (parts[2] < parts[4])] for v in parts)
        if not len(pair):
            return out
        place = a0 + np.arange((a1 - a0).max())[:, None]
        x = np.where(place < a1, a[np.minimum(place, len(a) - 1), pair], a.dtype.type(most))
        place = b0 + np.arange((b1 - b0).max())[:, None]
        y = np.where(place < b1, b[np.minimum(place, len(b) - 1), pair], a.dtype.type(most - 1))
        size, i, j = longest_blocks(x, y)
        out += np.bincount(pair, size, len(out)).astype(np.int64)  # a pair is here once for each of its parts
        i, j = a0 + i, b0 + j
        parts = [np.concatenate(v)[np.tile(size > 0, 2)] for v in ((pair, pair), (a0, i + size), (b0, j + size), (i, a1), (j, b1))]


def met_twice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the columns, different and of one length, have two variants in common: they alternate two signs from the first place at which they differ to the last."""
    differ, place = x != y, np.arange(len(x) - 1)[:, None]
    first, last = differ.argmax(axis=0), len(x) - 1 - differ[::-1].argmax(axis=0)
    return (first < last) & ((place < first) | (place >= last) | ((x[1:] == y[:-1]) & (y[1:] == x[:-1]))).all(axis=0)


def judged(a: pa.Array, b: pa.Array, threshold: float, later: np.ndarray | None = None) -> pa.RecordBatch:
    """a, b, ab, ba of the pairs that reach the threshold. Those marked as later are left out if they have two variants in common."""
    n, m = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    there, back, kept = np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
    for lengths in np.unique(n << 32 | m):
        rows = np.flatnonzero((n << 32 | m) == lengths)
        p, q = int(lengths) >> 32, int(lengths) & 0xFFFFFFFF
        x, y = signs(a.take(pa.array(rows)), p), signs(b.take(pa.array(rows)), q)
        if x.dtype != y.dtype:
            x, y = x.astype(np.uint32), y.astype(np.uint32)
        if later is not None and p == q:
            kept[rows[met_twice(x, y) & later[rows]]] = False
        if max(p, q) < AUTOJUNK and p * q < 8 * len(rows):
            there[rows], back[rows] = 2.0 * matched_signs(x, y) / (p + q), 2.0 * matched_signs(y, x) / (p + q)
        else:
            for i in rows[kept[rows]]:
                one, two = a[i].as_py(), b[i].as_py()
                matcher = difflib.SequenceMatcher(None, one, two)
                if matcher.quick_ratio() >= threshold:
                    there[i], back[i] = matcher.ratio(), difflib.SequenceMatcher(None, two, one).ratio()
    found = pa.array(np.flatnonzero(kept & (np.maximum(there, back) >= threshold)))
    return pa.RecordBatch.from_arrays([a.take(found), b.take(found), pa.array(there).take(found), pa.array(back).take(found)], ["a", "b", "ab", "ba"])


PAIRS = "a string, b string, ab double, ba double"


def pairs_by_variants(dealt: DataFrame, threshold: float, tasks: int) -> DataFrame:
    dealt = dealt.repartition(tasks, "piece")
    x, y = (dealt.select("piece", F.col("at").alias(f"at_{s}"), F.col("text").alias(s)) for s in "ab")
    met = x.join(y, "piece").where("a < b").select("a", "b", (F.col("at_a") > F.col("at_b")).alias("later"))
    return met.mapInArrow(lambda batches: (judged(x["a"], x["b"], threshold, x["later"].to_numpy(zero_copy_only=False)) for x in batches), PAIRS)


def pairs_by_pieces(wordings: DataFrame, threshold: float, present: set[int], folder: str, tasks: int) -> DataFrame:
    spark = wordings.sparkSession
    counts = piece_counts(wordings)
    place = np.empty(BUCKETS, np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
    order = spark.sparkContext.broadcast(place)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for n, text in zip(frame["n"], frame["text"], strict=True):
                wanted = looked_up(len(text), threshold, present)
                ranked = {q: sorted((order.value[bucket(p)], p) for p in pieces(text, q)) for q in {q for _, _, q, _ in wanted}}
                out += [(f"p{tag}{p}", side, n, len(text)) for tag, side, q, k in wanted for _, p in ranked[q][:k]]
            yield pd.DataFrame(out, columns=["piece", "side", "n", "len"])

    dealt = written(wordings.mapInPandas(deal, "piece string, side int, n long, len int"), f"{folder}/pieces")
    left, right = (dealt.select("piece", "side", F.col("n").alias(s), F.col("len").alias(f"len_{s}")) for s in "xy")
    right = right.withColumn("side", F.when(F.col("side") == SAME, SAME).otherwise(LONGER - F.col("side")))
    shorter, total = F.least("len_x", "len_y"), F.col("len_x") + F.col("len_y")
    met = left.join(right, ["piece", "side"]).where((F.col("x") < F.col("y")) & (2 * shorter >= threshold * total - EPSILON))
    if threshold > 0.8:  # the others meet by variants
        met = met.where(F.greatest("len_x", "len_y") - F.ceil(threshold * total / 2 - EPSILON) > 1)
    met = met.select("x", "y").distinct()
    for side in "xy":
        met = met.join(wordings.select(F.col("n").alias(side), F.col("text").alias(f"text_{side}")), side)
    # the rows are few bytes, but each costs a comparison, so they are not left to the partitions that their size asks for
    pairs = met.select(F.least("text_x", "text_y").alias("a"), F.greatest("text_x", "text_y").alias("b")).repartition(tasks, "a", "b")
    return pairs.mapInArrow(lambda batches: (judged(x["a"], x["b"], threshold) for x in batches), PAIRS)


def similar_wordings(texts: DataFrame, threshold: float, column: str = "text") -> DataFrame:
    """a, b, ab, ba: all pairs a < b of different tidied wordings whose similarity is at least the threshold from a to b (ab) or from b to a (ba).

    Nulls count as empty, empty wordings pair with nothing, equal ones are one wording; other columns are not looked at. Other than 0 < threshold <= 1 is refused."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    spark = texts.sparkSession
    folder = shared_folder(spark, "wordings")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = texts.select(tidy(F.col(column)).alias("text")).where("text <> ''").distinct()
    wordings = written(distinct.select(F.monotonically_increasing_id().alias("n"), "text"), f"{folder}/texts")
    present = {r.n for r in wordings.select(F.length("text").alias("n")).distinct().collect()}
    found = []
    if (dealt := dealt_variants(wordings, threshold, present)) is not None:
        found.append(pairs_by_variants(dealt, threshold, tasks))
    if any(looked_up(n, threshold, present) for n in present):
        found.append(pairs_by_pieces(wordings, threshold, present, folder, tasks))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], PAIRS)


def both_ways(pairs: DataFrame, texts: DataFrame, column: str, name: str) -> DataFrame:
    """a_<column>, b_<column>, <name>: the pairs in both directions and every wording with itself."""
    a, b = f"a_{column}", f"b_{column}"
    there, back = pairs.select(F.col("a").alias(a), F.col("b").alias(b), F.col("ab").alias(name)), pairs.select(F.col("b").alias(a), F.col("a").alias(b), F.col("ba").alias(name))
    same = texts.select(tidy(F.col(column)).alias(a)).distinct().select(a, F.col(a).alias(b), F.lit(1.0).alias(name))
    return there.unionByName(back).unionByName(same)


def similar_facts(facts: DataFrame, threshold: float = PLAUSIBLE, equal: Sequence[str] = ()) -> DataFrame:
    """a_id, b_id, subject_sim, predicate_sim: all pairs of different ids, in both directions, whose subjects and whose predicates are alike from one to the other or back.

    Facts (id, subject, predicate) with the same wordings are one group until the end. The columns named in equal must agree too; null agrees with nothing."""
    key = [tidy(F.col("subject")).alias("subject"), tidy(F.col("predicate")).alias("predicate"), *equal]
    groups = facts.select(*key).distinct()
    near = {c: both_ways(similar_wordings(facts, threshold, c), facts, c, f"{c}_sim") for c in ("subject", "predicate")}
    a, b = (groups.select(*(F.col(c).alias(f"{s}_{c}" if c in near else c) for c in groups.columns)) for s in "ab")
    pairs = a.join(near["subject"], "a_subject").join(b, ["b_subject", *equal]).join(near["predicate"], ["a_predicate", "b_predicate"])
    for s in "ab":
        members = facts.select(F.col("id").alias(f"{s}_id"), *(k.alias(f"{s}_{c}") for k, c in zip(key[:2], near, strict=True)), *equal)
        pairs = pairs.join(members, [f"{s}_subject", f"{s}_predicate", *equal])
    return pairs.where("a_id <> b_id").select("a_id", "b_id", "subject_sim", "predicate_sim")


def period_keys(start: Column, end: Column, label: Column) -> Column:
    """What two facts share if their periods can agree: both bounds, or the label where one of them lacks bounds."""
    bounds = F.when((start != "") & (end != ""), F.concat_ws("\0", F.lit("b"), start, end))
    return F.filter(F.array(bounds, F.when(label != "", F.concat_ws("\0", F.lit("l"), tidy(label)))), lambda x: x.isNotNull())


def decidable(facts: DataFrame) -> DataFrame:
    """a_id, b_id: all pairs that the rules can decide, of alike wording (IDENTICAL) with one unit and one period, whatever neighbours the facts have; for `relate`."""
    keyed = facts.where("normalized_value is not null and normalized_unit <> ''").select("id", "subject", "predicate", "normalized_unit", F.explode(period_keys(F.col("period_start"), F.col("period_end"), F.col("period_label"))).alias("period_key"))
    return similar_facts(keyed, IDENTICAL, ("normalized_unit", "period_key")).select("a_id", "b_id").distinct()
