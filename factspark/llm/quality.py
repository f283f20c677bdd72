"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer.

Labellers look at a document's shares of odd signs, lone punctuation, repeated words and runs of one word, at capitals, at word length and at a lexicon of words
that labelled toxic documents have; given labels are one more labeller. They overlap and err. Expectation-maximisation over the
counts of vote patterns of all documents estimates how each votes on good, junk and toxic documents; the posterior classes
then train a linear scorer on hashed word presence, which judges every whole text without its label.

The lexicon and the scorer are fitted on at most SAMPLE labelled rows (the first by a hash of their id); vote counts and scores cover all
rows; of rows with one id only the least text teaches. A null text, or one without a word, is junk: score 0, rejected. Labels with null fields, or for unknown ids, say nothing; of several
labels for one id the worst counts. Without labels only the heuristics vote. Repeated rows are judged alike; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the lexicon and the scorer are fitted on, at most.
SAMPLE = 6000
BITS = 17
GOOD, JUNK, TOXIC = range(3)
#: Bytes other than letters, digits, white space and the usual marks of prose.
ODD = np.array([chr(i) in "#$%&*+/<=>@\\^_`{|}~" for i in range(256)])
#: Edges of the bins that a share falls in, for each heuristic.
EDGES = {"odd": (0.02, 0.1), "lone": (0.02, 0.1), "repeat": (0.2, 0.35), "runs": (0.05, 0.2), "shout": (0.2, 0.5), "short": (2.0, 3.0), "long": (12.0, 18.0), "lexicon": (0.5, 1.5), "label": (0.5, 1.5)}
NAMES = tuple(EDGES)
#: P(vote | class) that EM starts from: rows good, junk, toxic; columns the three bins (for label: none, clean, bad kinds below).
START = {
    "odd": ((0.90, 0.08, 0.02), (0.40, 0.20, 0.40), (0.90, 0.08, 0.02)),
    "lone": ((0.90, 0.08, 0.02), (0.50, 0.20, 0.30), (0.90, 0.08, 0.02)),
    "repeat": ((0.80, 0.18, 0.02), (0.60, 0.20, 0.20), (0.80, 0.18, 0.02)),
    "runs": ((0.90, 0.08, 0.02), (0.60, 0.10, 0.30), (0.90, 0.08, 0.02)),
    "shout": ((0.90, 0.08, 0.02), (0.60, 0.10, 0.30), (0.90, 0.08, 0.02)),
    "short": ((0.02, 0.08, 0.90), (0.20, 0.20, 0.60), (0.02, 0.08, 0.90)),
    "long": ((0.95, 0.04, 0.01), (0.60, 0.20, 0.20), (0.95, 0.04, 0.01)),
    "lexicon": ((0.97, 0.02, 0.01), (0.97, 0.02, 0.01), (0.10, 0.30, 0.60)),
    "label": ((0.60, 0.38, 0.01, 0.01), (0.60, 0.01, 0.38, 0.01), (0.60, 0.01, 0.01, 0.38)),
}


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, C.Words]:
    """Distinct folded bare words of each text: (hashes, first), and all its words."""
    w = C.words(texts, C.PUNCTUATION, fold=True)
    row = w.row
    h = w.hash
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(w.first))), w


def heuristics(texts: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(votes of each text, bag hashes, first, whether it has a word); a vote is the bin of the heuristic's value."""
    h, first, bare = bags(texts)
    buf, off = C.raw(texts)
    spaced = C.words(texts)
    n_words, n_bare = np.diff(spaced.first), np.diff(bare.first)
    some = np.maximum(n_words, 1)
    odd_before = np.concatenate([[0], np.cumsum(ODD[buf])])
    with_odd = (odd_before[spaced.end] > odd_before[spaced.start]).astype(np.int64)
    letter_before = np.concatenate([[0], np.cumsum(~C.PUNCTUATION[buf])])
    lone = (letter_before[spaced.end] == letter_before[spaced.start]).astype(np.int64)

    def per_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[first[1:]] - total[first[:-1]]

    same = np.zeros(len(bare.hash), np.int64)
    same[1:] = bare.hash[1:] == bare.hash[:-1]
    same[bare.first[:-1][n_bare > 0]] = 0  # a text's first word follows none
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    length = per_text(bare.end - bare.start, bare.first) / np.maximum(n_bare, 1)
    values = {
        "odd": per_text(with_odd, spaced.first) / some,
        "lone": per_text(lone, spaced.first) / some,
        # long texts repeat more by nature: distinct words against a power law of their number
        "repeat": 1 - np.diff(first) / np.maximum(n_bare, 1) ** 0.85,
        "runs": per_text(same, bare.first) / np.maximum(n_bare, 1),
        "shout": per_text(upper, off) / np.maximum(per_text(upper, off) + per_text(lower, off), 1),
        "short": length,
        "long": length,
        "lexicon": per_text(np.isin(h, lexicon).astype(np.int64), first),
    }
    votes = np.stack([np.searchsorted(EDGES[k], values[k], "right") for k in NAMES[:-1]], axis=1).astype(np.int8)
    return votes, h, first, n_bare > 0


def find_lexicon(h: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Words in at least four labelled toxic texts that are hardly in others."""
    words, at = np.unique(h, return_inverse=True)
    bad = np.bincount(at, weights=toxic[row], minlength=len(words))
    all_ = np.bincount(at, minlength=len(words))
    share = (bad + 0.1) / (all_ + 1.0)
    return words[(bad >= 4) & (share > 0.7)]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(P(class | pattern) for each row of votes, P(vote | class) of each labeller, P(class)), by Dawid and Skene's model."""
    tables = [np.array(START[k]) for k in NAMES]
    prior = np.array([0.8, 0.12, 0.08])
    for _ in range(rounds):
        log = np.log(prior)[None, :].repeat(len(patterns), axis=0)
        for j, t in enumerate(tables):
            log += np.log(t[:, patterns[:, j]].T)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + 3)
        for j, name in enumerate(NAMES):
            start = np.array(START[name])
            seen = np.stack([np.bincount(patterns[:, j], weights=weight[:, c], minlength=start.shape[1]) for c in range(3)])
            tables[j] = (seen + 50 * start) / (seen.sum(axis=1, keepdims=True) + 50)
    return post, tables, prior


def slots(h: np.ndarray, first: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and rows: hashed words, and each heuristic's bin but the lexicon's."""
    n = len(first) - 1
    word = (C.mix(h, 5) >> np.uint64(64 - BITS)).astype(np.int64)
    bins = (1 << BITS) + np.arange(len(NAMES) - 2) * 3 + votes[:, : len(NAMES) - 2]
    return np.concatenate([word, bins.reshape(-1)]), np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), len(NAMES) - 2)])


SIZE = (1 << BITS) + 3 * len(NAMES)


def train_scorer(feature: np.ndarray, row: np.ndarray, target: np.ndarray, rounds: int = 120, rate: float = 0.3, sparse: float = 2e-4) -> np.ndarray:
    """Weights (features + 1) x 3 of a softmax on feature presence: adaptive gradients with an L1 step."""
    n = len(target)
    used, feature = np.unique(feature, return_inverse=True)
    w, total, bias, bias_total = np.zeros((len(used), 3)), np.full((len(used), 3), 1e-6), np.log(target.mean(axis=0) + 1e-3), np.full(3, 1e-6)
    for _ in range(rounds):
        z = np.stack([np.bincount(row, weights=w[feature, c], minlength=n) for c in range(3)], axis=1) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) / n
        grad = np.stack([np.bincount(feature, weights=error[row, c], minlength=len(used)) for c in range(3)], axis=1)
        total += grad**2
        step = rate / np.sqrt(total)
        w -= step * grad
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * sparse)
        g = error.sum(axis=0)
        bias_total += g**2
        bias = bias - rate * g / np.sqrt(bias_total)
    out = np.zeros((SIZE + 1, 3), np.float32)
    out[used], out[-1] = w, bias
    return out


def one_task(df: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel on all rows of a bounded table, in one task."""
    return df.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(kernel, schema)


def train(docs: DataFrame, labels: DataFrame | None, folder: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict | None:
    """The model: lexicon and weights; None for an empty table."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    label = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1)
    known = labels.select(F.col("doc_id").alias("id"), label.alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    known = C.staged(known.join(docs.select("id"), "id", "left_semi"), folder, "known")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    if chosen.isEmpty():  # without labels the heuristics are enough to train on
        chosen = docs.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample).withColumn("label", F.lit(0))
    # of rows with one id, the least text teaches
    rows = C.staged(docs.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")), folder, "labelled")

    def lexicon_kernel(t: pa.Table) -> pa.Table:
        label, found = t["label"].to_numpy(), []
        h, row, at = [], [], 0
        for b in C.slices(iter(t.to_batches()), "text"):
            got, first, _ = bags(b.column("text"))
            h.append(got)
            row.append(at + np.repeat(np.arange(b.num_rows), np.diff(first)))
            at += b.num_rows
        found = find_lexicon(np.concatenate(h), np.concatenate(row), label == 3) if h else np.zeros(0, np.uint64)
        return pa.table([pa.array([found.tobytes()], pa.binary())], ["x"])

    got = one_task(rows, lexicon_kernel, "x binary").collect()
    if not got:
        if not docs.isEmpty():  # every id is null: the heuristics' own weights are all there is
            rows = C.staged(docs.orderBy(F.xxhash64("text"), "text").limit(sample).withColumn("label", F.lit(0)), folder, "unnamed")
            got = one_task(rows, lexicon_kernel, "x binary").collect()
        else:
            return None
    lexicon = np.frombuffer(bytes(got[0].x), np.uint64)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            votes = heuristics(b.column("text"), lexicon)[0]
            yield pa.record_batch([b.column("id"), pa.array(votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1]))], ["id", "votes"])

    kind = dict(docs.dtypes)["id"]
    voted = docs.mapInArrow(C.tidied(vote), f"id {kind}, votes long").join(known, "id", "left").groupBy("votes", F.coalesce("label", F.lit(0)).alias("label")).count().collect()
    codes = np.array([r.votes for r in voted])
    patterns = np.hstack([codes[:, None] // 3 ** np.arange(len(NAMES) - 1) % 3, np.array([[r.label] for r in voted])])
    counts = np.array([r["count"] for r in voted], float)
    post, _, _ = expectation_maximisation(patterns, counts)
    posterior = {(c, r.label): p for c, r, p in zip(codes.tolist(), voted, post, strict=True)}

    def scorer_kernel(t: pa.Table) -> pa.Table:
        feature, row, target, at = [], [], [], 0
        for b in C.slices(iter(t.to_batches()), "text"):
            votes, h, first, _ = heuristics(b.column("text"), lexicon)
            f, r = slots(h, first, votes)
            feature.append(f)
            row.append(at + r)
            keys = zip((votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1])).tolist(), b.column("label").to_pylist(), strict=True)
            target += [posterior[k] for k in keys]
            at += b.num_rows
        w = train_scorer(np.concatenate(feature), np.concatenate(row), np.array(target))
        return pa.table([pa.array([w.tobytes()], pa.binary())], ["x"])

    weights = np.frombuffer(bytes(one_task(rows, scorer_kernel, "x binary").collect()[0].x), np.float32).reshape(-1, 3)
    return {"lexicon": lexicon, "weights": weights}


def scores(texts: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) and P(toxic) of each text."""
    if model is None:
        return np.zeros(len(texts)), np.zeros(len(texts))
    votes, h, first, some = heuristics(texts, model["lexicon"])
    feature, row = slots(h, first, votes)
    z = np.stack([np.bincount(row, weights=model["weights"][feature, c], minlength=len(some)) for c in range(3)], axis=1) + model["weights"][-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return np.where(some, p[:, GOOD], 0.0), np.where(some, p[:, TOXIC], 0.0)


def classify(docs: DataFrame, model: dict | None, keep_columns: list[str], text_col: str = "text", threshold: float = 0.5, filter_only: bool = False) -> DataFrame:
    """The columns to keep, then quality_score, toxic_score and keep; with filter_only, the kept rows' columns alone."""
    rows = docs.select(*keep_columns, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep_columns).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "__text"):
            good, toxic = scores(b.column("__text"), model)
            if filter_only:
                yield b.drop_columns(["__text"]).filter(pa.array(good >= threshold))
            else:
                yield pa.record_batch([*b.columns[:-1], pa.array(good), pa.array(toxic), pa.array(good >= threshold)], [*keep_columns, "quality_score", "toxic_score", "keep"])

    return rows.mapInArrow(C.tidied(run), ", ".join(fields + ([] if filter_only else ["quality_score double", "toxic_score double", "keep boolean"])))
