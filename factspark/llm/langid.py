"""Language identification by error-correcting output codes.

Each language has a binary codeword; for each bit a logistic classifier on hashed byte n-grams (1 to 3 bytes of the folded
text) predicts it. Decoding weighs each bit's loss by that classifier's accuracy and takes the nearest codeword; the score is
the softmax of the negative losses, and a text whose two best codewords lie close is flagged ambiguous.

The classifiers are fitted on a bounded sample (SAMPLE rows, evenly by language, the first by a hash of text); every text is
then classified whole. A null text, or one without a letter, is `und` with score 0 and not ambiguous. Rows with null text or
language teach nothing; without any teaching row all is `und` with score 0. Repeated rows return once each; an empty table gives no row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Rows that the classifiers are fitted on, at most.
SAMPLE = 4000
SALTS = 256
FEATURES = 1 << 11
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.5


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of -1 and 1; of many random books the one with the largest least distance."""
    bits = max(15, 4 * int(np.ceil(np.log2(max(2, n)))))
    rng, top, value = np.random.default_rng(seed), None, -1
    for _ in range(500):
        book = rng.choice([-1, 1], size=(n, bits))
        away = min(((a != b).sum() for i, a in enumerate(book) for b in book[:i]), default=bits)
        varied = n == 1 or not (np.abs(book.sum(axis=0)) == n).any()
        if varied and away > value or top is None:
            top, value = book, away
    return top


def features(texts: pa.Array) -> np.ndarray:
    """One row for each text: square roots of the counts of hashed n-grams, of length 1."""
    buf, off = C.raw(texts)
    low = C.LOWER[buf]
    out = np.zeros((len(off) - 1, FEATURES), np.float32)
    code = np.zeros(len(low), np.uint32)
    row_base = np.repeat(np.arange(len(off) - 1, dtype=np.int64) * FEATURES, np.diff(off))
    flat = out.reshape(-1)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(low))
    with np.errstate(over="ignore"):
        for k in range(1, max(ORDERS) + 1):
            m = len(low) - k + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(257) + low[k - 1 :] + np.uint32(1)
            if k in ORDERS:
                slot = (code * np.uint32(2654435761 + 2 * k)) >> np.uint32(32 - 11)
                ok = left[:m] >= k
                flat += np.bincount((row_base[:m] + slot)[ok], minlength=len(flat)).astype(np.float32)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, langs: np.ndarray, rounds: int = 150) -> bytes:
    """The model: languages, codewords, weights and each bit's accuracy on the sample."""
    names, y = np.unique(langs.astype(str), return_inverse=True)
    book = codebook(len(names))
    target = book[y].astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], book.shape[1]), np.float32)
    ahead, step = w.copy(), 4.0
    for i in range(rounds):
        margin = np.clip((x @ ahead) * target, -30, 30)
        new = ahead - step * (x.T @ (-target / (1 + np.exp(margin))) / len(x) + 1e-5 * ahead)
        ahead, w = new + i / (i + 3) * (new - w), new
    right = ((x @ w) * target > 0).mean(axis=0)
    out = io.BytesIO()
    np.savez(out, names=names, book=book, w=w, right=right)
    return out.getvalue()


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each row of features."""
    margin = np.clip(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ model["w"], -30, 30)
    weight = np.maximum(model["right"] - 0.5, 1e-3)
    loss = (np.log1p(np.exp(-margin[:, None, :] * model["book"][None])) * weight).sum(axis=2) / weight.mean()
    likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    second = np.sort(likely, axis=1)[:, -2] if likely.shape[1] > 1 else np.zeros(len(x))
    score = likely[np.arange(len(x)), best]
    return model["names"][best], score, second > AMBIGUOUS * score


def train(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    """The model from the rows of docs where teaches holds; it is fitted in one task, on at most sample rows."""
    rows = docs.where(teaches & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs = rows.select("lang").distinct().count()
    if not langs:
        return None
    quota = max(1, sample // langs)
    order = W.partitionBy("lang").orderBy("h")
    # the first of each salt, then of those, at most SALTS * quota rows for each language: no task gathers a frequent one's rows
    hashed = rows.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)))
    hashed = hashed.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy("h"))).where(F.col("place") <= quota)
    cut = hashed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).groupBy("lang").agg(F.max("h").alias("cut"))
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(cut), "lang").where("h <= cut").dropDuplicates(["lang", "h"])

    def hashed_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text", 1 << 20):
            x = features(b.column("text"))
            yield pa.record_batch([b.column("lang"), C.blobs(x.reshape(-1), np.arange(len(x) + 1) * FEATURES), pa.array([0] * len(x), pa.int32())], ["lang", "x", "one"])

    def fitted(t: pa.Table) -> pa.Table:
        x = np.frombuffer(C.raw(t["x"])[0], np.float32).reshape(-1, FEATURES)
        order = np.lexsort((x @ np.arange(FEATURES, dtype=np.float32), t["lang"].to_numpy(zero_copy_only=False)))
        return pa.table([pa.array([fit(x[order], t["lang"].to_numpy(zero_copy_only=False)[order])], pa.binary())], ["model"])

    model = picked.select("text", "lang").mapInArrow(C.tidied(hashed_features), "lang string, x binary, one int").groupBy("one").applyInArrow(fitted, "model binary").collect()[0].model
    return dict(np.load(io.BytesIO(bytes(model))))


def identify(docs: DataFrame, model: dict | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep, then lang_pred, score and ambiguous."""
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*keep, F.when(letter, F.col(text_col)).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "__text", 1 << 20):
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                text = part.column("__text")
                some = text.is_valid().to_numpy(zero_copy_only=False)
                lang, score, close = np.full(len(text), "und", object), np.zeros(len(text)), np.zeros(len(text), bool)
                if model is not None and some.any():
                    name, s, near = decode(model, features(text.filter(text.is_valid())))
                    lang[some], score[some], close[some] = name, s, near
                columns = [part.column(c) for c in keep]
                yield pa.record_batch([*columns, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(close)], [*keep, "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(C.tidied(run), ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean"]))


def held_out(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold

