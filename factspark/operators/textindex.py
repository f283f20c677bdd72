"""A full-text index that is kept: postings in Parquet, changed by merges, ranked as `retrieval.bm25` ranks the texts it stands for.

A merge writes a segment, a folder seq=N in each table, and reads no older text:
  forward   id, length, terms (term, tf): what a document's removal has to take back
  postings  term, block, df, max_tf, min_length, entries (id, tf, length), each file sorted by term; df is how many entries there are
  terms     term, df: by how much the merge changed it       corpus  documents, length: the same
  gone      id: documents of older segments that the merge changed or deleted       bases     a row where the segment stands for all before it
corpus is written last; a segment without it is no part of the index, so a merge that died is written again under its number.

A block holds documents of one segment and of about one length, about BLOCK of them. max_tf and min_length bound what a term adds to the score of any of them, whatever weights and mean
length the corpus has by then; a question first scores the FIRST_BLOCKS blocks with the highest bounds, and then only those blocks whose bound reaches its k-th score. That
skips blocks and loses nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded, index_terms, query_terms
from ..sources.staging import removed, shared_folder, written
from .retrieval import ASKED_TERMS, FAN_IN, K1, LEAST_WEIGHT, B, ranked

BLOCK, FIRST_BLOCKS = 512, 4
#: Texts whose terms are counted before they are handed on.
COUNTED = 500
#: Asked terms up to which the postings' scan gets them as a filter, to skip row groups.
LITERAL_TERMS = 1000
SCHEMAS = {
    "forward": "id long, length int, terms array<struct<term: string, tf: int>>",
    "postings": "term string, block long, df int, max_tf int, min_length int, entries array<struct<id: long, tf: int, length: int>>",
    "terms": "term string, df long",
    "corpus": "documents long, length long",
    "gone": "id long",
}


class TextIndex:
    """The index below a folder that all executors share; it is made by its first merge."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table's committed rows, each with the seq of its segment."""
        schema = SCHEMAS[name] + ", seq int"
        paths = [f"{self.folder}/{name}/seq={i}" for i in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def whole(self, name: str) -> list[int]:
        """The segments whose folder in a table is whole."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName()[4:]) for p in found if p.getName().startswith("seq=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def segments(self) -> list[int]:
        """The committed segments, from the newest one on that stands for all before it."""
        done = self.whole("corpus")
        first = max(set(done) & set(self.whole("bases")), default=0)
        return [i for i in done if i >= first]

    def last(self) -> int:
        return max(self.segments(), default=0)

    def write(self, df: DataFrame, name: str, seq: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/seq={seq}")

    def live(self, *columns: str | Column) -> DataFrame:
        """The id and other columns of the forward rows of documents as they are now."""
        gone = self.table("gone").select(F.col("id").alias("gone_id"), F.col("seq").alias("gone_seq"))
        rows = self.table("forward").select("id", "seq", *columns)
        return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("gone_seq") > F.col("seq")), "left_anti").drop("seq")

    def merge(self, changed: DataFrame | None = None, deleted: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> int:
        """Adds or replaces documents (id, text) and removes others (id); returns the segment's number. Rows with a null id are left out; of several texts of
        one id the greatest counts; an id both changed and deleted is changed. Deleting an unknown id does nothing."""
        seq = self.last() + 1
        if changed is None:
            changed = self.spark.createDataFrame([], f"{id_col} long, {text_col} string")
        rows = changed.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
        cores = self.spark.sparkContext.defaultParallelism
        if len(changed.inputFiles()) < cores:  # counting costs far more than moving the rows
            rows = rows.repartition(max(cores, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "id")
        again = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), f"{shared_folder(self.spark, 'again')}/ids")
        if not again.isEmpty():  # texts travel only then
            rows = rows.join(again, "id", "left_anti").union(rows.join(again, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
        self.write(counted_terms(rows), "forward", seq)
        new = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.folder}/forward/seq={seq}")
        touched = new.select("id")
        if deleted is not None:
            touched = touched.union(deleted.select(F.col(id_col).cast("long").alias("id"))).distinct()
        self.write(self.live().join(touched, "id", "left_semi"), "gone", seq)
        # terms travel as one text of them, and only if some are taken back
        some = not self.spark.read.schema(SCHEMAS["gone"]).parquet(f"{self.folder}/gone/seq={seq}").isEmpty()
        old = self.live("length", F.array_join("terms.term", " ").alias("words")).join(touched, "id", "left_semi") if some else None
        self.finish(new, old, seq)
        return seq

    def finish(self, new: DataFrame, old: DataFrame | None, seq: int, base: bool = False) -> None:
        """Postings and counts of a segment with new forward rows, which takes back old ones (length, words); a base stands for all segments before it."""
        self.write(postings_of(new).sortWithinPartitions("term", "block"), "postings", seq)
        terms = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.folder}/postings/seq={seq}").select("term", "df")
        signed = new.select("length", F.lit(1).alias("sign"))
        if old is not None:
            terms = terms.union(old.where("words <> ''").select(F.explode(F.split("words", " ")).alias("term"), F.lit(-1).alias("df")))
            signed = signed.union(old.select("length", F.lit(-1).alias("sign")))
        self.write(terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "terms", seq)
        if base:
            self.write(self.spark.range(1), "bases", seq)
        self.write(signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("documents"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).alias("length")), "corpus", seq)

    def compact(self) -> int:
        """Writes the live documents' rows as one segment and drops the others; no text is read."""
        seq, before = self.last() + 1, self.whole("corpus")
        self.write(self.live("length", "terms"), "forward", seq)
        new = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.folder}/forward/seq={seq}")
        self.write(new.select("id").limit(0), "gone", seq)
        self.finish(new, None, seq, base=True)
        for i in before:
            for name in ("corpus", "postings", "forward", "terms", "gone", "bases"):
                removed(self.spark, f"{self.folder}/{name}/seq={i}")
        return seq

    def search(self, questions: DataFrame, k: int | None = FAN_IN, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """query_id, id, score (lower is better), rank from 1, for questions (query_id, question); all matches if k is None."""
        folder = shared_folder(self.spark, "search")
        asked = questions.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform(query_terms(F.col("question")), index_terms)))).alias("term"))
        asked = written(asked.distinct(), f"{folder}/asked")
        names = asked.select("term").distinct()
        few = [r.term for r in names.limit(LITERAL_TERMS + 1).collect()]

        def of_asked(df: DataFrame) -> DataFrame:
            return df.where(F.col("term").isin(few)) if len(few) <= LITERAL_TERMS else df.join(names, "term", "left_semi")

        corpus = self.table("corpus").agg(F.sum("documents").alias("n"), F.sum("length").alias("length"))
        df = of_asked(self.table("terms")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = df.crossJoin(F.broadcast(corpus)).select("term", (F.col("length") / F.col("n")).alias("mean"), F.when(weight <= 0, LEAST_WEIGHT).otherwise(weight).alias("weight"))  # corpus is one row
        wanted = written(asked.join(weights, "term"), f"{folder}/wanted")
        small = wanted.count() <= ASKED_TERMS
        held = of_asked(self.table("postings"))

        def weighed(df: DataFrame) -> DataFrame:
            return df.join(F.broadcast(wanted) if small else wanted, "term")

        def score(some: DataFrame | None = None) -> DataFrame:
            """The scores of all documents, or of those in some blocks that reach the least score given beside the block."""
            each = wanted.withColumn("least", F.lit(None).cast("double")) if some is None else some.select("query_id", "seq", "block", "least").join(F.broadcast(wanted) if small else wanted, "query_id")
            of = ["term"] if some is None else ["seq", "block", "term"]
            asking = each.groupBy(*of).agg(F.collect_list(F.struct("query_id", "weight", "mean", "least")).alias("asking"))
            return self.scored(held.select("seq", "block", "term", "entries").join(asking, of))

        if k is None:
            return ranked(score(), "score", "id", None)
        bounds = weighed(held.select("seq", "term", "block", "max_tf", "min_length")).withColumn("bound", part(F.col("max_tf"), F.col("min_length")))
        blocks = written(bounds.groupBy("query_id", "seq", "block").agg(F.sum("bound").alias("bound")), f"{folder}/blocks")
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "seq", "block")
        placed = written(blocks.withColumn("place", F.row_number().over(order)), f"{folder}/placed")
        first = placed.where(F.col("place") <= first_blocks).withColumn("least", F.lit(None).cast("double"))
        first = written(ranked(score(first), "score", "id", k), f"{folder}/first")
        least = first.where(F.col("rank") == k).select("query_id", (-F.col("score")).alias("least"))
        # scores are rounded to six places
        rest = placed.where(F.col("place") > first_blocks).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
        return ranked(first.drop("rank").union(score(rest)), "score", "id", k)

    def scored(self, entries: DataFrame) -> DataFrame:
        """query_id, id, score of the live documents in some postings (seq, block, term, entries, asking)."""
        query_type = entries.schema["asking"].dataType.elementType["query_id"].dataType.simpleString()
        sums = entries.groupBy("seq", "block").applyInArrow(scores_in_block, f"query_id {query_type}, id long, seq int, score double")
        gone = self.table("gone").groupBy(F.col("id").alias("gone_id")).agg(F.max("seq").alias("gone_seq"))
        alive = sums.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("gone_seq") > F.col("seq")), "left_anti")
        return alive.select("query_id", "id", F.round("score", 6).alias("score"))


def part(tf: Column, length: Column) -> Column:
    """What a term adds to a score; it grows with tf and falls with the length."""
    return F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))


def counted_terms(texts: DataFrame) -> DataFrame:
    """The forward rows of texts (id, text): their terms are those of index_terms, set apart by single spaces in Spark and counted in Python."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(at, COUNTED)
                terms, tfs, sizes, lengths = [], [], [], []
                for text in batch["text"].to_pylist():
                    n = Counter(text.split(" "))
                    n.pop("", None)
                    terms += n.keys()
                    tfs += n.values()
                    sizes.append(len(n))
                    lengths.append(n.total())
                pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(lengths, pa.int32()), lists], ["id", "length", "terms"])

    return texts.select("id", F.regexp_replace(folded(F.col("text")), r"[^\p{L}\p{N}]+", " ").alias("text")).mapInArrow(count, SCHEMAS["forward"])


def scores_in_block(postings: pa.Table) -> pa.Table:
    """query_id, id, seq, score of the documents of a block, from its postings (seq, entries, and asking: the questions that ask for the term, with its weight, the mean length
    and the least score that counts, if there is one); dead documents are still there."""
    lists, asking = postings["entries"].combine_chunks(), postings["asking"].combine_chunks()
    entries, at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids, doc = np.unique(entries.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
    tf, length = (entries.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "length"))
    sums: dict = {}
    for i, questions in enumerate(asking.to_pylist()):
        some = slice(at[i], at[i + 1])
        added = {}  # a term has one weight
        for q in questions:
            if q["weight"] not in added:
                added[q["weight"]] = q["weight"] * tf[some] * (K1 + 1) / (tf[some] + K1 * (1 - B + B * length[some] / q["mean"]))
            sums.setdefault(q["query_id"], (np.zeros(len(ids)), q["least"]))[0][doc[some]] += added[q["weight"]]
    names, which, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for query, (score, least) in sums.items():
        # scores are rounded to six places
        best = np.flatnonzero((score > 0) & (score >= (0 if least is None else least - 1e-6)))
        names += [query] * len(best)
        which.append(ids[best])
        scores.append(-score[best])
    seq = pa.array(np.full(len(names), postings["seq"][0].as_py(), np.int32))
    return pa.table([pa.array(names, asking.type.value_type.field("query_id").type), pa.array(np.concatenate(which)), seq, pa.array(np.concatenate(scores))], ["query_id", "id", "seq", "score"])


def postings_of(forward: DataFrame) -> DataFrame:
    """Postings in blocks of documents of about one length (within a factor of the square root of two)."""
    size = F.floor(2 * F.log2(F.greatest(F.col("length"), F.lit(1)).cast("double"))).cast("long")
    sized = forward.withColumn("size", size)
    parts = sized.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))  # 62 rows at most
    block = F.col("size") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts"))

    def lists(t: pa.Table) -> pa.Table:
        tfs = t["tfs"].combine_chunks()
        doc = np.repeat(np.arange(len(t)), tfs.value_lengths().to_numpy(zero_copy_only=False))
        words = pc.split_pattern(t["words"].filter(pc.not_equal(t["words"], "")).combine_chunks(), " ").flatten()  # each word is a term once
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        doc, tf = doc[order], tfs.flatten().to_numpy(zero_copy_only=False)[order]
        length, ids = (t[c].to_numpy()[doc] for c in ("length", "id"))
        at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        most, least = (f.reduceat(x, at[:-1]) if len(code) else np.zeros(0, np.int32) for f, x in ((np.maximum, tf), (np.minimum, length)))
        entries = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(ids), pa.array(tf, pa.int32()), pa.array(length, pa.int32())], ["id", "tf", "length"]))
        blocks = np.full(len(most), t["block"][0].as_py(), np.int64)
        columns = [coded.dictionary, pa.array(blocks), pa.array(np.diff(at), pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32()), entries]
        return pa.table(columns, ["term", "block", "df", "max_tf", "min_length", "entries"])

    words, tfs = F.array_join("terms.term", " ").alias("words"), F.col("terms.tf").alias("tfs")  # far fewer bytes to move than pairs
    return sized.join(F.broadcast(parts), "size").select("id", "length", words, tfs, block.alias("block")).groupBy("block").applyInArrow(lists, SCHEMAS["postings"])
