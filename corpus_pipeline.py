"""From raw documents to pieces for training: each stage reads the Parquet files that the stage before it wrote.

quality drops documents that the classifier rejects. near_duplicates keeps one document of each group that links of Jaccard
similarity 0.8 or more connect (the one whose row hash is least; repeated rows count as one). repeated_passages removes the words that a
repeated window of 35 words covers; a document that loses all of them stays, with empty text. decontamination drops documents that hold a benchmark
item. pieces returns each document's best segmentation. Columns beyond those of documents pass through unchanged; n_chars
follows the text where it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm import decontaminate, jaccard, pieces, quality, substring
from factspark.llm.common import dropped_after, staged, work_dir

#: SQL has no expectation-maximisation, no A* search and no sampled paths.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), work_dir(spark, "quality"))
    return quality.classify(docs, model, keep_columns=docs.columns, filter_only=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = substring.key_of(docs, ["doc_id", "text"])
    linked = jaccard.link(keyed.select("__key", "text"), work_dir(spark, "jaccard"), id_col="__key")
    first = linked.where("doc_id = class_id").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(docs, work_dir(spark, "substring"), keep_columns=docs.columns, prefix="__")
    text = F.when(F.col("__n_removed") > 0, F.col("__kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("__n_removed") > 0, F.length("__kept_text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = substring.key_of(docs, ["doc_id", "text"])
    held = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work_dir(spark, "benchmark"), id_col="__key")
    held = staged(held.select(F.col("doc_id").alias("__key")).distinct(), work_dir(spark, "contaminated"), "keys")
    return keyed.join(held, "__key", "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with dropped_after(spark):
            docs = staged(stage(spark, docs, sf_dir), folder, name)
    return docs
