"""The registered queries of this folder: op<N>_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import decontaminate, jaccard, neardup, resample, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels"), C.work_dir(spark, "quality")), keep_columns=["doc_id"])


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import read_tokens, write_tokens

    folder = C.work_dir(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(manifest, folder)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), C.work_dir(spark, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), C.work_dir(spark, "substring")).drop("kept_text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"), C.work_dir(spark, "html"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, train(docs, ~F.col("held_out")), keep=["doc_id", "held_out"])


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, C.work_dir(spark, "neighbours"), k=20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"), C.work_dir(spark, "warc")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link

    return link(table(spark, sf_dir, "documents"), C.work_dir(spark, "jaccard"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .align import align

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(table(spark, sf_dir, "documents"), *files, C.work_dir(spark, "alignment"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "embeddings"), C.work_dir(spark, "graph"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), C.work_dir(spark, "resampling"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_token_output, op3_decontamination, op4_substring_dedup, op5_html_extraction, op6_language_id, op7_sentencepiece, op8_nearest_neighbours, op9_warc, op10_jaccard_join, op11_alignment, op12_embedding_dedup, op13_resampling)}
ORACLE_SQL: dict[str, str] = {"op3_decontamination": decontaminate.ORACLE, "op4_substring_dedup": substring.ORACLE, "op9_warc": warc.ORACLE, "op10_jaccard_join": jaccard.ORACLE, "op12_embedding_dedup": neardup.ORACLE, "op13_resampling": resample.ORACLE}
