"""Pages that arrive over time: each batch is merged by content-addressed ids, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_id, page_id


def stream_pages(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Starts a run over the files in source now (url, html) and appends pages with unknown ids to target; returns the query.

    Writing a batch is not atomic: one that dies half-way leaves some of its rows, which its replay takes as known. That is right only because ids are
    hashes of the content, so a row is the same whenever it is written.

    A page's partition is the first two signs of its id's hash, so a batch is compared with the partitions it touches only."""
    pages = spark.readStream.schema(schema).parquet(source)

    def merge(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        sha = F.sha2(F.coalesce("html", F.lit("")), 256)
        rows = batch.select(page_id(document_id(sha), F.lit(1)).alias("id"), "url", "html").dropDuplicates(["id"]).withColumn("part", F.substring("id", 4, 2))
        jvm = session.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(session.read.parquet(target).select("id", "part"), ["part", "id"], "left_anti")
        rows.select("id", "url", "html", "part").write.mode("append").partitionBy("part").parquet(target)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
