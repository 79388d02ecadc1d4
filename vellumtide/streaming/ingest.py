"""Streaming ingest: PDF files as they arrive in a folder, to a table of page text (or any other operator on pages)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumtide.operators import layout
from vellumtide.sources import readers

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """New PDF files under folder: doc_id (path), sha256, content. A file that comes again within `late` under another name is dropped; state is bounded by the watermark."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.pdf").load(folder)
    marked = files.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", late)
    return marked.dropDuplicatesWithinWatermark(["sha256"]).select(F.col("path").alias("doc_id"), "sha256", "content")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, operator: Callable = layout.page_text) -> StreamingQuery:
    """Runs the operator on all pages of all files there are, appends its rows to Parquet and stops; run again, it takes up where it stopped."""
    rows = operator(readers.parse(arriving(spark, folder)))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
