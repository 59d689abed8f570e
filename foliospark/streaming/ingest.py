"""Streaming ingest of Markdown files. An extension: the batch operators, run as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import kb


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (source, markdown) from the .md files that appear in a folder."""
    found = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(folder)
    return found.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("markdown"))


def chunk_into(files: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes the chunks of arriving files, each batch once, under its number."""

    def write(batch: DataFrame, number: int) -> None:
        kb.chunk(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
