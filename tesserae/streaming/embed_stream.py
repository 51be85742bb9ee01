"""Embedding a directory of Parquet files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.embedding import embed_column


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def embed_stream(spark: SparkSession, source: str, schema: str, text_col: str, sink: str, checkpoint: str, **options):
    """Starts a query that embeds what is there and stops; files done are in the checkpoint, so a rerun goes on after them."""
    out = embed_column(parquet_stream(spark, source, schema), text_col, **options)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
