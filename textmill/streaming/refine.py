"""Refinement of streams: the row-local kernels carry no state, so they run on any stream of texts unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.refine import refine


def refined_stream(stream: DataFrame, text_col: str = "text", preset: str = "safe", **overrides: object) -> DataFrame:
    return stream.withColumn("refined", refine(F.col(text_col), preset, **overrides))


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Writes what the stream has now as Parquet, exactly once, and returns the table."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
