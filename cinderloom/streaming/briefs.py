"""Structured Streaming over growing files: an addition of this engine, for logs and briefs that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise
from ..operators.dedupe import near_dedupe
from ..operators.report import log_series
from ..schemas import TRAIN_LOG


def follow(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    """JSON lines of a folder, file by file as they come."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.json(path)


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The series of a training log as it grows."""
    return log_series(follow(spark, path, TRAIN_LOG))


def distinct_briefs(briefs: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Briefs without exact repeats (after normalising) within the delay; state older than it is dropped."""
    return briefs.withColumn("norm", normalise(F.col("description"))).where("norm != ''").withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["norm"])


def accept_batches(kept_path: str, cut: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends what resembles neither the batch's earlier rows nor those kept before.

    A batch that is run again after a failure replaces its own part.
    """

    def accept(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = T.StructType([T.StructField("description", T.StringType()), T.StructField("ordinal", T.LongType())])
        try:
            kept = spark.read.schema(schema).option("basePath", kept_path).json(f"{kept_path}/batch=*").where(F.col("batch") < number) if number else None
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            kept = None
        fresh = near_dedupe(batch.select("description", "ordinal"), kept, cut=cut)
        fresh.write.mode("overwrite").json(f"{kept_path}/batch={number}")

    return accept
