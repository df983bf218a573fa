"""Filters over files of overlaps as they arrive. All operators are stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from readloom.operators import filters, joins


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that are put under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def proper_overlaps(stream: DataFrame, reads: DataFrame) -> DataFrame:
    """Proper overlaps of a stream without lengths, which come from the static ``reads``."""
    return filters.proper(joins.with_lengths(stream, reads))
