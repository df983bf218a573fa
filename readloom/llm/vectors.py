"""Vectors of whole numbers, on which sums and products are exact."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of as much or more in amount, once scaled, are out of range: below it 2^15 products of two add up in 64 bits.
LARGEST = 1 << 24


def whole_numbers(embedding: str, scale: int) -> Column:
    """floor(scale * x) of each component x as double; null where the array is null or holds a null, non-finite or
    out-of-range component."""
    v = F.col(embedding).cast("array<double>")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)) & (F.abs(x * scale) < F.lit(float(LARGEST))))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(v, lambda x: F.floor(x * scale).cast("int")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow column of arrays that all have ``dim`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False).reshape(len(column), dim)


def in_tasks(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as the session shuffles into, at least the cluster's cores."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
