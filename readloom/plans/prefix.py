"""Global running sums and ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Neighbouring buckets whose sums are added in a task of their own.
WIDE = 4096


def running_sum(df: DataFrame, bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before each, by (bucket, order).

    ``bucket``, a number, must not decrease along the order. Buckets are summed first, and their sums by WIDE neighbouring
    buckets; only the latter, one row of WIDE buckets, meet in one task. Rows are sorted within their bucket. Choose buckets of
    some thousands of rows.
    """
    with_bucket = df.withColumn("_bucket", bucket)
    sums = with_bucket.groupBy("_bucket").agg(F.sum(value).alias("_sum")).withColumn("_wide", F.floor(F.col("_bucket") / WIDE))
    totals = sums.groupBy("_wide").agg(F.sum("_sum").alias("_total"))
    earlier = F.sum("_total").over(Window.orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("_wide").alias("_w"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    before = F.sum("_sum").over(Window.partitionBy("_wide").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).join(totals, F.col("_wide").eqNullSafe(F.col("_w")))
    sums = sums.select(F.col("_bucket").alias("_b"), (F.col("_earlier") + F.col("_before")).alias("_sum_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = with_bucket.withColumn("_sum_inside", F.coalesce(inside, F.lit(0))).join(sums, F.col("_bucket").eqNullSafe(F.col("_b")))
    return both.withColumn(name, (F.col("_sum_before") + F.col("_sum_inside")).cast("long")).drop("_bucket", "_b", "_sum_before", "_sum_inside")


def rank(df: DataFrame, bucket: Column, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: how many rows come before each, by (bucket, order)."""
    return running_sum(df, bucket, order, F.lit(1), name)


def before(df: DataFrame, bucket: Column, order: list, value: Column | str, name: str, group: list[str] = ()) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before each in its group by (bucket, order), null for the first.

    As with ``running_sum``, ``bucket`` must not decrease along the order. Rows are sorted within their bucket; of each bucket
    only its last value, one row, meets the others of its group in one task. A ``value`` that is a column of ``df`` is best given
    by its name, as it isn't carried twice then.
    """
    named = isinstance(value, str)
    keyed = df.withColumns({"_bucket": bucket} if named else {"_bucket": bucket, "_value": value})
    value = value if named else "_value"
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    lasts = keyed.groupBy(*group, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("_value")), F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_last", F.lag("_last").over(Window.partitionBy(*group).orderBy("_bucket")))
    lasts = lasts.select(F.col("_last._value").alias("_last"), *(F.col(c).alias(f"_on{i}") for i, c in enumerate([*group, "_bucket"])))
    rows = keyed.withColumns({"_place": F.row_number().over(inside), "_inside": F.lag(value).over(inside)})
    for i, c in enumerate([*group, "_bucket"]):
        on = F.col(c).eqNullSafe(F.col(f"_on{i}"))
        joint = on if i == 0 else joint & on
    out = rows.join(lasts, joint).withColumn(name, F.when(F.col("_place") == 1, F.col("_last")).otherwise(F.col("_inside")))
    return out.select(*df.columns, name)
