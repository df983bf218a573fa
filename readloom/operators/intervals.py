"""Interval algebra over (read_id, ifrom, ito), half open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.operators.filters import self_forward
from readloom.operators.joins import touching_either


def union(intervals: DataFrame) -> DataFrame:
    """The intervals of each read with those that touch or overlap merged."""
    order = Window.partitionBy("read_id").orderBy("ifrom", "ito")
    before = F.max("ito").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("new", F.coalesce(F.col("ifrom") > before, F.lit(True)).cast("long"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("read_id", "island").agg(F.min("ifrom").alias("ifrom"), F.max("ito").alias("ito")).drop("island")


def tandem(ovl: DataFrame, only_true: bool = False) -> DataFrame:
    """Merged intervals in which a read aligns to itself forward: the hull of the A and B spans where they overlap, else,
    unless ``only_true``, both spans."""
    a = F.struct(F.col("abpos").alias("ifrom"), F.col("aepos").alias("ito"))
    b = F.struct(F.col("bbpos").alias("ifrom"), F.col("bepos").alias("ito"))
    hull = F.struct(F.least("abpos", "bbpos").alias("ifrom"), F.greatest("aepos", "bepos").alias("ito"))
    meet = (F.col("abpos") < F.col("bepos")) & (F.col("bbpos") < F.col("aepos"))
    none = F.array().cast("array<struct<ifrom:bigint,ito:bigint>>")
    spans = F.when(meet, F.array(hull)).otherwise(none if only_true else F.array(a, b))
    return union(self_forward(ovl).select(F.col("aread").alias("read_id"), F.inline(spans)))


def end_distances(intervals: DataFrame, reads: DataFrame) -> DataFrame:
    """How far each interval is from the ends of its read."""
    both = intervals.join(reads.select("read_id", "rlen"), "read_id")
    return both.select("read_id", "ifrom", "ito", F.greatest(F.lit(0), "ifrom").cast("long").alias("front"), F.greatest(F.lit(0), F.col("rlen") - F.col("ito")).cast("long").alias("back"))


def quality_runs(quals: DataFrame, most: int = 25, ts: int = 100) -> DataFrame:
    """Maximal runs of tiles with a quality value of at most ``most`` as intervals (quals: read_id, q array)."""
    good = quals.select("read_id", F.posexplode("q").alias("t", "v")).where(F.col("v") <= most)
    run = F.col("t") - F.row_number().over(Window.partitionBy("read_id").orderBy("t"))
    runs = good.withColumn("run", run).groupBy("read_id", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return runs.select("read_id", (F.col("a") * ts).cast("long").alias("ifrom"), ((F.col("b") + 1) * ts).cast("long").alias("ito"))


def tandem_pairs(ovl: DataFrame, intervals: DataFrame, key: list[str] = (), closed_end: bool = False) -> DataFrame:
    """Distinct (aread, bread) of the overlaps that touch an interval of either read; rows needn't be told apart by ``key``."""
    slim = ovl.select("aread", "bread", "abpos", "aepos", "bbpos", "bepos")
    return touching_either(slim, intervals, closed_end).select("aread", "bread").distinct()


def masks_view(intervals: DataFrame, reads: DataFrame, track: str) -> DataFrame:
    """(track, read_id, idx, ifrom, ito, rlen): intervals numbered within their read."""
    idx = F.row_number().over(Window.partitionBy("read_id").orderBy("ifrom", "ito")) - 1
    return intervals.withColumn("idx", idx.cast("long")).join(reads.select("read_id", "rlen"), "read_id").select(F.lit(track).alias("track"), "read_id", "idx", "ifrom", "ito", "rlen")
