"""Operators that cut traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.trace import aligned, b_length
from readloom.operators.filters import not_empty


def align_to_tiles(ovl: DataFrame, ts: int = 100) -> DataFrame:
    """Overlaps shrunk to tile borders at both ends, without those of which nothing is left."""
    return not_empty(ovl.withColumns(aligned(*(F.col(c) for c in ("abpos", "aepos", "bbpos", "bepos", "trace")), ts)))


def quality_clip(ovl: DataFrame, good: DataFrame, ts: int = 100) -> DataFrame:
    """The parts of overlaps, aligned to tiles, within each good interval (read_id, ifrom, ito, at tile borders) of A."""
    cut = align_to_tiles(ovl, ts)
    g = good.select(F.col("read_id").alias("aread"), "ifrom", "ito")
    # By sorting: Spark takes the intervals to be as small as the reads they come from, and would broadcast them.
    both = cut.join(g.hint("merge"), "aread").where((F.col("abpos") < F.col("ito")) & (F.col("ifrom") < F.col("aepos")))
    begin, end = F.greatest("abpos", "ifrom"), F.least("aepos", "ito")
    tiles = {"_skip": ((begin - F.col("abpos")) / ts).cast("int"), "_keep": ((end - begin) / ts).cast("int")}
    # Columns of their own, each computed once for the several that use them.
    both = both.withColumns(tiles).withColumns({"_inside": F.slice("trace", F.col("_skip") + 1, F.col("_keep")), "_front": F.col("bbpos") + b_length(F.slice(F.col("trace"), F.lit(1), F.col("_skip")))})
    new = {"abpos": begin, "aepos": end, "bbpos": F.col("_front"), "bepos": F.col("_front") + b_length(F.col("_inside")), "trace": F.col("_inside")}
    return both.select(*(new.get(c, F.col(c)).alias(c) for c in ovl.columns))
