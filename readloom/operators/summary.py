"""Figures over whole tables: each is an aggregate that Spark computes in parts first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import cigar as cg
from readloom.functions.trace import error_rate


def lengths(reads: DataFrame) -> DataFrame:
    """(read_id, rlen) of all reads; only these columns are read."""
    return reads.select("read_id", "rlen")


def quality_values(quals: DataFrame) -> DataFrame:
    """(read_id, t, q): the quality value of each tile (quals: read_id, q array)."""
    return quals.select("read_id", F.posexplode("q").alias("t", "q")).withColumn("t", F.col("t").cast("long"))


def aread_range(ovl: DataFrame) -> DataFrame:
    """(lo, hi): the least and the greatest A read."""
    return ovl.agg(F.min("aread").alias("lo"), F.max("aread").alias("hi"))


def max_error(ovl: DataFrame) -> DataFrame:
    """(max_error): the largest error rate of all overlaps; by ``diffs`` where there is no trace."""
    trace = F.col("trace") if "trace" in ovl.columns else F.lit(None).cast("array<struct<err:int,blen:int>>")
    return ovl.agg(F.max(error_rate(trace, F.col("diffs"), F.col("abpos"), F.col("aepos"))).alias("max_error"))


def cigar_operators(rows: DataFrame) -> DataFrame:
    """(op, runs, length): each operator that occurs in the CIGAR strings of ``rows`` (cigar), its runs and their length."""
    each = rows.select(F.inline(cg.runs(F.col("cigar"))))
    return each.groupBy("op").agg(F.count("*").alias("runs"), F.sum("n").alias("length"))


def kept_fractions(reads: DataFrame, kept: DataFrame) -> DataFrame:
    """(read_fraction, base_fraction) of a part ``kept`` of the reads (rlen). Two one-row sums meet."""
    total = reads.agg(F.count("*").alias("n"), F.sum("rlen").alias("bases"))
    part = kept.agg(F.count("*").alias("kept"), F.sum("rlen").alias("kept_bases"))
    return part.crossJoin(total).select((F.col("kept").cast("double") / F.col("n")).alias("read_fraction"), (F.col("kept_bases").cast("double") / F.col("bases")).alias("base_fraction"))


def chain_counts(ovl: DataFrame) -> DataFrame:
    """(bread, n_chains): chain starts of each B read."""
    return ovl.groupBy("bread").agg(F.sum(F.col("is_start").cast("long")).alias("n_chains"))
