"""Renumbering, sampling and splitting of reads and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.joins import both_in
from readloom.plans.prefix import rank, running_sum

BLOCK_IDS = 4096


def dense(ids: DataFrame, old: str, new: str) -> DataFrame:
    """``ids`` with ``new``: the rank of ``old``, from 0."""
    return rank(ids, F.floor(F.col(old) / BLOCK_IDS), [old], new)


def referenced(ovl: DataFrame) -> DataFrame:
    """(read_id): the reads that overlaps refer to."""
    return ovl.select(F.explode(F.array("aread", "bread")).alias("read_id")).distinct()


def renumbered(ovl: DataFrame, ids: DataFrame) -> DataFrame:
    """``ovl`` with both ids replaced by those of ``ids`` (read_id, new_id); rows with a read that lacks one go."""
    a = ids.select(F.col("read_id").alias("aread"), F.col("new_id").alias("new_a"))
    b = ids.select(F.col("read_id").alias("bread"), F.col("new_id").alias("new_b"))
    both = ovl.join(a, "aread").join(b, "bread").withColumns({"aread": F.col("new_a"), "bread": F.col("new_b")})
    return both.select(*ovl.columns)


def subset(ovl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The overlaps over a dense numbering of the reads that they refer to, and that numbering (read_id, new_id)."""
    ids = dense(referenced(ovl), "read_id", "new_id")
    return renumbered(ovl, ids), ids


def seeded(read_id: Column, seed: int) -> Column:
    """A number from 0 to 2^60 that a seed and an id determine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), read_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample_reads(reads: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Reads drawn in a seeded random order until they hold ``floor(p * bases + 0.5)`` bases or more."""
    target = F.floor(F.col("bases") * F.lit(float(p)) + 0.5)
    goal = reads.agg(F.coalesce(F.sum("rlen"), F.lit(0)).alias("bases"), F.count("*").alias("n"))
    drawn = reads.withColumn("_h", seeded(F.col("read_id"), seed)).crossJoin(F.broadcast(goal))  # one row
    # About 4096 reads a bucket, whatever their number.
    bucket = F.floor(F.col("_h") / F.lit(float(1 << 60)) * F.ceil(F.col("n") / 4096))
    before = running_sum(drawn, bucket, ["_h", "read_id"], F.col("rlen"), "_before")
    return before.where(F.col("_before") < target).select(*reads.columns)


def subsample(ovl: DataFrame, reads: DataFrame, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Overlaps between reads of a sample."""
    return both_in(ovl, sample_reads(reads, p, seed))


def reduce(ovl: DataFrame, reads: DataFrame, p: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A sample of reads numbered anew (with new_id), and the overlaps between them under the new numbers."""
    kept = dense(sample_reads(reads, p, seed), "read_id", "new_id")
    return renumbered(ovl, kept), kept


def blocks(reads: DataFrame, bases: int) -> DataFrame:
    """``reads`` with ``block``, from 1: a read belongs to the block that the bases before it, by id, fill up to."""
    before = running_sum(reads, F.floor(F.col("read_id") / BLOCK_IDS), ["read_id"], F.col("rlen"), "_before")
    return before.withColumn("block", (F.floor(F.col("_before") / bases) + 1).cast("long")).drop("_before")


def split(ovl: DataFrame, read_blocks: DataFrame, by: str = "aread") -> DataFrame:
    """``ovl`` with the block of its A or B read; a read outside all blocks is an error. Write with
    ``partitionBy("block")``."""
    b = read_blocks.select(F.col("read_id").alias(by), "block")
    known = F.coalesce("block", F.raise_error(F.lit("read outside all blocks")).cast("long"))
    return ovl.join(b, by, "left").withColumn("block", known)


def bins(ovl: DataFrame, size: int) -> DataFrame:
    """(aread, bin, rows): overlaps by where they begin on A; an index of the table."""
    return ovl.groupBy("aread", F.floor(F.col("abpos") / size).cast("long").alias("bin")).agg(F.count("*").alias("rows"))


def shard(pairs: DataFrame, part: int, parts: int, order: list[str]) -> DataFrame:
    """Part ``part`` of ``parts`` of a list: rows [part * c, (part + 1) * c) in order, c the size of a part rounded up."""
    if not 0 <= part < parts:
        raise ValueError("part must be under parts")
    numbered = rank(pairs, F.floor(F.col(order[0]) / BLOCK_IDS), order, "_n")
    size = pairs.agg(F.ceil(F.count("*") / parts).alias("_c"))
    cut = numbered.crossJoin(F.broadcast(size)).where((F.col("_n") >= part * F.col("_c")) & (F.col("_n") < (part + 1) * F.col("_c")))  # one row
    return cut.select(*pairs.columns)
