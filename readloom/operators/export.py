"""Reads as FASTA records: what subsets, samples, extracts and reformatted files hold. Write ``record`` with ``.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.scalar import reformatted_name, require_bases, revcomp, without_ambiguity, wrap
from readloom.operators import filters, renumber
from readloom.plans.prefix import rank


def _numbered(number: Column) -> Column:
    return F.concat(F.lit("L0/"), number.cast("string"), F.lit("/0_"), F.length("seq").cast("string"))


def record(name: Column, seq: Column, width: int = 80) -> Column:
    """A FASTA record; its lines end behind each ``width`` bases, and an empty sequence has none."""
    return F.concat(F.lit(">"), name, F.when(F.length(seq) > 0, F.concat(F.lit("\n"), wrap(seq, width))).otherwise(""))


def subset(ovl: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The overlaps over a dense numbering of the reads they refer to, and the records (read_id, new_id, record) of these
    reads (``reads``: read_id, seq), named by their old number."""
    renumbered, ids = renumber.subset(ovl)
    kept = reads.join(ids, "read_id")
    return renumbered, kept.select("read_id", "new_id", record(_numbered(F.col("read_id")), F.col("seq")).alias("record"))


def reduce(ovl: DataFrame, reads: DataFrame, p: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The overlaps between the reads of a sample, and the sample's records (read_id, new_id, record), named by their new
    number with the old one and the span behind it (``reads``: read_id, rlen, seq)."""
    kept = renumber.dense(renumber.sample_reads(reads, p, seed), "read_id", "new_id")
    span = F.concat(F.col("read_id").cast("string"), F.lit("[0,"), F.length("seq").cast("string"), F.lit(")"))
    name = F.concat_ws(" ", _numbered(F.col("new_id")), span)
    records = kept.select("read_id", "new_id", record(name, F.col("seq")).alias("record"))
    return renumber.renumbered(ovl, kept.select("read_id", "new_id")), records


def extract(reads: DataFrame, spec: str | None = None, cutoff: int | None = None, reverse: bool = False) -> DataFrame:
    """(read_id, record) of the reads (read_id, name, rlen, seq) in a range ``a-b`` or ``a``. With ``cutoff`` only reads of so
    many bases have numbers, from 0, and the range is of these; with ``reverse`` the other strand is given."""
    numbered = reads if cutoff is None else filters.trimmed(reads, cutoff)
    seq = revcomp(F.col("seq")) if reverse else F.col("seq")
    return filters.read_range(numbered, spec).select("read_id", record(F.col("name"), seq).alias("record"))


def reformat(records: DataFrame, order: list, prolog: str = "L", first: int = 0, width: int = 80, replace: bool = True) -> DataFrame:
    """(number, record) of the records (name, comment, seq) of a FASTA or FASTQ file, numbered from ``first`` on in the order
    of the columns ``order``, of which the first is a number. A base but ACGT gives way to one that its read and place
    determine, or, without ``replace``, is an error."""
    numbered = rank(records, F.floor(F.col(order[0]) / 4096), order, "_rank").withColumn("number", F.col("_rank") + first)
    seq = without_ambiguity(F.col("seq"), F.col("number")) if replace else require_bases(F.col("seq"))
    head = F.when(F.length("comment") > 0, F.concat_ws(" ", "name", "comment")).otherwise(F.col("name"))
    fixed = numbered.withColumns({"seq": seq, "head": head})
    return fixed.select("number", record(reformatted_name(prolog, F.col("number"), F.col("seq"), F.col("head")), F.col("seq"), width).alias("record"))


def name_lengths(records: DataFrame) -> DataFrame:
    """(name, rlen): the length of each record (name, seq) by its short name; of several with one name the first by length
    stands, as names are looked up."""
    return records.groupBy("name").agg(F.min(F.length("seq")).cast("long").alias("rlen"))
