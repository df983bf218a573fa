"""Scalar functions over coordinates, sequences and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def wrap(seq: Column, width: int = 80) -> Column:
    """The sequence in lines of ``width``; an empty one is one empty line."""
    return F.coalesce(F.regexp_replace(seq, f"(?s)(.{{{width}}})(?=.)", "$1\n"), F.lit(""))


def score(bbpos: Column, bepos: Column, diffs: Column) -> Column:
    return bepos - bbpos - diffs


def mirror(b: Column, e: Column, length: Column, when: Column) -> tuple[Column, Column]:
    """[b, e) seen from the other strand where ``when`` holds."""
    return F.when(when, length - e).otherwise(b), F.when(when, length - b).otherwise(e)


def overlap_length(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Length of the intersection of two half-open intervals."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(b1, b2))


def hull(b1: Column, e1: Column, b2: Column, e2: Column) -> tuple[Column, Column]:
    return F.least(b1, b2), F.greatest(e1, e2)


def indel_error(da: Column, db: Column) -> Column:
    """|da - db| / min(da, db); infinite if that minimum isn't positive."""
    least = F.least(da, db)
    return F.when(least <= 0, F.lit(float("inf"))).otherwise(F.abs(da - db).cast("double") / least)


def short_name(name: Column) -> Column:
    return F.split(name, "\\s", 2)[0]


def fields(line: Column) -> Column:
    """The fields of a line, split at white space."""
    return F.split(F.trim(F.regexp_replace(line, "\\s+", " ")), " ")


def is_inverse(strand: Column) -> Column:
    """False for ``+`` and true for ``-``; anything else is an error."""
    return F.when(strand == "+", False).when(strand == "-", True).otherwise(F.raise_error(F.concat(F.lit("unknown strand "), strand)).cast("boolean"))


def without_ambiguity(seq: Column, read_id: Column) -> Column:
    """``seq`` with each character but ACGT replaced by a base that depends on the read and the place alone."""
    chars = F.split(seq, "")
    fixed = F.transform(chars, lambda c, i: F.when(F.upper(c).isin("A", "C", "G", "T"), F.upper(c)).otherwise(F.substring(F.lit("ACGT"), F.pmod(read_id * 31 + i * 17, F.lit(4)).cast("int") + 1, F.lit(1))))
    return F.when(F.length(seq) == 0, "").otherwise(F.array_join(fixed, ""))


def four_letters(seq: Column) -> Column:
    """``seq`` in capitals, with N for each character but A, C, G and T."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def require_bases(seq: Column) -> Column:
    """``seq``, or an error if it holds anything but ACGT."""
    return F.when(seq.rlike("[^ACGTacgt]"), F.raise_error(F.lit("indeterminate base")).cast("string")).otherwise(seq)


def fastq(name: Column, seq: Column) -> Column:
    """A FASTQ record with constant quality H."""
    return F.concat(F.lit("@"), name, F.lit("\n"), F.upper(seq), F.lit("\n+\n"), F.repeat(F.lit("H"), F.length(seq)))


def fasta(name: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrap(seq, width))


def reformatted_name(prolog: str, number: Column, seq: Column, name: Column) -> Column:
    return F.concat(F.lit(f"{prolog}/"), number.cast("string"), F.lit("/0_"), F.length(seq).cast("string"), F.lit(" RQ=0.851 "), name)
