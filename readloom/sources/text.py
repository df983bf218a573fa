"""FASTA, FASTQ, PAF, m4 and SAM text as relations, and back to text.

Readers take a frame of lines or records with a number that orders them, so that no operator relies on physical order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from readloom.functions.scalar import fields, is_inverse, short_name


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, comment, seq) of FASTA files: a record from each ``>``, its sequence lines joined."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    return records.where(F.trim("value") != "").select(*_fasta_record(F.col("value")))


def parse_fasta(records: DataFrame) -> DataFrame:
    """As ``fasta``, from (value): what stands behind each ``>``."""
    return records.select(*_fasta_record(F.col("value")))


def _fasta_record(value: Column) -> list[Column]:
    head = F.regexp_extract(value, "^([^\\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(value, "^[^\\n]*", ""), "\\s", "")
    return [short_name(head).alias("name"), F.regexp_extract(head, "^\\S*\\s+(.*)$", 1).alias("comment"), body.alias("seq")]


def fastq(lines: DataFrame) -> DataFrame:
    """(name, comment, seq, qual) from (line_no, value), four lines a record."""
    record = F.floor(F.col("line_no") / 4)
    part = F.pmod("line_no", F.lit(4))
    rows = lines.groupBy(record.alias("rec")).agg(*(F.max(F.when(part == i, F.col("value"))).alias(f"l{i}") for i in range(4)))
    head = F.substr("l0", F.lit(2))
    return rows.select(short_name(head).alias("name"), F.regexp_extract(head, "^\\S*\\s+(.*)$", 1).alias("comment"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def lines(spark: SparkSession, path: str | list[str], records: int = 4) -> DataFrame:
    """(line_no, value) of text files: lines numbered in their order, those of each file from a multiple of ``records`` on.

    Lines are numbered within the pieces that files are read in; only the number of lines of each piece, a row each, is
    summed over all."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    pieces = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    files = pieces.groupBy("file").agg((F.ceil(F.sum("n") / records) * records).alias("n"))
    upto = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(upto, F.lit(0)).alias("file_at"))
    inside = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.join(files, "file").select("file", "block", (F.col("file_at") + F.coalesce(inside, F.lit(0)) - F.col("lo")).alias("at"))
    return read.join(pieces, ["file", "block"]).select((F.col("id") + F.col("at")).cast("long").alias("line_no"), "value")


def fastq_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``fastq``, from files; a read may be without bases. Empty lines behind the last record are left out."""
    return fastq(lines(spark, path).where((F.col("value") != "") | (F.col("line_no") % 4 != 0)))


def kind(first: Column) -> Column:
    """``fasta``, ``fastq`` or ``empty`` by the first character; anything else is an error."""
    return F.when(first.startswith(">"), "fasta").when(first.startswith("@"), "fastq").when(F.length(first) == 0, "empty").otherwise(F.raise_error(F.lit("neither FASTA nor FASTQ")).cast("string"))


def paf(lines: DataFrame) -> DataFrame:
    """Alignments from (line_no, value): query and target spans, strand and CIGAR (tag cg:Z:, null without one). Lines with
    under 12 fields are skipped; an unknown strand is an error."""
    longs = {"qlen": 1, "qstart": 2, "qend": 3, "tlen": 6, "tstart": 7, "tend": 8, "matches": 9, "alen": 10, "mapq": 11}

    def row(f):
        tag = F.try_element_at(F.filter(F.slice(f, F.lit(13), F.size(f)), lambda t: t.startswith("cg:Z:")), F.lit(1))
        return F.struct(
            f[0].alias("qname"), f[5].alias("tname"), is_inverse(f[4]).alias("is_inverse"),
            *(f[i].cast("long").alias(n) for n, i in longs.items()), F.substr(tag, F.lit(6)).alias("cigar"),
        )

    return _parsed(lines, F.split("value", "\t"), lambda f: F.size(f) >= 12, row)


def _parsed(lines: DataFrame, split: Column, good, row) -> DataFrame:
    """line_no and the columns of ``row`` of the fields of each line whose fields are ``good``. Both are stated within a generator, so that
    a line is made and split once: filters on columns that come of it would be pushed below, and make it anew for each."""
    return lines.select("line_no", F.inline(F.transform(F.filter(F.array(split), good), row)))


def paf_overlaps(rows: DataFrame) -> DataFrame:
    """PAF rows with target as A and query as B, B's span in the orientation of the alignment."""
    b = F.when(F.col("is_inverse"), F.col("qlen") - F.col("qend")).otherwise(F.col("qstart"))
    e = F.when(F.col("is_inverse"), F.col("qlen") - F.col("qstart")).otherwise(F.col("qend"))
    return rows.select("line_no", F.col("tname").alias("aname"), F.col("qname").alias("bname"), "is_inverse", F.col("tstart").alias("abpos"), F.col("tend").alias("aepos"), b.alias("bbpos"), e.alias("bepos"), F.col("tlen").alias("alen"), F.col("qlen").alias("blen"), "cigar")


M4 = ["qname", "tname", "tstrand", "qstrand", "score", "similarity", "tstart", "tend", "tlen", "qstart", "qend", "qlen", "cells"]


def m4(lines: DataFrame) -> DataFrame:
    """Alignments from (line_no, value) of 13 fields; lines that don't parse are skipped. Where the query is reversed both
    spans are mirrored."""
    texts = ("qname", "tname")

    def cell(f, n):
        text = F.try_element_at(f, F.lit(M4.index(n) + 1))
        return text if n in texts else text.try_cast("double" if n == "similarity" else "bigint")

    def good(f):
        return reduce(Column.__and__, (cell(f, n).isNotNull() for n in M4), F.size(f) == 13)

    named = ["qname", "tname", "similarity", *(n for n in M4 if n not in (*texts, "similarity"))]
    good = _parsed(lines, fields(F.col("value")), good, lambda f: F.struct(*(cell(f, n).alias(n) for n in named)))
    flip = F.col("qstrand") == 1
    spans = {}
    for x in "tq":
        b, e, n = F.col(f"{x}start"), F.col(f"{x}end"), F.col(f"{x}len")
        spans |= {f"{x}start": F.when(flip, n - e).otherwise(b), f"{x}end": F.when(flip, n - b).otherwise(e)}
    return good.withColumns(spans)


def sam(lines: DataFrame) -> DataFrame:
    """SAM records from (line_no, value); header lines are left out."""
    names = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string")]
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("@")).withColumn("f", f).where(F.size("f") >= 11).select("line_no", *(F.col("f")[i].cast(t).alias(n) for i, (n, t) in enumerate(names)), F.slice("f", F.lit(12), F.size("f")).alias("tags"))


def sam_text(rows: DataFrame) -> DataFrame:
    """(value): SAM lines of rows with the columns of ``sam``."""
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return rows.select(F.concat_ws("\t", *(F.col(n).cast("string") for n in names), F.array_join("tags", "\t")).alias("value"))


def paf_text(rows: DataFrame) -> Column:
    """A PAF line from the columns of ``paf``."""
    strand = F.when(F.col("is_inverse"), "-").otherwise("+")
    return F.concat_ws("\t", "qname", *(F.col(c).cast("string") for c in ("qlen", "qstart", "qend")), strand, "tname", *(F.col(c).cast("string") for c in ("tlen", "tstart", "tend", "matches", "alen", "mapq")), F.concat(F.lit("cg:Z:"), "cigar"))
