"""Checks of overlap tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.trace import b_length
from readloom.operators.filters import cigar_valid
from readloom.operators.joins import asymmetric
from readloom.operators.order import order_keys, with_before


def structural(ovl: DataFrame) -> DataFrame:
    """``ovl`` (with alen, blen) and a flag for each rule: spans within their reads, and the trace's B length, if there is
    a trace, that of the B span."""
    flags = {"a_ok": (F.col("abpos") >= 0) & (F.col("aepos") <= F.col("alen")), "b_ok": (F.col("bbpos") >= 0) & (F.col("bepos") <= F.col("blen"))}
    if "trace" in ovl.columns:
        flags["trace_ok"] = b_length(F.col("trace")) == F.col("bepos") - F.col("bbpos")
    return ovl.withColumns(flags)


def verdict(ovl: DataFrame, src: str) -> DataFrame:
    """(src, rows, ok): whether all rows of each input pass."""
    flags = structural(ovl)
    good = F.col("a_ok") & F.col("b_ok") & (F.col("trace_ok") if "trace_ok" in flags.columns else F.lit(True))
    return flags.groupBy(src).agg(F.count("*").alias("rows"), F.bool_and(good).alias("ok"))


def sorted_verdict(ovl: DataFrame, order: str, by: str, src: str, tie: list[str], bucket: Column | None = None) -> DataFrame:
    """(src, unsorted): how many rows of each input are out of order. ``bucket`` as for ``order.unsorted``; without it all rows of an
    input are sorted in one task."""
    rows = ovl.select(src, F.col(by).alias("_by"), F.struct(*order_keys(order, tie)).alias("_key"), *([] if bucket is None else [bucket.alias("_at")]))
    marked = with_before(rows, "_key", ["_by"], [src], None if bucket is None else F.col("_at"))
    return marked.groupBy(src).agg(F.count_if(F.col("_before") > F.col("_key")).alias("unsorted"))


def symmetry(ovl: DataFrame) -> DataFrame:
    """(rows, missing, ok): overlaps without their twin."""
    missing = asymmetric(ovl).agg(F.count("*").alias("missing"))
    return ovl.agg(F.count("*").alias("rows")).crossJoin(missing).withColumn("ok", F.col("missing") == 0)


def indeterminate(reads: DataFrame) -> DataFrame:
    """(read_id, n_bad, first_bad) of the reads (read_id, seq) that hold characters other than bases of either case: how many, and
    the place of the first. Mapping output takes no such reads."""
    bad = {"n_bad": F.length(F.regexp_replace("seq", "[ACGTacgt]", "")), "first_bad": F.length(F.regexp_extract("seq", "^[ACGTacgt]*", 0))}
    return reads.select("read_id", *(c.cast("long").alias(k) for k, c in bad.items())).where("n_bad > 0")


def cigar_alphabet(records: DataFrame) -> DataFrame:
    """``records`` with what their column ``cigar`` holds: is_strict, only I, D, =, X and clips; is_resolvable, M as well, which
    the bases tell apart; and other, its distinct operations beyond these. A string that isn't a CIGAR string is neither."""
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all("cigar", F.lit("[0-9]([^0-9])"), F.lit(1))))
    other = F.array_join(F.filter(letters, lambda c: ~c.isin(*"IDX=SHM")), "")
    return records.withColumns({"is_strict": cigar_valid(F.col("cigar")), "is_resolvable": cigar_valid(F.col("cigar"), allow_m=True), "other": other})
