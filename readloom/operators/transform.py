"""Swapping of roles, union, symmetric closure and text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.scalar import mirror
from readloom.functions.trace import error_sum


def swapped(ovl: DataFrame) -> DataFrame:
    """Each overlap seen from B (needs alen and blen; other columns stay, a trace is dropped as it belongs to A's tiles)."""
    ab, ae = mirror(F.col("bbpos"), F.col("bepos"), F.col("blen"), F.col("is_inverse"))
    bb, be = mirror(F.col("abpos"), F.col("aepos"), F.col("alen"), F.col("is_inverse"))
    new = {"aread": F.col("bread"), "bread": F.col("aread"), "abpos": ab, "aepos": ae, "bbpos": bb, "bepos": be, "alen": F.col("blen"), "blen": F.col("alen")}
    return ovl.select(*(new.get(c, F.col(c)).alias(c) for c in ovl.columns if c != "trace"))


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of tables that share one trace spacing; a spacing in the metadata of ``trace`` must agree."""
    spacing = {t.schema["trace"].metadata.get("tspace") for t in tables if "trace" in t.columns} - {None}
    if len(spacing) > 1:
        raise ValueError(f"trace spacings differ: {sorted(spacing)}")
    return reduce(DataFrame.unionByName, tables)


def symmetric_closure(ovl: DataFrame) -> DataFrame:
    """Each overlap and its twin."""
    plain = ovl.drop("trace")
    return plain.unionByName(swapped(plain))


def report(ovl: DataFrame) -> DataFrame:
    """``ovl`` (with alen, blen, trace) and ``line``: spans, strand, lengths, differences, error sum and rate."""
    errors = error_sum(F.col("trace"))
    rate = F.round(errors / (F.col("aepos") - F.col("abpos")), 6)
    parts = [
        F.col("aread"), F.col("bread"), F.when(F.col("is_inverse"), "c").otherwise("n"),
        F.concat(F.lit("["), F.col("abpos"), F.lit(","), F.col("aepos"), F.lit(")/"), F.col("alen")),
        F.concat(F.lit("["), F.col("bbpos"), F.lit(","), F.col("bepos"), F.lit(")/"), F.col("blen")),
        F.concat(F.lit("diffs="), F.col("diffs")), F.concat(F.lit("errors="), errors),
    ]
    return ovl.withColumns({"line": F.concat_ws(" ", *(p.cast("string") for p in parts)), "error_rate": rate})
