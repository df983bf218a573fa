"""CIGAR strings by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(cigar: Column) -> Column:
    """[(n, op)] of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^[0-9]+", 0).cast("long").alias("n"), F.right(p, F.lit(1)).alias("op")))


def length(cigar: Column, ops: str) -> Column:
    """Total length of the runs of some operations."""
    return F.aggregate(F.filter(runs(cigar), lambda r: r["op"].isin(*ops)), F.lit(0).cast("long"), lambda s, r: s + r["n"])


def lengths(cigar: Column) -> dict[str, Column]:
    """Reference and read length, clips at both ends, and the deletion before the first base of the read."""
    front = F.regexp_extract(cigar, "^((?:[0-9]+[SH])*)", 1)
    back = F.regexp_extract(cigar, "((?:[0-9]+[SH])*)$", 1)
    gap = F.regexp_extract(cigar, "^(?:[0-9]+[SH])*((?:[0-9]+D)*)", 1)
    return {
        "ref_length": length(cigar, "M=XDN"),
        "read_length": length(cigar, "M=XIS"),
        "front_clip": length(front, "SH"),
        "back_clip": length(back, "SH"),
        "front_del": length(gap, "D"),
        "errors": length(cigar, "XID"),
    }


def ref_position(cigar: Column, pos: Column, at: Column) -> Column:
    """The reference position of base ``at`` of a read, clipped bases counted, whose first aligned base lies at ``pos``. An
    inserted base has that of the next aligned one; a clipped base, or none of the read, has none."""
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.lit(None).cast("long").alias("hit"))

    def step(s, r):
        on_ref, on_read = r["op"].isin("M", "=", "X", "D", "N"), r["op"].isin("M", "=", "X", "I", "S", "H")
        inside = s["hit"].isNull() & on_read & (at >= s["read"]) & (at < s["read"] + r["n"])
        hit = F.when(inside & on_ref, s["ref"] + at - s["read"]).when(inside & (r["op"] == "I"), s["ref"]).otherwise(s["hit"])
        ref, read = F.when(on_ref, s["ref"] + r["n"]).otherwise(s["ref"]), F.when(on_read, s["read"] + r["n"]).otherwise(s["read"])
        return F.struct(ref.alias("ref"), read.alias("read"), hit.alias("hit"))

    return F.aggregate(runs(cigar), start, step, lambda s: s["hit"])


def shifted(cigar: Column, pos: Column) -> dict[str, Column]:
    """A CIGAR string without the deletions before its first aligned base, and the position behind them."""
    front = F.regexp_extract(cigar, "^(?:[0-9]+[SH])*((?:[0-9]+D)*)", 1)
    return {"cigar": F.regexp_replace(cigar, "^((?:[0-9]+[SH])*)(?:[0-9]+D)*", "$1"), "pos": pos + length(front, "D")}
