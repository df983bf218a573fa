"""Row filters: all of them narrow and pushed to the scan where they only read stored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.trace import error_rate, fits


def length_error(ovl: DataFrame, min_length: int = 1000, max_error: float = float("inf")) -> DataFrame:
    """A span of ``min_length`` or more and an error rate of at most ``max_error``; the rate is ``diffs`` over the A span
    where there is no trace."""
    trace = F.col("trace") if "trace" in ovl.columns else F.lit(None).cast("array<struct<err:int,blen:int>>")
    rate = error_rate(trace, F.col("diffs"), F.col("abpos"), F.col("aepos"))
    return ovl.where((F.col("aepos") - F.col("abpos") >= min_length) & (rate <= max_error))


def by_ids(ovl: DataFrame, aread: int, bread: int | None = None) -> DataFrame:
    kept = ovl.where(F.col("aread") == aread)
    return kept if bread is None else kept.where(F.col("bread") == bread)


def parse_points(tokens: list[str]) -> tuple[list[tuple[int, int, int | None]], list[str]]:
    """(position, aread, bread or None) of each ``a`` or ``a,b``; and the tokens that are neither."""
    good, bad = [], []
    for i, token in enumerate(tokens):
        parts = token.split(",")
        if len(parts) in (1, 2) and all(p.isdecimal() for p in parts):
            good.append((i, int(parts[0]), int(parts[1]) if len(parts) == 2 else None))
        else:
            bad.append(token)
    return good, bad


def by_points(ovl: DataFrame, tokens: list[str]) -> DataFrame:
    """The rows of each listed id or pair, with ``pos``, the place in the list; a token listed twice gives its rows twice,
    and invalid tokens are skipped. The list is a parameter, so it is small enough to broadcast."""
    points = ovl.sparkSession.createDataFrame(parse_points(tokens)[0], "pos long, p_a long, p_b long")
    joined = ovl.join(F.broadcast(points), (F.col("aread") == F.col("p_a")) & (F.col("p_b").isNull() | (F.col("bread") == F.col("p_b"))))
    return joined.drop("p_a", "p_b")


def overlap_class() -> Column:
    """How an overlap is proper, or null: a read covered, or a suffix of one that is a prefix of the other."""
    c = F.col
    return (
        F.when((c("abpos") == 0) & (c("aepos") == c("alen")), "a_contained")
        .when((c("bbpos") == 0) & (c("bepos") == c("blen")), "b_contained")
        .when((c("aepos") == c("alen")) & (c("bbpos") == 0), "a_suffix")
        .when((c("bepos") == c("blen")) & (c("abpos") == 0), "b_suffix")
    )


def proper(ovl: DataFrame) -> DataFrame:
    """Overlaps (with alen, blen) that can't be extended at both ends, with their class."""
    return ovl.withColumn("class", overlap_class()).where(F.col("class").isNotNull())


def containment_flags(ovl: DataFrame, high: float = 0.45) -> DataFrame:
    trace = F.col("trace") if "trace" in ovl.columns else F.lit(None).cast("array<struct<err:int,blen:int>>")
    rate = error_rate(trace, F.col("diffs"), F.col("abpos"), F.col("aepos"))
    flags = {"contained_a": (F.col("abpos") == 0) & (F.col("aepos") == F.col("alen")), "contained_b": (F.col("bbpos") == 0) & (F.col("bepos") == F.col("blen"))}
    return ovl.withColumns({**flags, "high_error": rate >= high})


def small_trace(ovl: DataFrame, most: int = 255) -> DataFrame:
    return ovl.where(fits(F.col("trace"), most))


def not_empty(ovl: DataFrame) -> DataFrame:
    return ovl.where("aepos > abpos")


def self_forward(ovl: DataFrame) -> DataFrame:
    return ovl.where("aread = bread AND NOT is_inverse")


def mapped(sam: DataFrame) -> DataFrame:
    return sam.where(F.col("flag").bitwiseAND(F.lit(4)) == 0)


def cigar_valid(cigar: Column, allow_m: bool = False) -> Column:
    """Whether a CIGAR string holds only I, D, =, X, S, H, and M if ``allow_m``."""
    return cigar.rlike(f"^([0-9]+[IDX=SH{'M' if allow_m else ''}])+$")


def read_range(reads: DataFrame, spec: str | None = None) -> DataFrame:
    """``a-b`` keeps read_id in [a, b), ``a`` one read, None all."""
    if spec is None:
        return reads
    lo, _, hi = spec.partition("-")
    if not lo.isdecimal() or (hi and not hi.isdecimal()):
        raise ValueError(f"not a read range: {spec!r}")
    return reads.where((F.col("read_id") >= int(lo)) & (F.col("read_id") < (int(hi) if hi else int(lo) + 1)))


def trimmed(reads: DataFrame, cutoff: int) -> DataFrame:
    """Reads of ``cutoff`` bases or more, numbered anew from 0; the old id is kept."""
    from readloom.operators.renumber import dense

    return dense(reads.where(F.col("rlen") >= cutoff).withColumnRenamed("read_id", "untrimmed_id"), "untrimmed_id", "read_id")
