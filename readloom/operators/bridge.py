"""Bridging of tandem intervals: overlaps that end in an interval from both sides are joined by an alignment across it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.functions import edits
from readloom.operators import joins, kernels, transform
from readloom.operators.joins import BRIDGED
from readloom.plans.store import Scratch
from readloom.schema import TRACE

SPAN = kernels.SPAN


def _across(spans: DataFrame, reads: DataFrame, ts: int, max_window: float) -> DataFrame:
    """Spans aligned from end to end, where no 500 operations hold a larger share of errors than ``max_window``: with diffs, trace,
    and the twin's trace, which is the same script cut in B's tiles."""
    full = kernels.parts(joins.with_sequences(joins.with_lengths(spans, reads), reads))
    begin = F.when(F.col("is_inverse"), F.col("blen") - F.col("bepos")).otherwise(F.col("bbpos"))

    def make(a, b, ab, begin, inverse):
        runs = edits.align(a, b)
        twin = edits.tiles(edits.turned(runs, inverse), begin, ts)
        return edits.errors(runs), edits.tiles(runs, ab, ts), twin, edits.window_error(runs)

    fields = [T.StructField("diffs", T.LongType()), T.StructField("trace", TRACE), T.StructField("twin", TRACE), T.StructField("window", T.DoubleType())]
    found = kernels.each_row(full.withColumn("_begin", begin), [*SPAN, "alen", "blen"], fields, ["aseq", "bseq", "abpos", "_begin", "is_inverse"], make)
    return found.where(F.col("window") <= max_window).drop("window")


def bridge(ovl: DataFrame, masks: DataFrame, reads: DataFrame, border: int = 500, max_indel: float = 0.3, max_window: float = 0.4, ts: int = 100, rounds: int = 100) -> DataFrame:
    """The new rows (SPAN, alen, blen, diffs, trace) that bridge the intervals of ``masks`` (read_id, ifrom, ito), and their twins
    seen from B (``reads``: read_id, rlen, seq).

    Where no overlap of a group (aread, bread, is_inverse) spans an interval with ``border`` on both sides, each pair of anchors
    (``joins.bridge_pairs``) is aligned from the left one's begin to the right one's end; so a new row spans its interval.
    It may anchor another one, so rounds go on until none is new; each joins only new anchors with all others, and drops
    intervals that are spanned now. Twins belong to another group and take no part. An error if rows are still new
    after ``rounds`` rounds.
    """
    scratch = Scratch(ovl.sparkSession, "bridge")
    fresh = joins.bridge_roles(ovl.select(*SPAN).distinct(), masks, [], border).withColumn("fresh", F.lit(True))
    held, out = None, None
    for k in range(rounds):
        every = fresh if held is None else held.withColumn("fresh", F.lit(False)).unionByName(fresh)
        every = scratch.cut(every, f"roles{k}")
        spanned = every.where("role = 'span'").select(*BRIDGED).distinct()
        held = scratch.cut(every.where("role <> 'span'").join(spanned, BRIDGED, "left_anti"), f"open{k}")
        left, right = held.where("role = 'left'"), held.where("role = 'right'")
        pairs = joins.bridge_pairs(left.where("fresh"), right, [], max_indel)
        if k:
            pairs = pairs.unionByName(joins.bridge_pairs(left.where("not fresh"), right.where("fresh"), [], max_indel))
        ends = {"abpos": "abegin", "aepos": "aend", "bbpos": "bbegin", "bepos": "bend"}
        spans = pairs.select("aread", "bread", "is_inverse", *(F.col(old).alias(new) for new, old in ends.items())).distinct()
        new = scratch.cut(_across(spans, reads, ts, max_window), f"new{k}")
        scratch.drop(f"roles{k}", *([f"open{k - 1}"] if k else []))
        out = new if out is None else out.unionByName(new)
        if new.isEmpty():
            break
        fresh = joins.bridge_roles(new, masks, [], border).withColumn("fresh", F.lit(True))
    else:
        raise RuntimeError(f"bridging did not settle in {rounds} rounds")
    out = out.dropDuplicates(SPAN)
    names = [*SPAN, "alen", "blen", "diffs", "trace"]
    twins = transform.swapped(out.drop("trace")).withColumnRenamed("twin", "trace")
    return out.select(*names).unionByName(twins.select(*names))
