"""Joins and sorts whose sizes Spark misjudges, or that would hold more than they need."""

import random
import sys

from pyspark.sql import functions as F

from readloom.functions import edits
from readloom.operators import checks, convert, dedup, intervals, joins, kernels, trace
from readloom.sources import text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TRACE = "array<struct<err:int,blen:int>>"


def overlaps(spark, rows):
    return spark.createDataFrame(rows, f"aread long, bread long, is_inverse boolean, abpos long, aepos long, bbpos long, bepos long, diffs long, src_id long, trace {TRACE}")


def test_good_intervals_are_not_broadcast(spark):
    """Spark takes the runs of all reads, which come from an explosion, to be as small as the reads."""
    ovl = overlaps(spark, [(1, 2, False, 0, 300, 10, 310, 3, 0, [(1, 100)] * 3)])
    quals = spark.range(1000).select(F.col("id").alias("read_id"), F.array(*(F.lit(q) for q in (1, 1, 40))).alias("q"))
    found = trace.quality_clip(ovl, intervals.quality_runs(quals), 100)
    assert "Broadcast" not in plan(found)
    assert [(r.abpos, r.aepos, r.bbpos, r.bepos, len(r.trace)) for r in found.collect()] == [(0, 200, 10, 210, 2)]


def test_seeds_of_a_diagonal_are_skipped_at_once():
    """Seeds that lie on an alignment aren't looked at one by one, and fronts of an extension are no arrays of many steps each."""
    a = "".join(random.Random(3).choices("ACGT", k=20_000))
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    sys.settrace(count)
    try:
        (found,) = kernels.pair_alignments(a, a, False, 14, 1000, 100)
    finally:
        sys.settrace(None)
    assert found[:5] == (0, 20_000, 0, 20_000, 0) and lines < 20_000


def test_lines_are_split_once(spark):
    """Filters on fields, which joins add too, don't split a line anew."""
    lines = spark.createDataFrame([(1, "q/1 t 0 1 -5 99.5 10 20 100 5 15 90 7"), (2, "q t 0 0 -5 x 1 2 3 4 5 6 7"), (3, "q t")], "line_no long, value string")
    found = text.m4(lines)
    assert [tuple(r) for r in found.collect()] == [(1, "q/1", "t", 99.5, 0, 1, -5, 80, 90, 100, 75, 85, 90, 7)]
    assert found.where("qname <> tname")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert text.paf(lines).where("cigar is null and qlen > 3 and qname <> tname")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_traces_of_rows_with_and_without_cigar_in_one_pass(spark):
    """Rows meet their sequences once, whether or not they have a CIGAR string."""
    reads = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGTCGTAC")], "read_id long, seq string")
    spans = "aread long, bread long, is_inverse boolean, abpos long, aepos long, bbpos long, bepos long, cigar string"
    rows = spark.createDataFrame([(1, 2, False, 0, 10, 0, 9, "4=1D5M"), (1, 2, False, 0, 10, 0, 9, None)], spans)
    found = convert.traced(rows, reads, reads, ["aread"])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r.diffs, r.trace[0].blen) for r in found.collect()] == [(1, 9)] * 2


def test_mismatches_alone_where_they_are_as_few():
    """An indel each way that saves mismatches by a period, but no error, is no better."""
    a = ("TA" * 300)[:600]
    b = "".join({"A": "T", "T": "A"}[c] if i % 100 == 50 else c for i, c in enumerate(a))
    want = [(50, "="), *[(1, "X"), (99, "=")] * 5, (1, "X"), (49, "=")]
    assert edits.align(a, b) == want
    c = "A" * 130 + "ATT" * 157  # an extension from a seed, as of an anchor
    d = "".join({"A": "T", "T": "A"}[x] if i % 100 == 50 else x for i, x in enumerate(c))
    ab, ae, bb, be, runs = kernels.through(c, d, 360, 360)
    assert ab == bb == 0 and ae == be and all(op in "=X" for _, op in runs)


def test_order_of_an_input_is_checked_by_buckets(spark):
    """The rows of an input aren't sorted in one task."""
    rows = [(a, 1, False, 0, 300, 10, 310, 3, i, None) for i, a in enumerate([1, 2, 5, 4, 9, 3, 3, 1, 8, 9])]
    ovl = overlaps(spark, rows).withColumn("src", F.col("src_id") % 2)
    found = checks.sorted_verdict(ovl, "canonical", "src_id", "src", [], bucket=F.floor(F.col("src_id") / 4))
    assert {r.src: r.unsorted for r in found.collect()} == {0: 1, 1: 2}
    p = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in p and p.count("LogicalRDD") == 2  # the last rows of buckets, and all rows


def contained(spark):
    rows = [(1, 2, False, b, e, b + 5, e + 5, 3, i, [(1, t) for t in ts]) for i, (b, e, ts) in enumerate([(0, 400, [100] * 4), (100, 300, [100] * 2), (0, 400, [100] * 4), (0, 300, [90, 110, 100]), (200, 500, [100] * 3), (900, 1000, [100])])]
    return overlaps(spark, [*rows, rows[2], (3, *rows[1][1:])])


def test_contained_rows_are_found_without_pairs(spark):
    """At a point rows are sorted, and not compared with one another; points that no two rows share aren't shuffled with their rows."""
    found = dedup.contained_kills(contained(spark), ["src_id"], 100)
    assert sorted((r.aread, r.src_id) for r in found.collect()) == [(1, 1), (1, 2), (1, 3)]
    joins_ = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins_) == 1 and "LeftSemi" in joins_[0]


def test_rows_that_share_no_point_are_left_out(spark):
    """Points of all rows are shuffled as hashes; whole rows only of those that may share one."""
    near = joins.maybe_sharing(contained(spark), ["aread", "src_id"], 100)
    assert "hashpartitioning(_point" in plan(near)
    assert sorted((r.aread, r.src_id) for r in near.collect()) == [(1, 0), (1, 1), (1, 2), (1, 2), (1, 3), (1, 4)]
