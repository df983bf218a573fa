"""Exact top-k search over binary codes by incremental multi-index hashing (Norouzi, Punjani and Fleet, 2012)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.plans.store import Scratch

BITS = 64
#: What a pattern costs, in codes that are compared.
PATTERN_COST = 16


def sign_code(v: Column) -> Column:
    """The signs of a vector's first 64 components as a long: bit i is set if component i is over 0, which NaN is and null
    isn't. A null vector has no code."""
    head = F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _cut(m: int) -> list[tuple[int, int]]:
    ends = [round(BITS * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _work(m: int, n: int, k: int) -> tuple[int, float]:
    """Patterns that a query looks up in ``m`` segments of ``n`` codes with independent bits, and codes that it meets there."""
    within = far = 0
    while far < BITS and n * (within := within + math.comb(BITS, far)) < (k + 1) << BITS:
        far += 1
    each = [(sum(math.comb(w, r) for r in range((far - i) // m + 1)), w) for i, (_, w) in enumerate(_cut(m))]
    return sum(p for p, _ in each), sum(p * n / 2**w for p, w in each)


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """First bit and width of the segments. Narrow ones need fewer patterns and meet more codes; a pattern is a row that is
    shuffled and sorted, a code met is compared in its place. So their number isn't the usual one, by which a segment's value
    is shared with few other codes, but the one of least work; it decides what a search costs and never what it finds."""

    def cost(m: int) -> float:
        patterns, met = _work(m, n, k)
        return PATTERN_COST * patterns + met

    return _cut(min(range(2, 17), key=cost))


def _segment(code: Column, a: int, width: int) -> Column:
    return F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(values: DataFrame, radius: int) -> DataFrame:
    """``values`` (with own, width) with ``value`` for each value at distance ``radius`` from ``own``: bits are flipped one
    after another, from the lowest on, so each pattern comes once and is made where its row is."""
    rows = values.withColumns({"value": F.col("own"), "_from": F.lit(0)})
    for _ in range(radius):
        rows = rows.where("_from < width").withColumn("_bit", F.explode(F.sequence(F.col("_from"), F.col("width") - 1)))
        flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
        rows = rows.withColumns({"value": F.col("value").bitwiseXOR(flip), "_from": F.col("_bit") + 1}).drop("_bit")
    return rows.drop("_from")


def top_k(table: DataFrame, queries, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest codes by Hamming distance for each row of ``table`` (id, code:
    long) that the condition ``queries`` on id holds for, other rows only, ties to the smaller id. Exact.

    Equal codes are one entry with their k + 1 smallest ids, cut to that before they are shuffled; queries with one code
    are searched once. In round r each open query looks up, in every segment, the values at distance r from its own. Then
    every code within ``segments * (r + 1) - 1`` has been seen, since a farther one is r + 1 off in each segment at least;
    a query whose k-th distance is within that is done, and leaves. The rounds end when none is open. A code at distance d
    not seen before round r is exactly r off in one of the first ``d - segments * r + 1`` segments, as it would be r + 1 off
    in each of these and r in the others otherwise: segments that only codes beyond the k-th distance need aren't looked up.

    Rows with a null id or code take no part; rows that repeat both are one. With fewer than ``k`` others, all are found.
    """
    scratch = Scratch(table.sparkSession, "codes")
    rows = table.where("id is not null and code is not null").select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).distinct()
    rows = scratch.cut(rows, "rows")
    first = Window.partitionBy("code").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = scratch.cut(entries.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    segments = _segments(n, k)
    asked = rows.where(queries)
    open_ = asked.select(F.col("code").alias("q"), F.lit(BITS).alias("far")).distinct()
    parts = F.array(*(F.struct(F.lit(i).alias("segment"), _segment(F.col("code"), a, w).alias("value")) for i, (a, w) in enumerate(segments)))
    index = scratch.cut(entries.select("code", "ids", F.inline(parts)), "index")
    best, done = None, None
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nearest, each = Window.partitionBy("q").orderBy("distance", "id"), Window.partitionBy("q")
    for r in range(max(w for _, w in segments) + 1):
        # Few bytes make many rows here: as many tasks as a shuffle has, whatever the size of the queries.
        own = [F.struct(F.lit(i).alias("segment"), F.lit(w).alias("width"), _segment(F.col("q"), a, w).alias("own")) for i, (a, w) in enumerate(segments)]
        values = open_.repartition(tasks, "q").select("q", "far", F.inline(F.array(*own)))
        probe = _flipped(values.where(F.col("segment") <= F.col("far") - len(segments) * r), r).select("q", "far", "segment", "value")
        # Spark takes the patterns to be as small as the queries they are made of, and would broadcast them: hence the hint.
        met = probe.join(index.hint("merge"), ["segment", "value"])
        seen = met.withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code")))).where("distance <= far")
        seen = seen.select("q", "distance", F.explode("ids").alias("id"))
        if best is not None:
            seen = seen.unionByName(best.where("open").select("q", "distance", "id"))
        kept = seen.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
        # k others beside the query itself, which is among its own nearest. Farther codes than these can't matter any more.
        far = F.when(F.count("*").over(each) > k, F.max("distance").over(each)).otherwise(BITS)
        bound = len(segments) * (r + 1) - 1
        full = (F.count("*").over(each) > k) & (F.max("distance").over(each) <= bound)
        best = scratch.cut(kept.select("q", "distance", "id", far.alias("far"), (~full).alias("open")), f"best{r}")
        finished = best.where("not open").select("q", "distance", "id")
        done = finished if done is None else done.unionByName(finished)
        open_ = best.where("open").select("q", "far").distinct()
        if not open_.limit(1).count():
            break
    done = done.unionByName(best.where("open").select("q", "distance", "id"))  # with too few codes, every one has been seen
    each = Window.partitionBy("query_id", "q").orderBy("distance", "id")
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(done, "q").where("id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))
