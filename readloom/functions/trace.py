"""Functions over traces: per tile of the A read, its error count and its length on B."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_sum(trace: Column) -> Column:
    return F.aggregate(trace, F.lit(0).cast("long"), lambda s, t: s + t["err"])


def b_length(trace: Column) -> Column:
    return F.aggregate(trace, F.lit(0).cast("long"), lambda s, t: s + t["blen"])


def error_rate(trace: Column, diffs: Column, abpos: Column, aepos: Column) -> Column:
    """Errors a base of the A span: of the trace, or ``diffs`` without one."""
    return F.when(aepos > abpos, F.coalesce(error_sum(trace), diffs).cast("double") / (aepos - abpos)).otherwise(F.lit(0.0))


def first_tile(abpos: Column, ts: int) -> Column:
    return F.floor(abpos / ts).cast("long")


def last_tile(aepos: Column, ts: int) -> Column:
    return F.floor((aepos - 1) / ts).cast("long")


def tile_borders(abpos: Column, aepos: Column, ts: int) -> Column:
    """[(t, tb, te)]: the tiles that a span is cut in, at multiples of ``ts``."""
    tiles = F.sequence(first_tile(abpos, ts), last_tile(aepos, ts))
    cut = F.transform(tiles, lambda t: F.struct(t.alias("t"), F.greatest(abpos, t * ts).alias("tb"), F.least(aepos, (t + 1) * ts).alias("te")))
    return F.when(aepos > abpos, cut).otherwise(F.array().cast("array<struct<t:bigint,tb:bigint,te:bigint>>"))


def points(abpos: Column, aepos: Column, bbpos: Column, trace: Column, ts: int) -> Column:
    """[(apos, bpos)]: the inner tile borders on A, and where they fall on B."""
    n, none = F.size(trace), F.array().cast("array<struct<apos:bigint,bpos:bigint>>")
    start = F.struct(bbpos.cast("long").alias("at"), none.alias("out"))

    def step(s, t):
        at = s["at"] + t["blen"]
        point = F.struct(((first_tile(abpos, ts) + F.size(s["out"]) + 1) * ts).cast("long").alias("apos"), at.alias("bpos"))
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(point)).alias("out"))

    return F.when(n > 1, F.aggregate(F.slice(trace, F.lit(1), n - 1), start, step, lambda s: s["out"])).otherwise(none)


def fits(trace: Column, most: int) -> Column:
    """Whether every error count and length fits a cell that holds ``most``."""
    return F.forall(trace, lambda t: (t["err"] <= most) & (t["blen"] <= most))


def aligned(abpos: Column, aepos: Column, bbpos: Column, bepos: Column, trace: Column, ts: int) -> dict[str, Column]:
    """The overlap shrunk to tile borders at both ends; the span is empty if none are left."""
    begin = F.ceil(abpos / ts).cast("long") * ts
    end = F.floor(aepos / ts).cast("long") * ts
    head = F.when(abpos % ts != 0, 1).otherwise(0)
    tail = F.when(aepos % ts != 0, 1).otherwise(0)
    n = F.size(trace)
    kept = F.slice(trace, head + 1, F.greatest(n - head - tail, F.lit(0)))
    some = end > begin
    front = F.when(head == 1, trace[0]["blen"]).otherwise(0)
    back = F.when(tail == 1, F.element_at(trace, -1)["blen"]).otherwise(0)
    return {
        "abpos": F.when(some, begin).otherwise(abpos),
        "aepos": F.when(some, end).otherwise(abpos),
        "bbpos": F.when(some, bbpos + front).otherwise(bbpos),
        "bepos": F.when(some, bepos - back).otherwise(bbpos),
        "trace": F.when(some, kept).otherwise(F.slice(trace, 1, 0)),
    }
