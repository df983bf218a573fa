"""Mixing sources to target weights: tempered shares, met by bisection, realised as budgeted block permutations.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.plans.store import Scratch

#: Rows that a block of a source's permutation holds on average.
BLOCK_ROWS = 4096
#: Levels of bisection that one pass over the source table evaluates, and passes.
LEVELS, PASSES = 5, 8


def words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")), F.lit(0)).cast("long")


def who(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the doc_id, or a hash of the text where there is none."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def place(doc: Column, epoch: Column, seed: int) -> Column:
    """Where a document, by ``who``, stands, from 0 to 1, in the permutation of its source that serves an epoch."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").cast("double") / float(1 << 60)


def temper(stats: DataFrame, *, total: int, max_epochs: float | None, entropy: float | None, budget: float) -> float:
    """The exponent from 0 (even weights) to 1 (shares as they are) that meets the target.

    With ``max_epochs``: the smallest exponent at which no source is repeated more often than that. With ``entropy`` (a
    part of the largest possible, 0 to 1): the one that gives the weights that entropy, or the nearest to it. Each pass
    over the table of sources evaluates the 31 middle points of five levels of bisection, so that however many sources
    there are, 31 sums reach the driver.
    """
    p = F.col("tokens") / F.lit(float(total))
    sources = stats.where("tokens > 0")
    if entropy is not None:
        target = entropy * math.log(max(1, sources.count()))
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        points = [lo + (hi - lo) * i / (1 << LEVELS) for i in range(1, 1 << LEVELS)]
        sums: list[Column] = []
        for a in points:
            w = F.pow(p, F.lit(a))
            sums += [F.sum(w), F.sum(w * F.log(w)) if entropy is not None else F.max(w / p)]
        got = sources.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
        flat = []  # whether the weights are still too even at each point
        for i in range(len(points)):
            z, x = got[2 * i], got[2 * i + 1]
            flat.append(math.log(z) - x / z > target if entropy is not None else budget / total * x / z > max_epochs)
        left, right = 0, 1 << LEVELS
        while right - left > 1:
            mid = (left + right) // 2
            left, right = (mid, right) if flat[mid - 1] else (left, mid)
        lo, hi = lo + (hi - lo) * left / (1 << LEVELS), lo + (hi - lo) * right / (1 << LEVELS)
    return hi


def mix(docs: DataFrame, *, max_epochs: float | None = None, entropy: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """``docs`` drawn so that each source has its tempered share of ``budget`` words (default: as many as there are).

    Give one of ``max_epochs`` and ``entropy`` (see ``temper``). A source's quota is its weight times the budget: so many
    whole passes over its documents, and of one more pass, in the order of that pass's permutation, the documents before
    the first that would exceed the quota. The permutation is cut in blocks by place; block sums tell the block in which
    the quota ends, and only that block is sorted. Row groups of any size are thus summed before they are dealt out, and
    the text itself isn't shuffled unless the table of sources is too large to broadcast.

    Columns whose names begin with mix_ are ignored. Adds the columns mix_epoch (from 1; a document taken n times is n rows), mix_weight (of its source) and mix_place (in
    that epoch's permutation). Rows without words cost nothing and are taken once. Null sources form a source of their
    own. Rows that tie in place (one doc_id repeated in a source, or one text without doc_id) are taken or left together.
    """
    if (max_epochs is None) == (entropy is None):
        raise ValueError("give one of max_epochs and entropy")
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("mix_key")
    slim = scratch.cut(docs.select(who(F.col("doc_id"), F.col("text")).alias("doc"), key, words(F.col("text")).alias("n")), "slim")
    stats = scratch.cut(slim.groupBy("mix_key").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "sources")
    total = stats.agg(F.sum("tokens")).first()[0] or 0
    want = float(total if budget is None else budget)
    weight = F.lit(0.0)
    if total:
        if max_epochs is not None and want > max_epochs * total:
            raise ValueError("the budget can't be met within max_epochs")
        a = temper(stats, total=total, max_epochs=max_epochs, entropy=entropy, budget=want)
        w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
        z = stats.agg(F.sum(w)).first()[0]
        weight = w / F.lit(z)
    quota = F.lit(want) * weight
    whole = F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(0)
    plan = stats.select("mix_key", "tokens", "rows", weight.alias("mix_weight"), whole.cast("long").alias("whole"), (quota - whole * F.col("tokens")).alias("rest"))
    plan = scratch.cut(plan, "plan")

    u = place(F.col("doc"), F.col("whole") + 1, seed)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS))
    placed = slim.where("n > 0").join(plan, "mix_key").select("mix_key", "n", "rest", u.alias("u"), blocks.alias("blocks"))
    placed = placed.withColumn("block", F.floor(F.col("u") * F.col("blocks")))
    upto = Window.partitionBy("mix_key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("mix_key", "block", "rest").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    cut = sums.where("upto > rest").groupBy("mix_key").agg(F.min_by(F.struct("block", (F.col("upto") - F.col("n")).alias("before")), "block").alias("at"))
    cut = scratch.cut(cut.select("mix_key", F.col("at.block").alias("block"), F.col("at.before").alias("before")), "cut")
    run = Window.partitionBy("mix_key").orderBy("u").rangeBetween(Window.unboundedPreceding, 0)
    last = placed.join(cut, ["mix_key", "block"]).withColumn("upto", F.col("before") + F.sum("n").over(run))
    # All places below the first one that would exceed the quota are taken.
    ends = last.where("upto > rest").groupBy("mix_key").agg(F.min("u").alias("end"))
    plan = scratch.cut(plan.join(ends, "mix_key", "left").select("mix_key", "mix_weight", "whole", F.coalesce("end", F.lit(2.0)).alias("end")), "ends")

    names = [c for c in docs.columns if not c.startswith("mix_")]
    full = docs.select(*names, key, words(F.col("text")).alias("mix_n")).join(plan.toDF("mix_key", "mix_weight", "mix_whole", "mix_end"), "mix_key")
    doc = who(F.col("doc_id"), F.col("text"))
    more = (place(doc, F.col("mix_whole") + 1, seed) < F.col("mix_end")).cast("long")
    copies = F.when(F.col("mix_n") > 0, F.col("mix_whole") + more).otherwise(1)
    full = full.withColumn("mix_copies", copies).where("mix_copies > 0")
    full = full.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return full.select(*names, "mix_epoch", "mix_weight", place(doc, F.col("mix_epoch"), seed).alias("mix_place"))
