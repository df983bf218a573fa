"""Coverage and repeat thresholds, and batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (factor on genome size, factor on coverage) of the three repeat masking rounds.
REPEAT_ROUNDS = ((1, 1200), (10, 90), (100, 6))


def coverage(reads: DataFrame, genome: int, block_bases: int) -> DataFrame:
    """(bases, coverage, blocks, repeat1, repeat2, repeat3): total bases, times the genome is covered (rounded to the
    nearest), blocks of ``block_bases``, and the thresholds of the three repeat rounds."""
    total = reads.agg(F.coalesce(F.sum("rlen"), F.lit(0)).cast("long").alias("bases"))
    cov = F.floor(F.col("bases") / F.lit(float(genome)) + 0.5).cast("long")
    sized = total.select("bases", cov.alias("coverage"), F.greatest(F.lit(1), F.ceil(F.col("bases") / F.lit(float(block_bases)))).cast("long").alias("blocks"))
    rounds = [F.floor(F.lit(g * 2 * f) * F.col("coverage") / F.col("blocks")).cast("long").alias(f"repeat{i}") for i, (g, f) in enumerate(REPEAT_ROUNDS, 1)]
    return sized.select("*", *rounds)
