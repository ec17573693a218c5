"""Interval overlap of bins and annotations as an equality join on tiles.

Bins have one size and start at its multiples, so a bin is one tile; an interval is spread over the tiles that it
touches. Chromosome and tile are the key, no range condition is left, and no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def overlap_join(bins: DataFrame, intervals: DataFrame, bin_size: int, how: str = "inner") -> DataFrame:
    """bins with the intervals that overlap them (half-open) and bp, the length of the overlap.

    intervals: chrom, start, end and any further columns, which must differ from those of bins. Empty intervals and
    null bounds meet nothing. how: inner or left.
    """
    extra = [c for c in intervals.columns if c not in ("chrom", "start", "end")]
    spread = intervals.where("end > start").select(
        F.col("chrom").alias("__chrom"), F.col("start").alias("__start"), F.col("end").alias("__end"), *extra, F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("__tile")
    )
    tiled = bins.withColumn("__tile", F.floor(F.col("start") / bin_size))
    met = tiled.join(spread, (F.col("chrom") == F.col("__chrom")) & (tiled["__tile"] == spread["__tile"]), how)
    bp = F.least("end", "__end") - F.greatest("start", "__start")
    return met.select(*bins.columns, *extra, F.when(F.col("__start").isNotNull(), bp).cast("long").alias("bp"), F.col("__start").alias("interval_start"), F.col("__end").alias("interval_end"))
