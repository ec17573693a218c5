"""Normalisers: functions of (pixels, new column) that add a column of scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Normaliser = Callable[[DataFrame, str], DataFrame]


def arctan_mean(pixels: DataFrame, column: str) -> DataFrame:
    """arctan(count / mean) scaled to 0..1; the mean is over all pixels that are stored."""
    mean = pixels.agg(F.avg("count").alias("m"))
    return pixels.withColumn(column, F.atan(F.col("count") / mean.scalar()) / (F.pi() / 2))


def log_count(pixels: DataFrame, column: str) -> DataFrame:
    return pixels.withColumn(column, F.ln(F.col("count") + 1))


NORMALISERS: dict[str, Normaliser] = {"arctan_mean": arctan_mean, "log": log_count}
