"""Expected counts by distance, and observed over expected."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .strategies import balance_pixels, small

#: Distances below EXACT are smoothed one by one, the others in CELLS parts of the kernel's width.
EXACT, CELLS = 1024, 50
_EXPECTED = "chrom1 string, chrom2 string, dist long, expected double"


def _smoothed(total: np.ndarray, pairs: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Both under a Gaussian kernel of this width in log10 of distance, without distances 0 and 1.

    Distances from EXACT on are gathered in cells of width / CELLS in log10, and their values lie on lines between those of
    cells; so the work follows the logarithm of a chromosome's length.
    """
    position = np.log10(np.arange(len(total)) + 1.0)
    cell = np.arange(len(total))
    far = cell >= EXACT
    cell[far] = EXACT + np.unique(np.floor((position[far] - np.log10(EXACT + 1)) * CELLS / width), return_inverse=True)[1]
    total, pairs = total.copy(), pairs.copy()
    total[:2] = pairs[:2] = 0
    sums, numbers, at = np.bincount(cell, total), np.bincount(cell, pairs), np.bincount(cell, position) / np.bincount(cell)
    nodes = np.unique(np.append(at, position[-1:]))  # lines reach to the last distance
    out = np.zeros((2, len(nodes)))
    for lo in range(0, len(nodes), 1024):
        kernel = np.exp(-0.5 * ((nodes[lo : lo + 1024, None] - at[None, :]) / width) ** 2)
        out[:, lo : lo + 1024] = kernel @ sums, kernel @ numbers
    return np.interp(position, nodes, out[0]), np.interp(position, nodes, out[1])


def _valid_pairs(rows, smooth: float | None):
    """Of one chromosome: balanced sums by distance and its bins -> expected by distance. Pairs of unmasked bins are counted
    by autocorrelation.
    """
    import pandas as pd

    mask, sums = rows[rows["kind"] == 0].sort_values("at"), rows[rows["kind"] == 1]
    n, low = len(mask), int(mask["at"].min()) if len(mask) else 0
    valid = np.zeros(n)
    valid[mask["at"].to_numpy() - low] = mask["value"].to_numpy()
    size = 1 << max(1, 2 * n - 1).bit_length()
    spectrum = np.fft.rfft(valid, size)
    pairs = np.rint(np.fft.irfft(spectrum * np.conj(spectrum), size)[:n])
    total = np.zeros(n)
    total[sums["at"].to_numpy()] = sums["value"].to_numpy()
    if smooth:
        total, pairs = _smoothed(total, pairs, smooth)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = np.where(pairs > 0, total / pairs, np.nan)
    out = pd.DataFrame({"chrom1": rows["chrom"].iloc[0], "chrom2": rows["chrom"].iloc[0], "dist": np.arange(n), "expected": expected})
    out["expected"] = out["expected"].astype(object).where(out["dist"].ge(2) & out["expected"].notna(), None)
    return out


def cis_expected(bins: DataFrame, pixels: DataFrame, smooth: float | None = None) -> DataFrame:
    """Per chromosome and distance the mean balanced count of pairs of unmasked bins; null for distances 0 and 1, and
    where no pair is valid. smooth: width of a Gaussian kernel in log10 of distance.
    """
    balanced = balance_pixels(pixels.select("bin1_id", "bin2_id", "count"), bins_df=bins)
    chroms = small(bins.select("bin_id", "chrom"))
    sides = [chroms.select(F.col("bin_id").alias(f"bin{s}_id"), F.col("chrom").alias(f"c{s}")) for s in (1, 2)]
    cis = balanced.join(sides[0], "bin1_id").join(sides[1], "bin2_id").where("c1 = c2")
    sums = cis.groupBy(F.col("c1").alias("chrom"), (F.col("bin2_id") - F.col("bin1_id")).alias("at")).agg(F.sum("count").alias("value")).withColumn("kind", F.lit(1))
    mask = bins.select("chrom", F.col("bin_id").alias("at"), F.col("weight").isNotNull().cast("double").alias("value"), F.lit(0).alias("kind"))
    return mask.unionByName(sums.select(*mask.columns)).groupBy("chrom").applyInPandas(partial(_valid_pairs, smooth=smooth), _EXPECTED)


def trans_expected(bins: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per pair of chromosomes, in bin order, the mean balanced count; dist is -1."""
    order = bins.groupBy("chrom").agg(F.min("bin_id").alias("first"), F.count("weight").alias("valid"))
    pairs = order.select(F.col("chrom").alias("chrom1"), F.col("first").alias("f1"), F.col("valid").alias("v1")).join(order.select(F.col("chrom").alias("chrom2"), F.col("first").alias("f2"), F.col("valid").alias("v2")), F.expr("f1 < f2"))
    balanced = balance_pixels(pixels.select("bin1_id", "bin2_id", "count"), bins_df=bins)
    chroms = small(bins.select("bin_id", "chrom"))
    named = balanced.join(chroms.select(F.col("bin_id").alias("bin1_id"), F.col("chrom").alias("chrom1")), "bin1_id").join(chroms.select(F.col("bin_id").alias("bin2_id"), F.col("chrom").alias("chrom2")), "bin2_id")
    sums = named.where("chrom1 <> chrom2").groupBy("chrom1", "chrom2").agg(F.sum("count").alias("total"))
    possible = F.col("v1") * F.col("v2")
    return pairs.join(sums, ["chrom1", "chrom2"], "left").select("chrom1", "chrom2", F.lit(-1).cast("long").alias("dist"), F.when(possible > 0, F.coalesce("total", F.lit(0.0)) / possible).alias("expected"))


def get_expected_counts(bins: DataFrame, pixels: DataFrame, smooth: float | None = 0.1) -> DataFrame:
    return cis_expected(bins, pixels, smooth).unionByName(trans_expected(bins, pixels))


def expected_normalized_pixels(pixels: DataFrame, expected: DataFrame, drop_nan: bool = False) -> DataFrame:
    """pixels (with chrom1, chrom2) with count over expected; pixels without an expected count, or of count 0 or null, go.
    Where 0 is expected the result is infinite.
    """
    dist = F.when(F.col("chrom1") == F.col("chrom2"), F.col("bin2_id") - F.col("bin1_id")).otherwise(-1).cast("long")
    ratio = F.when(F.col("expected") == 0, F.when(F.col("count") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("count") / F.col("expected"))
    out = pixels.withColumn("dist", dist).join(expected, ["chrom1", "chrom2", "dist"]).withColumn("count", ratio).select(*pixels.columns).where("count <> 0")
    return out.where(~F.isnan("count")) if drop_nan else out
