"""Contact matrices: in long form, or as an array of a bounded region."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

MODES = ("upper", "lower", "full")
#: Cells of an array that the driver builds at most.
CELLS = 25_000_000
#: Cells of a complete matrix that a task makes, and the least number of tasks.
TASK_CELLS, LEAST_TASKS = 16_000_000, 8


def matrix_cells(pixels: DataFrame, bounds: tuple[int, int], value: str = "count", mode: str = "full", mask_diagonal: bool = False) -> DataFrame:
    """(i, j, value) of the pixels within bounds, ids counted from its start; missing cells have no row."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    lower, upper = bounds
    cells = pixels.where((F.col("bin1_id") >= lower) & (F.col("bin2_id") >= lower) & (F.col("bin1_id") < upper) & (F.col("bin2_id") < upper))
    cells = cells.select((F.col("bin1_id") - lower).alias("i"), (F.col("bin2_id") - lower).alias("j"), F.col(value).cast("double").alias("value"))
    if mask_diagonal:
        cells = cells.where("i <> j")
    if mode == "upper":
        return cells
    own, turned = F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    if mode == "lower":
        return cells.select(turned.alias("x")).select("x.*")
    # one pass: a union would make the pixels twice
    return cells.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, turned))).alias("x")).select("x.*")


def complete_matrix(cells: DataFrame, side: int) -> DataFrame:
    """All side x side cells, null where there is no pixel. Only the given cells are dealt out, by row of the matrix, with one more
    before each row; each is then followed by the missing ones up to the next, which go nowhere else.
    """
    given = cells.where(F.col("i").between(0, side - 1) & F.col("j").between(0, side - 1)).select("i", "j", "value")
    before = cells.sparkSession.range(side).select(F.col("id").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(None).cast(given.schema["value"].dataType).alias("value"))
    dealt = given.unionByName(before).repartition(min(1 << 16, max(LEAST_TASKS, -(-side * side // TASK_CELLS))), "i")
    following = F.coalesce(F.lead("j").over(Window.partitionBy("i").orderBy("j")), F.lit(side).cast("long"))
    # of repeated cells the next one is in the same place
    runs = dealt.withColumn("__last", F.greatest(following - 1, F.col("j")))
    spread = runs.select("i", F.explode(F.sequence("j", "__last")).alias("__at"), "j", "value").where("__at >= 0")
    return spread.select("i", F.col("__at").alias("j"), F.when(F.col("__at") == F.col("j"), F.col("value")).alias("value"))


def dense_matrix(cells: DataFrame, side: int, limit: int = CELLS) -> np.ndarray:
    if side * side > limit:
        raise ValueError(f"{side} x {side} cells are more than {limit}; take the long form")
    out = np.full((side, side), np.nan)
    found = cells.toArrow()
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["value"].to_numpy(zero_copy_only=False)
    return out
