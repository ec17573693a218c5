"""What plots of tables show, as frames and arrays; drawing is left to the caller."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.regions import RegionNotFound
from ..operators.tables import BinTable, PixelTable

TRANSFORMS = {"raw": lambda c: c, "log2": F.log2, "log10": F.log10}
#: Widths of styles.
WIDTHS_CM = {"publication": 9, "slides": 25}
#: How a matrix is shown.
MODALITIES = ("matrix", "triangular", "window")


def infer_track(column: str) -> tuple[str, int | None]:
    """(counts, None), (probs, None) or (clusters, level) from a column's name."""
    if column == "count":
        return "counts", None
    if "prob" in column:
        return "probs", None
    if "level" in column and (m := re.search(r"\d+", column)):
        return "clusters", int(m[0])
    raise ValueError(f"no track is known for {column!r}")


def style_width(style: str | None = None, width: float | None = None) -> float:
    if width is not None:
        return width
    if style is None:
        raise ValueError("a width or a style is needed")
    if style not in WIDTHS_CM:
        raise ValueError(f"unknown style {style!r}")
    return WIDTHS_CM[style]


def axis_unit(length: int) -> tuple[int, str]:
    return (1_000_000, "Mbp") if length >= 1_000_000 else (1_000, "Kb") if length >= 1_000 else (1, "bp")


class BinTrack:
    """The bins of a region with all their columns; None where there are none."""

    def __init__(self, bins: BinTable) -> None:
        self.bins = bins

    def fetch_data(self, region: str) -> DataFrame | None:
        try:
            self.bins.extent(region)
        except RegionNotFound:
            return None
        return self.bins.get_dataframe(region).orderBy("bin_id")


class BinClusters(BinTrack):
    """Clusters of a level along the bins of a region."""

    def __init__(self, bins: BinTable, level: int, *, col_name_pattern: str = "level_({})") -> None:
        super().__init__(bins)
        self.column = col_name_pattern.format(level)
        if self.column not in bins.col_names:
            raise KeyError(self.column)

    def fetch_data(self, region: str) -> DataFrame | None:
        found = super().fetch_data(region)
        return None if found is None else found.select("bin_id", "chrom", "start", "end", F.col(f"`{self.column}`").alias("value"))


class PixelTrack:
    """Cells of a region's matrix; counts are shown by their logarithm, probabilities and clusters as they are."""

    def __init__(self, pixels: PixelTable, *, value_col: str = "count", transform: str | None = None) -> None:
        self.kind, level = infer_track(value_col)
        if self.kind == "clusters" and value_col not in pixels.bins.col_names:
            raise KeyError(value_col)
        self.pixels, self.value_col, self.level = pixels, value_col, level
        self.transform = transform or ("log10" if self.kind == "counts" else "raw")

    @property
    def limits(self) -> tuple[float | None, float | None]:
        return {"counts": (None, None), "probs": (0, 1), "clusters": (1, None)}[self.kind]

    def cells(self, region: str) -> DataFrame:
        out = self.pixels.get_matrix_cells(region, value_col=f"`{self.value_col}`" if "(" in self.value_col else self.value_col)
        return out.withColumn("value", TRANSFORMS[self.transform](F.col("value")))

    def fetch_data(self, region: str, region2: str | None = None, **more) -> np.ndarray:
        if region2 is not None or more:
            raise NotImplementedError("one region only")
        return self.pixels.get_matrix(region, value_col=self.value_col)


def table_data(table: PixelTable, region: str, *, value_col: str = "count", modality: str = "matrix", depth_ratio: float = 0.5) -> dict:
    """region, modality, cells. Unless the whole matrix is shown, only cells up to depth_ratio of it from the diagonal count,
    and only the upper half: rotated, it is a triangle, and a window is its part of that depth over the region.
    """
    if modality not in MODALITIES:
        raise ValueError(f"unknown modality {modality!r}")
    if not 0 < depth_ratio <= 1:
        raise ValueError("depth_ratio is a share of the height, over 0 and up to 1")
    region = table.bins.extended(region)
    cells = PixelTrack(table, value_col=value_col).cells(region)
    if modality != "matrix":
        low, high = table._bounds(region)
        cells = cells.where((F.col("j") >= F.col("i")) & (F.col("j") - F.col("i") <= depth_ratio * (high - low)))
    return {"region": region, "modality": modality, "cells": cells}


def clustering_data(table: PixelTable, region: str, *, modality: str = "pixels", min_level: int = 0, max_level: int | None = None) -> dict[str, DataFrame | None]:
    """The counts and a track for each level until one is missing."""
    if modality not in ("pixels", "bins"):
        raise ValueError(f"unknown modality {modality!r}")
    out: dict[str, DataFrame | None] = {"count": PixelTrack(table).cells(region)}
    level = min_level
    while max_level is None or level <= max_level:
        try:
            name = f"level_({level})"
            out[name] = PixelTrack(table, value_col=name).cells(region) if modality == "pixels" else BinClusters(table.bins, level).fetch_data(region)
        except KeyError:
            break
        level += 1
    return out


def comparison_data(tables: PixelTable | list[PixelTable], region: str, *, value_cols: str | list[str] = "count") -> list[dict]:
    """One table with several columns or several tables with one; of exactly two tracks the second is inverted."""
    tables, value_cols = [tables] if isinstance(tables, PixelTable) else list(tables), [value_cols] if isinstance(value_cols, str) else list(value_cols)
    if not tables or not value_cols or (len(tables) > 1 and len(value_cols) > 1):
        raise ValueError("either one table or one column")
    pairs = [(t, c) for t in tables for c in value_cols]
    return [{"cells": PixelTrack(t, value_col=c).cells(region), "column": c, "inverted": len(pairs) == 2 and i == 1} for i, (t, c) in enumerate(pairs)]
