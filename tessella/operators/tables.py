"""Tables of bins and of pixels: handles that hold an immutable frame. Methods that change a table bind another frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.normalisers import NORMALISERS, Normaliser
from ..functions.regions import Region, RegionNotFound, parse_region
from ..sources.dataset import load_dataset, save_dataset
from ..sources.frames import BIN_SCHEMA, PIXEL_SCHEMA, as_frame, convert, with_index
from ..sources.workdir import stored
from ..streaming.chunks import chunked
from .annotate import with_annotation
from .graph import ContactGraph
from .matrix import complete_matrix, dense_matrix, matrix_cells
from .strategies import BIN_BASE, PIXEL_BASE, Strategy, annotate_pixels, balance_pixels, drop_existing, folded, row_filter, subset_region

STORE_SIZE = 10_000_000


def written_back(pixels: DataFrame, edges: DataFrame, names: list[str], *, add: bool) -> DataFrame:
    """pixels with the columns names of edges, sorted by both ids; add: with the edges that are no pixels, and their count."""
    new = edges.select("bin1_id", "bin2_id", F.col("count").alias("__count"), *[F.col(f"`{c}`") for c in names])
    out = pixels.join(new, ["bin1_id", "bin2_id"], "full_outer" if add else "left")
    if add:
        out = out.withColumn("count", F.coalesce("count", "__count", F.lit(0)).cast(pixels.schema["count"].dataType))
    return out.drop("__count").orderBy("bin1_id", "bin2_id")


class Table:
    def __init__(self, df: DataFrame, store_size: int = STORE_SIZE) -> None:
        self._df, self._store_size = df, store_size

    @property
    def df(self) -> DataFrame:
        return self._df

    @property
    def store_size(self) -> int:
        """Rows of a file at most, when the table is saved."""
        return self._store_size

    @property
    def col_names(self) -> tuple[str, ...]:
        return tuple(self._df.columns)

    def peek(self) -> dict:
        """The first row by key; an empty table is an AssertionError."""
        row = self._df.orderBy(self._df.columns[0]).first()
        assert row is not None, "the table is empty"
        return row.asDict()


class BinTable(Table):
    """bin_id, chrom, start, end and annotations. bin_id is numbered by chromosome and start where it is absent."""

    def __init__(self, bins, store_size: int = STORE_SIZE, spark: SparkSession | None = None) -> None:
        super().__init__(with_index(as_frame(spark or SparkSession.active(), bins, BIN_SCHEMA), "bin_id", ["chrom", "start"]), store_size)
        self._bin_size: int | None = None

    def copy(self) -> BinTable:
        return BinTable(self._df, self._store_size)

    __copy__ = copy

    @property
    def bin_size(self) -> int:
        """Length of the first bin."""
        if self._bin_size is None:
            row = self._df.orderBy("bin_id").select((F.col("end") - F.col("start")).alias("size")).first()
            assert row is not None, "the table is empty"
            self._bin_size = row.size
        return self._bin_size

    def _within(self, region: Region, strict: bool) -> DataFrame:
        return self._df.where(region.predicate(self.bin_size if region.ranged else 0, strict))

    def get_dataframe(self, region: str | None = None, *, dtype: str = "spark", strict: bool = False):
        return convert(self._df if region is None else self._within(parse_region(region), strict), dtype)

    def get_chunks(self, region: str | None = None, *, chunk_size: int = STORE_SIZE, dtype: str = "pandas", condition=None) -> Iterator:
        """Frames of chunk_size rows, the last shorter, in order of bin_id. condition: only the rows for which it holds."""
        bins = self.get_dataframe(region)
        return chunked((bins if condition is None else row_filter(bins, condition)).orderBy("bin_id"), chunk_size, dtype)

    def extent(self, region: str, *, strict: bool = False) -> tuple[int, int]:
        """Half-open range of the bin ids of a region. strict: a range beyond its chromosome's end, or one that ends before it
        starts, is a ValueError.
        """
        parsed = parse_region(region)
        bins = F.when(parsed.predicate(self.bin_size if parsed.ranged else 0, strict), F.col("bin_id"))
        low, high, end = self._df.where(F.col("chrom") == parsed.chrom).agg(F.min(bins), F.max(bins), F.max("end")).first()
        if strict and parsed.ranged and end is not None and not 0 <= parsed.start <= parsed.end <= end:
            raise ValueError(f"{region} lies outside of its chromosome, which ends at {end}")
        if low is None:
            raise RegionNotFound(f"no bin lies in {region}")
        return low, high + 1

    def extended(self, region: str) -> str:
        """A bare chromosome as chrom:0-end."""
        if parse_region(region).ranged:
            return region
        end = self._within(parse_region(region), False).agg(F.max("end")).first()[0]
        if end is None:
            raise RegionNotFound(f"no bin lies in {region}")
        return f"{region}:0-{end}"

    def add_annotation(self, annot_df, *, metric: str = "frac_overlap", consolidate: bool = True, save_all_mods: bool = False, ignore_null_mode: bool | str = "auto") -> None:
        annotation = as_frame(self._df.sparkSession, annot_df)
        self._df = with_annotation(self._df, annotation, metric, self.bin_size, consolidate=consolidate, save_all_mods=save_all_mods, ignore_null_mode=ignore_null_mode)

    def save(self, path: str) -> None:
        save_dataset({"bins": self._df}, path, self._store_size)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> BinTable:
        return cls(load_dataset(spark or SparkSession.active(), path, ("bins",))["bins"])


class PixelTable(Table):
    """bin1_id, bin2_id, count and annotations, over a table of bins that it shares with the tables made from it."""

    def __init__(self, pixels, *, bins, store_size: int = STORE_SIZE, spark: SparkSession | None = None) -> None:
        super().__init__(as_frame(spark or SparkSession.active(), pixels, PIXEL_SCHEMA), store_size)
        self._bins = bins if isinstance(bins, BinTable) else BinTable(bins, spark=spark)

    def copy(self) -> PixelTable:
        return PixelTable(self._df, bins=self._bins.copy(), store_size=self._store_size)

    __copy__ = copy

    @property
    def bins(self) -> BinTable:
        return self._bins

    def get_dataframe(self, region: str | None = None, *, annotate: bool = True, balance: bool = False, dtype: str = "spark", strategies: Strategy | Iterable[Strategy] | None = None, selection_kwargs: dict | None = None):
        """Pixels, in this order: cut to the region, balanced, passed through strategies, annotated."""
        options = {"balance": balance, "strategies": strategies} | {k: v for k, v in (selection_kwargs or {}).items() if k not in ("region", "annotate", "chunk_size", "dtype")}
        pixels, bins = self._df, self._bins.get_dataframe(region)
        if region is not None:
            pixels = subset_region(pixels, extent=self._bins.extent(region))
        if options["balance"]:
            pixels = balance_pixels(pixels, bins_df=bins)
        pixels = folded(pixels, options["strategies"])
        return convert(annotate_pixels(pixels, bins_df=bins) if annotate else pixels, dtype)

    def get_chunks(self, region: str | None = None, *, annotate: bool = True, balance: bool = False, chunk_size: int = STORE_SIZE, strategies=None, dtype: str = "pandas", condition=None) -> Iterator:
        """Frames of chunk_size rows, the last shorter, in pixel order. condition: only the rows for which it holds."""
        pixels = self.get_dataframe(region, annotate=annotate, balance=balance, strategies=strategies)
        return chunked((pixels if condition is None else row_filter(pixels, condition)).orderBy("bin1_id", "bin2_id"), chunk_size, dtype)

    def subset(self, region: str) -> PixelTable:
        return PixelTable(subset_region(self._df, extent=self._bins.extent(region)), bins=self._bins)

    def apply(self, strategies: Strategy | Iterable[Strategy]) -> PixelTable:
        return PixelTable(folded(self._df, strategies), bins=self._bins, store_size=self._store_size)

    def _bounds(self, region: str | None) -> tuple[int, int]:
        if region is None:
            low, high = self._df.agg(F.least(F.min("bin1_id"), F.min("bin2_id")), F.greatest(F.max("bin1_id"), F.max("bin2_id"))).first()
            return (0, 0) if low is None else (low, high + 1)
        parsed, (low, high) = parse_region(region), self._bins.extent(region)
        size = self._bins.bin_size
        return low, low + math.ceil(parsed.end / size) - parsed.start // size if parsed.ranged else high

    def get_matrix_cells(self, region: str | None = None, *, value_col: str = "count", mode: str = "full", mask_diagonal: bool = False, complete: bool = False, selection_kwargs: dict | None = None) -> DataFrame:
        table = self
        if region is None:  # the bounds and the cells each read all pixels
            table = PixelTable(stored(self._df, "pixels"), bins=self._bins)
        pixels = table.get_dataframe(region, annotate=False, selection_kwargs=selection_kwargs)
        bounds = table._bounds(region)
        cells = matrix_cells(pixels, bounds, value_col, mode, mask_diagonal)
        return complete_matrix(cells, bounds[1] - bounds[0]) if complete else cells

    def get_matrix(self, region: str | None = None, *, value_col: str = "count", mode: str = "full", mask_diagonal: bool = False, selection_kwargs: dict | None = None) -> np.ndarray:
        low, high = self._bounds(region)
        return dense_matrix(self.get_matrix_cells(region, value_col=value_col, mode=mode, mask_diagonal=mask_diagonal, selection_kwargs=selection_kwargs), high - low)

    def get_graph(self, region: str | None = None) -> ContactGraph:
        return ContactGraph.from_pixel_table(self, region=region)

    def add_bin_annotation(self, annot_df, **options) -> None:
        self._bins.add_annotation(annot_df, **options)

    def add_pix_annotation(self, annot_df, *, how: str = "inner") -> None:
        """Joins on both ids; by default pixels without an annotation go."""
        annotation = as_frame(self._df.sparkSession, annot_df)
        if clash := (set(annotation.columns) & set(self._df.columns)) - {"bin1_id", "bin2_id"}:
            raise NotImplementedError(f"pixels already have {', '.join(sorted(clash))}")
        self._df = self._df.join(annotation, ["bin1_id", "bin2_id"], how)

    def normalize_counts(self, norm: str | Normaliser = "arctan_mean", *, column: str = "norm_count") -> None:
        if column in self._df.columns:
            raise ValueError(f"pixels already have {column}")
        if not callable(norm) and norm not in NORMALISERS:
            raise ValueError(f"unknown normaliser {norm!r}")
        found: Callable = norm if callable(norm) else NORMALISERS[norm]
        self._df = found(self._df, column)

    def add_clustering(self, region: str | None = None, on: str = "count", *, marginals: str = "no", seed: int = 42, effort: int = 30) -> DataFrame:
        """Clusters a region and joins levels and probabilities to bins and pixels by their ids; null outside the region.

        Both tables are in order after that. With marginals "pixels" edges that the table lacks come in with their own count.
        """
        graph = self.get_graph(region)
        levels = graph.compute_clustering(on=on, marginals=marginals, seed=seed, effort=effort)
        bins, edges = graph.get_bins(), graph.get_pixels()
        new_bins = [c for c in bins.columns if c not in self._bins.col_names]
        new_edges = [c for c in edges.columns if c not in self._df.columns and c != "genomic"]
        own = drop_existing(self._bins.df, new_bins, BIN_BASE)
        self._bins._df = own.join(bins.select("bin_id", *[F.col(f"`{c}`") for c in new_bins]), "bin_id", "left").orderBy("bin_id")
        self._df = written_back(drop_existing(self._df, new_edges, PIXEL_BASE), edges, new_edges, add=marginals == "pixels")
        return levels

    def save(self, path: str) -> None:
        save_dataset({"bins": self._bins.df, "pixels": self._df}, path, self._store_size)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> PixelTable:
        found = load_dataset(spark or SparkSession.active(), path, ("bins", "pixels"))
        return cls(found["pixels"], bins=BinTable(found["bins"]))
