"""Contact stores: datasets of bins and pixels, opened by path; HDF5 contact files where h5py is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.regions import RegionNotFound, parse_region
from ..operators.annotate import with_annotation
from ..operators.expected import expected_normalized_pixels, get_expected_counts
from ..operators.strategies import BIN_BASE, annotate_pixels, balance_pixels, subset_region
from ..operators.tables import STORE_SIZE, BinTable, PixelTable
from .dataset import load_dataset, replace_table, save_dataset
from .frames import with_index


class ContactStore:
    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self._spark = path, spark or SparkSession.active()
        load_dataset(self._spark, path, ("bins", "pixels"))

    @classmethod
    def create(cls, path: str, bins: DataFrame, pixels: DataFrame, store_size: int = STORE_SIZE) -> ContactStore:
        save_dataset({"bins": bins, "pixels": pixels}, path, store_size)
        return cls(path, bins.sparkSession)

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self.path}/{name}")

    def extent(self, region: str) -> tuple[int, int]:
        """Of the bins that overlap the region."""
        return self.get_bin_table().extent(region, strict=True)

    def get_bin_table(self, *, store_size: int = STORE_SIZE) -> BinTable:
        bins = with_index(self._table("bins"), "bin_id", ["chrom", "start"])
        return BinTable(bins.withColumn("chrom", F.col("chrom").cast("string")), store_size)

    def get_pixel_table(self, region: str | None = None, *, store_size: int = STORE_SIZE) -> PixelTable:
        """All bins, and the pixels of the region: the filter on both ids goes down to the scan."""
        bins, pixels = self.get_bin_table(), self._table("pixels")
        return PixelTable(pixels if region is None else subset_region(pixels, extent=self.extent(region)), bins=bins, store_size=store_size)

    def bin_annot_add(self, annot_df: DataFrame, *, metric: str = "frac_overlap", consolidate: bool = True, save_all_mods: bool = False, ignore_null_mode: bool | str = "auto") -> None:
        """Annotates the stored bins; a column that they have is a KeyError."""
        table = self.get_bin_table()
        out = with_annotation(table.df, annot_df, metric, table.bin_size, consolidate=consolidate, save_all_mods=save_all_mods, ignore_null_mode=ignore_null_mode)
        replace_table(out, f"{self.path}/bins")

    def bin_annot_del(self, annot_name: str) -> None:
        if annot_name in BIN_BASE:
            raise ValueError(f"{annot_name} is no annotation")
        bins = self._table("bins")
        if annot_name not in bins.columns:
            raise KeyError(annot_name)
        replace_table(bins.drop(annot_name), f"{self.path}/bins")

    def get_expected_counts(self, *, smooth: float | None = 0.1) -> DataFrame:
        return get_expected_counts(self.get_bin_table().df, self._table("pixels"), smooth)

    def expected_normalized(self, path: str, *, smooth: float | None = 0.1) -> DataFrame:
        """Writes a store whose counts are observed over expected, and gives the expected counts."""
        bins, pixels = self.get_bin_table().df, self._table("pixels")
        expected = self.get_expected_counts(smooth=smooth)
        balanced = annotate_pixels(balance_pixels(pixels, bins_df=bins), bins_df=bins.select("bin_id", "chrom"))
        ratio = expected_normalized_pixels(balanced, expected).drop("chrom1", "chrom2")
        ContactStore.create(path, bins, ratio)
        return expected


def read_hdf5(spark: SparkSession, path: str, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(bins, pixels) of an HDF5 contact file with the groups chroms, bins and pixels; pixels are read in row ranges."""
    import h5py
    import pandas as pd

    with h5py.File(path, "r") as file:
        names = [x.decode() for x in file["chroms/name"][:]]
        bins = pd.DataFrame({"bin_id": range(len(file["bins/start"])), "chrom": [names[i] for i in file["bins/chrom"][:]], "start": file["bins/start"][:], "end": file["bins/end"][:]})
        if "weight" in file["bins"]:
            bins["weight"] = file["bins/weight"][:]
        n = len(file["pixels/bin1_id"])

    def scan(batches):
        with h5py.File(path, "r") as file:
            for batch in batches:
                for lo in batch["id"]:
                    part = slice(lo * rows, min(n, (lo + 1) * rows))
                    yield pd.DataFrame({c: file[f"pixels/{c}"][part] for c in ("bin1_id", "bin2_id", "count")})

    parts = max(1, -(-n // rows))
    return spark.createDataFrame(bins), spark.range(0, parts, 1, parts).mapInPandas(scan, "bin1_id long, bin2_id long, count long")


__all__ = ["ContactStore", "RegionNotFound", "parse_region", "read_hdf5"]
