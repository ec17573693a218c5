"""Contact graphs: bins are vertices, pixels edges; neighbouring bins without an edge get a genomic link."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.frames import convert
from ..streaming.chunks import chunked
from .clustering import cluster_graph

if TYPE_CHECKING:
    from .tables import PixelTable


def genomic_links(bins: DataFrame, edges: DataFrame, default_link: float = 1) -> DataFrame:
    """Edges between consecutive bins of a chromosome that have none: count default_link, any other number 0."""
    following = Window.partitionBy("chrom").orderBy("bin_id")
    near = bins.select(F.col("bin_id").alias("bin1_id"), F.lead("bin_id").over(following).alias("bin2_id")).where("bin2_id is not null")
    missing = near.join(edges.select("bin1_id", "bin2_id"), ["bin1_id", "bin2_id"], "left_anti")
    blank = lambda kind: F.lit("") if kind == "string" else F.lit(False) if kind == "boolean" else F.lit(0)
    kinds = dict(edges.dtypes)
    own = {"bin1_id": F.col("bin1_id"), "bin2_id": F.col("bin2_id"), "count": F.lit(default_link), "genomic": F.lit(True)}
    return missing.select(*[own.get(c, blank(kinds[c])).cast(kinds[c]).alias(c) for c in edges.columns])


def numbered(bins: DataFrame, span: int = 1 << 16) -> DataFrame:
    """bins with node_id: their place in the order of bin_id, from 0, counted within spans of ids after the spans before."""
    of = F.floor(F.col("bin_id") / span).alias("__span")
    spans = bins.groupBy(of).agg(F.count(F.lit(1)).alias("__n"))  # a row for each span
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("__span").orderBy("bin_id")) - 1
    return bins.withColumn("__span", of).withColumn("__nth", nth).join(spans.select("__span", before.alias("__before")), "__span").select(*[F.col(f"`{c}`") for c in bins.columns], (F.col("__before") + F.col("__nth")).alias("node_id"))


class ContactGraph:
    """vertices: bins with id; edges: pixels with src, dst and the flag genomic. Self loops are left out."""

    def __init__(self, *, bins: DataFrame, pixels: DataFrame, default_link: float = 1) -> None:
        self._bins = bins
        edges = pixels.where("bin1_id <> bin2_id").withColumn("genomic", F.lit(False))
        self._edges = edges.unionByName(genomic_links(bins, edges, default_link))
        self._clustered = self._reconstructed = False

    @classmethod
    def from_pixel_table(cls, table: PixelTable, *, region: str | None = None) -> ContactGraph:
        return cls(bins=table.bins.get_dataframe(region), pixels=table.get_dataframe(region, annotate=False))

    @classmethod
    def from_store(cls, store, *, region: str | None = None) -> ContactGraph:
        return cls.from_pixel_table(store.get_pixel_table(region), region=region)

    @property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(vertices with id, edges with src and dst)."""
        return self._bins.withColumn("id", F.col("bin_id")), self._edges.withColumnsRenamed({"bin1_id": "src", "bin2_id": "dst"})

    def get_bins(self, *, drop_node_id: bool = True, bare: bool = False, chunk_size: int | None = None, dtype: str = "spark"):
        """The vertices; with chunk_size an iterator of frames of so many rows, in order of bin_id."""
        out = self._bins.select("bin_id", "chrom", "start", "end") if bare else self._bins
        out = out if drop_node_id else numbered(out)
        return convert(out, dtype) if chunk_size is None else chunked(out.orderBy("bin_id"), chunk_size, dtype)

    def get_pixels(self, *, keep_genomic: bool = False, chunk_size: int | None = None, dtype: str = "spark"):
        """Edges by bin ids; after a reconstruction all of them, with a count of 0 where there was no pixel. With chunk_size an
        iterator of frames of so many rows.
        """
        if self._reconstructed:
            out = self._edges.drop("genomic").withColumn("count", F.coalesce("count", F.lit(0)))
        else:
            out = self._edges if keep_genomic else self._edges.where("not genomic").drop("genomic")
        out = out.orderBy("bin1_id", "bin2_id")
        return convert(out, dtype) if chunk_size is None else chunked(out, chunk_size, dtype)

    def compute_clustering(self, *, on: str, marginals: str = "no", seed: int = 42, effort: int = 30) -> DataFrame:
        """Adds level_(k), and with marginals bin_prob, pix_prob and pix_group; gives (bin_id, level, cluster)."""
        if self._clustered:
            raise ValueError("the graph is clustered already")
        found = cluster_graph(self._bins, self._edges, on=on, marginals=marginals, seed=seed, effort=effort)
        self._bins, self._edges, self._clustered, self._reconstructed = found.bins, found.edges, True, marginals == "pixels"
        return found.levels
