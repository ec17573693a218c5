"""Bin annotation: one label, or a column for each label, from intervals that overlap a bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .overlap import overlap_join

METRICS = ("bp_overlap", "frac_overlap", "chrom_enrich")
MODALITIES = 15
_KEY = ("chrom", "start", "end")


def annotation_column(annotation: DataFrame) -> str:
    """Its one column besides chrom, start and end."""
    others = [c for c in annotation.columns if c not in _KEY]
    if len(others) != 1 or len(annotation.columns) != 4:
        raise ValueError("an annotation has chrom, start, end and exactly one other column")
    return others[0]


def validate(metric: str, consolidate: bool, save_all_mods: bool) -> None:
    if not consolidate and (metric == "chrom_enrich" or save_all_mods):
        raise ValueError("chrom_enrich and save_all_mods need consolidate")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")


def candidates(bins: DataFrame, annotation: DataFrame, metric: str, bin_size: int, consolidate: bool = True) -> DataFrame:
    """(chrom, start, end, mod, value, ord): overlaps of each bin, and a row with a null mod for what is uncovered.

    An uncovered part may be negative where intervals overlap each other. ord: of overlaps their interval's place, null mod last.
    """
    name = annotation_column(annotation)
    base = bins.select(*_KEY)
    met = overlap_join(base, annotation.select(*_KEY, F.col(name).cast("string").alias("mod")), bin_size)
    met = met.select(*_KEY, "mod", "bp", F.struct(F.lit(0).alias("last"), F.col("interval_start").cast("long").alias("a"), F.col("interval_end").cast("long").alias("b"), "mod").alias("ord"))
    rest = base.join(met.groupBy(*_KEY).agg(F.sum("bp").alias("covered")), list(_KEY), "left")
    rest = rest.select(*_KEY, F.lit(None).cast("string").alias("mod"), (F.col("end") - F.col("start") - F.coalesce("covered", F.lit(0))).cast("long").alias("bp"), F.struct(F.lit(1).alias("last"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("").alias("mod")).alias("ord"))
    rows = met.unionByName(rest.where("bp <> 0"))
    if consolidate:
        rows = rows.groupBy(*_KEY, "mod").agg(F.sum("bp").alias("bp"), F.min("ord").alias("ord"))
    size = F.col("end") - F.col("start")
    if metric == "bp_overlap":
        value = F.col("bp").cast("double")
    elif metric == "frac_overlap":
        value = F.col("bp") / size
    else:
        # a row for each chromosome and label: no task gathers the candidates of a whole chromosome
        sums = rows.groupBy(F.col("chrom").alias("__chrom"), F.col("mod").alias("__mod")).agg(F.sum("bp").alias("__bp"))
        sums = sums.select("__chrom", "__mod", (F.col("__bp") / F.sum("__bp").over(Window.partitionBy("__chrom"))).alias("__share"))
        rows = rows.join(sums, (F.col("chrom") == F.col("__chrom")) & F.col("mod").eqNullSafe(F.col("__mod")))
        value = F.log2(1 + (F.col("bp") / size) / F.when(F.col("__share") != 0, F.col("__share")))
    return rows.select(*_KEY, "mod", value.alias("value"), "ord")


def annotated_bins(bins: DataFrame, annotation: DataFrame, metric: str, bin_size: int, consolidate: bool = True, save_all_mods: bool = False, ignore_null_mode: bool | str = "auto") -> DataFrame:
    """(chrom, start, end) with the annotation's column, or with a column {mod}_{metric} for each of its values.

    A bin's label is the one of the greatest value, of equals the first in interval order, the uncovered rest last.
    ignore_null_mode: the rest is no candidate where there is another; auto: unless the metric is an enrichment.
    """
    validate(metric, consolidate, save_all_mods)
    name = annotation_column(annotation)
    if ignore_null_mode == "auto":
        ignore_null_mode = not metric.endswith("enrich")
    rows = candidates(bins, annotation, metric, bin_size, consolidate)
    if save_all_mods:
        values = [r[0] for r in annotation.select(F.col(name).cast("string")).where(F.col(name).isNotNull()).distinct().limit(MODALITIES + 1).collect()]
        if len(values) > MODALITIES:
            raise ValueError(f"more than {MODALITIES} modalities")
        wide = rows.withColumn("mod", F.coalesce("mod", F.lit("null"))).groupBy(*_KEY).pivot("mod", [*sorted(values), "null"]).agg(F.first("value"))
        return wide.withColumnsRenamed({v: f"{v}_{metric}" for v in [*values, "null"]})
    by_bin = Window.partitionBy(*_KEY)
    if ignore_null_mode:
        rows = rows.withColumn("__any", F.max(F.col("mod").isNotNull()).over(by_bin)).where(~F.col("__any") | F.col("mod").isNotNull())
    best = rows.withColumn("__nth", F.row_number().over(by_bin.orderBy(F.desc(F.round("value", 9)), "ord"))).where("__nth = 1")
    return best.select(*_KEY, F.col("mod").alias(name))


def with_annotation(bins: DataFrame, annotation: DataFrame, metric: str, bin_size: int, **options) -> DataFrame:
    """bins with the annotation's columns; a missing text is "None", as the word.  A name that bins have is a KeyError."""
    found = annotated_bins(bins, annotation, metric, bin_size, **options)
    new = [c for c in found.columns if c not in _KEY]
    if clash := [c for c in new if c in bins.columns]:
        raise KeyError(f"bins already have {', '.join(clash)}")
    out = bins.join(found, list(_KEY), "left")
    kinds = dict(found.dtypes)
    return out.select(*bins.columns, *[F.coalesce(c, F.lit("None")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in new])
