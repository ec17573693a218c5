"""Frames from what callers have: Spark, pandas or Arrow tables, iterables of them, Parquet and delimited files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BIN_SCHEMA, PIXEL_SCHEMA = "chrom string, start int, end int", "bin1_id long, bin2_id long, count long"


def as_frame(spark: SparkSession, data, schema: str | None = None) -> DataFrame:
    """One frame of the given one, or of all the given ones, columns matched by name. Nothing at all needs a schema."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (pd.DataFrame, pa.Table)):
        return spark.createDataFrame(data) if len(data) or schema is None else spark.createDataFrame([], schema)
    if isinstance(data, Iterable):
        frames = [as_frame(spark, d, schema) for d in data]
        if frames:
            return reduce(DataFrame.unionByName, frames)
        return spark.createDataFrame([], schema)
    raise ValueError(f"no frame: {type(data).__name__}")


def convert(df: DataFrame, kind: str):
    """To spark, pandas or arrow; the latter two bring all rows to the driver."""
    kinds = {"spark": lambda: df, "pandas": df.toPandas, "arrow": df.toArrow}
    if kind not in kinds:
        raise ValueError(f"unknown kind of frame {kind!r}")
    return kinds[kind]()


def with_index(df: DataFrame, name: str, order: list[str], offset: int = 0) -> DataFrame:
    """Adds a gapless row number in the given order, unless there is one. The order is taken by chromosome first: each
    chromosome is numbered by itself, and starts after the sizes of those before it.
    """
    if name in df.columns:
        return df
    if order[0] != "chrom":
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + offset).cast("long"))
    sizes = df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))  # a row a chromosome
    before = sizes.select("chrom", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("chrom").orderBy(*order[1:]))
    return df.withColumn("__nth", inside).join(F.broadcast(before), "chrom").withColumn(name, (F.col("__before") + F.col("__nth") - 1 + offset).cast("long")).select(name, *df.columns)


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, separator: str = "\t") -> DataFrame:
    """A delimited file with a header (bins, pixels or an annotation)."""
    reader = spark.read.option("header", True).option("sep", separator)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
