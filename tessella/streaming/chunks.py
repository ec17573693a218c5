"""Streams: frames of constant size for callers that iterate, and counts over a stream of contacts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def rechunk(frames: Iterable[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Frames of size rows, the last shorter; empty ones are dropped, and of nothing but empty ones nothing is left."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        while len(frame):
            part = frame.iloc[: size - n]
            held.append(part)
            n += len(part)
            frame = frame.iloc[len(part) :]
            if n == size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def chunked(df: DataFrame, size: int, dtype: str = "pandas", batch: int = 50_000) -> Iterator:
    """df in its order as frames of size rows, pandas ones, Arrow tables or Spark frames; the driver holds one partition and one
    frame at a time.
    """
    if size < 1:
        raise ValueError("a chunk has a row at least")
    to_arrow = lambda frame: pa.Table.from_pandas(frame, to_arrow_schema(df.schema), preserve_index=False)
    made = {"pandas": lambda frame: frame, "arrow": to_arrow, "spark": lambda frame: df.sparkSession.createDataFrame(to_arrow(frame), df.schema)}
    if dtype not in made:
        raise ValueError(f"unknown kind of frame {dtype!r}")

    def frames():
        rows = []
        for row in df.toLocalIterator(prefetchPartitions=False):
            rows.append(row)
            if len(rows) == min(size, batch):
                yield pd.DataFrame(rows, columns=df.columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=df.columns)

    return map(made[dtype], rechunk(frames(), size))


def pixel_counts(contacts: DataFrame, bin_size: int) -> DataFrame:
    """(chrom1, start1, chrom2, start2, count) of contacts (chrom1, pos1, chrom2, pos2), batch or streaming: both ends are put on their
    bins, the smaller end first. On a stream the result is updated with every batch.
    """
    start = lambda c: (F.floor(F.col(c) / bin_size) * bin_size).alias(c)
    one, two = F.struct("chrom1", start("pos1")), F.struct(F.col("chrom2").alias("chrom1"), start("pos2").alias("pos1"))
    ends = contacts.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    return ends.groupBy(F.col("a.chrom1").alias("chrom1"), F.col("a.pos1").alias("start1"), F.col("b.chrom1").alias("chrom2"), F.col("b.pos1").alias("start2")).agg(F.count(F.lit(1)).alias("count"))
