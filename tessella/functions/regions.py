"""Regions: a chromosome's name, or name:start-end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


class RegionNotFound(ValueError, AssertionError):
    """No bin lies in the region."""


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int | None = None
    end: int | None = None

    @property
    def ranged(self) -> bool:
        return self.start is not None

    def predicate(self, bin_size: int, strict: bool = False) -> Column:
        """Which bins belong to it. By default the bounds are one bin wide of the range, which also takes in a short
        last bin next to it; strict takes the bins that overlap the range.
        """
        on = F.col("chrom") == self.chrom
        if not self.ranged:
            return on
        if strict:
            return on & (F.col("start") < self.end) & (F.col("end") > self.start)
        return on & (F.col("start") >= self.start - bin_size + 1) & (F.col("end") <= self.end + bin_size - 1)


def parse_region(region: str) -> Region:
    """chr or chr:start-end; the range stands after the last colon of a name that has several."""
    name, colon, span = region.rpartition(":")
    if not colon:
        return Region(region)
    bounds = span.split("-")
    if len(bounds) != 2:
        raise ValueError(f"a range needs a start and an end: {region!r}")
    try:
        return Region(name, int(bounds[0]), int(bounds[1]))
    except ValueError:
        raise ValueError(f"bounds of a range are whole numbers: {region!r}") from None
