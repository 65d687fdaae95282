"""Sums that don't depend on the order of rows: 64-bit fixed point with scale 2^30."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 30)


def to_fixed(x: Column) -> Column:
    return F.round(x * F.lit(SCALE)).cast("bigint")


def fixed_sum(x: Column) -> Column:
    """sum(x) as a double, the same for every partitioning."""
    return F.sum(to_fixed(x)).cast("double") / F.lit(SCALE)


def padded_width(n: Column) -> Column:
    """The width rounded up to a multiple of 128, as the data files have it."""
    return (F.floor((n + 127) / 128) * 128).cast("bigint")
