"""Numeric kernels of the scoring: finiteness and min-max normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def normalise(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between low and high, from 0 to 1: 0 for a missing x, then 0.5 if low and high are equal."""
    share = F.try_divide(x - low, high - low)
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).when(high == low, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def largest(values: Column) -> Column:
    """The largest finite element above -1 of an array of doubles, else null."""
    return F.array_max(F.filter(values, lambda m: (m > -1) & ~F.isnan(m) & (m < F.lit(float("inf")))))
