"""Columns computed inside a row of bins; all built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def row_total(columns: Sequence[str], factors: Sequence[float] | None = None) -> Column:
    """Sum of bins times factors; nulls count as 0."""
    factors = factors or [1.0] * len(columns)
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(k)) if k != 1.0 else F.coalesce(F.col(c), F.lit(0.0)) for c, k in zip(columns, factors, strict=True)]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def weighted_sum(columns: Sequence[str], factors: Sequence[float]) -> Column:
    """Sum of bins times factors over bins with a factor; null if one of these is null."""
    terms = [F.col(c) * F.lit(float(k)) for c, k in zip(columns, factors, strict=True) if k]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def mode_mid(bins: Column, mids: Sequence[float]) -> Column:
    """Mid-point of the first largest bin."""
    return F.element_at(F.array(*map(F.lit, map(float, mids))), F.array_position(bins, F.array_max(bins)).cast("int"))


def median_mid(columns: Sequence[str], total: Column, mids: Sequence[float]) -> Column:
    """Mid-point of the first bin up to which half of the total lies."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("mid"))
    bins = F.array(*(F.struct(F.col(c).alias("n"), F.lit(float(m)).alias("mid")) for c, m in zip(columns, mids, strict=True)))

    def step(state: Column, b: Column) -> Column:
        so_far = state["sum"] + b["n"]
        return F.struct(so_far.alias("sum"), F.when(state["mid"].isNull() & (so_far / total >= 0.5), b["mid"]).otherwise(state["mid"]).alias("mid"))

    return F.aggregate(bins, start, step)["mid"]


def geometric_mean(columns: Sequence[str], total: Column, mids: Sequence[float]) -> Column:
    return F.exp(weighted_sum(columns, [math.log(m) for m in mids]) / total)
