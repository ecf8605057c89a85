"""Quantities derived from instruments' raw columns; built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_per_volume(count: Column, period: Column, flow: Column) -> Column:
    """Counts of a period (hundredths of a second) at a flow (hundredths of ml/s) as a concentration; null without volume."""
    return F.try_divide(count.cast("double"), period.cast("double") / 100 * (flow.cast("double") / 100))


def count_with_deadtime(count: Column, interval: Column, deadtime: Column) -> Column:
    """Counts at 16.67 ml/s over the live part of an interval (s); null if there is none."""
    return F.try_divide(count.cast("double"), F.lit(16.67) * (interval - deadtime))


def sampled_volume(df: DataFrame, ts: str = "ts", flag: str = "TEM", flow: str = "Flow", by: Sequence[str] = ()) -> DataFrame:
    """A row for each ``by``: first and last time with the flag, mean flow there times the minutes between (ml), rows, and rising edges.

    Rising edges are counted by comparing each row with the one before; the
    rows before are found inside hours and across their ends.
    """
    hour = F.date_trunc("hour", F.col(ts))
    rows = df.select(*by, F.col(ts).alias("ts"), (F.col(flag) == 1).alias("on"), F.col(flow).cast("double").alias("flow"), hour.alias("hour"))
    inside = rows.withColumn("before", F.lag(F.col("on").cast("int")).over(Window.partitionBy(*by, "hour").orderBy("ts")))
    by_hour = inside.groupBy(*by, "hour").agg(
        F.count_if(F.col("on") & (F.col("before") == 0)).alias("edges"), F.min_by(F.col("on").cast("int"), "ts").alias("first_on"), F.max_by(F.col("on").cast("int"), "ts").alias("last_on"),
        F.min(F.when(F.col("on"), F.col("ts"))).alias("start"), F.max(F.when(F.col("on"), F.col("ts"))).alias("end"), F.sum(F.when(F.col("on"), F.col("flow"))).alias("flow"), F.count(F.when(F.col("on"), F.col("flow"))).alias("flows"), F.count_if("on").alias("samples"),
    )
    ends = by_hour.withColumn("edge", ((F.lag("last_on").over(Window.partitionBy(*by).orderBy("hour")) == 0) & (F.col("first_on") == 1)).cast("int"))
    whole = ends.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("flow") / F.sum("flows")).alias("mean"), F.sum("samples").alias("samples"), (F.sum("edges") + F.coalesce(F.sum("edge"), F.lit(0))).alias("rising_edges"))
    micros = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end"))
    return whole.select(*by, "start", "end", (F.col("mean") * 1000 * micros / 60e6).alias("sample_vol_ml"), "samples", "rising_edges")
