"""The driver's tables as series: definitions shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.model import Bins, Moment, SeriesMeta
from aeroframe.operators.series import Series1D
from aeroframe.operators.sizes import Series2D, counts_by_bin

EDGES = (100.0, 300.0, 600.0, 1500.0, 3000.0, 5000.0, 12000.0)
BINS = Bins.arithmetic(EDGES)
FINE_BINS = Bins.arithmetic(tuple(e / 10 for e in EDGES))
ACTIVITIES = {
    "Background": ("2024-01-02", "2024-01-03"),
    "Emission": [("2024-01-05", "2024-01-06"), ("2024-01-10", "2024-01-12 12:00:00")],
    "Decay": ("2024-01-20", "2024-01-21"),
    "Nothing": ("2023-01-01", "2023-01-02"),
    "Overlap": ("2024-01-05 12:00:00", "2024-01-07"),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def s1(spark: SparkSession, sf_dir: str) -> Series1D:
    """events as a series: time and value."""
    return Series1D.from_df(events(spark, sf_dir).select("ts", F.col("value").alias("total_conc")), "ts", ["total_conc"])


def _counts(spark: SparkSession, sf_dir: str, width: str, bins: Bins) -> Series2D:
    table = counts_by_bin(events(spark, sf_dir), F.window("ts", width)["start"], F.col("value") * 25, BINS)
    return Series2D.from_bins(table, bins, meta=SeriesMeta(moment=Moment.NUMBER, units={"*": "cm⁻³"}))


def s2(spark: SparkSession, sf_dir: str) -> Series2D:
    """Hourly size distribution: diameter is value * 25 nm."""
    return _counts(spark, sf_dir, "1 hour", BINS)


def s2m(spark: SparkSession, sf_dir: str) -> Series2D:
    """The same in 10 minutes, some without particles."""
    return _counts(spark, sf_dir, "10 minutes", BINS)


def s2d(spark: SparkSession, sf_dir: str) -> Series2D:
    """The same counts hourly, at a tenth of the diameters."""
    return _counts(spark, sf_dir, "1 hour", FINE_BINS)


def s2_marked(spark: SparkSession, sf_dir: str) -> Series2D:
    return s2(spark, sf_dir).mark(ACTIVITIES)
