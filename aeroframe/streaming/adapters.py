"""The stateless operators work on streams as they are; these are the stateful ones' forms for streams."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators.series import _REBIN, microseconds


def _watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarks need instants; times without a zone count as UTC (the session's zone)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp_ltz")).withWatermark(ts, late)


def rebin_stream(df: DataFrame, ts: str, values: list[str], freq: str, method: str = "mean", late: str = "10 minutes", origin: datetime | None = None) -> DataFrame:
    """Tumbling buckets with a watermark; buckets without rows aren't made."""
    if method not in _REBIN or method == "median":
        raise ValueError(f"{method!r} has no form for streams")
    step = microseconds(freq)
    offset = round(((origin or datetime(1970, 1, 1)) - datetime(1970, 1, 1)) / timedelta(microseconds=1)) % step
    bucket = F.window(ts, f"{step} microseconds", None, f"{offset} microseconds")
    return _watermarked(df, ts, late).groupBy(bucket.alias("bucket")).agg(*(_REBIN[method](F.col(c)).alias(c) for c in values)).select(F.col("bucket.start").cast("timestamp_ntz").alias(ts), *values)


def deduplicate_stream(df: DataFrame, ts: str, late: str = "10 minutes", order: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """One row of each time (and ``by``) among those within the watermark.

    With ``order`` it is the first in that order, a file's name and a row's
    place in it, say, whatever the order in which rows come: the least row so
    far is state until the watermark has passed its time, and comes out then.
    Rows later than the watermark, and those without a time, are left out.
    Without ``order`` it is the row that comes first, at once.
    """
    marked = _watermarked(df, ts, late)
    if not order:
        return marked.dropDuplicatesWithinWatermark([*by, ts]).withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    rest = [c for c in df.columns if c != ts and c not in by]
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*(F.col(f"`{c}`") for c in order)))
    kept = marked.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(least.alias("__row"))
    shown = {c: F.col("__row").getField(c) for c in rest} | {c: F.col(f"`{c}`") for c in by} | {ts: F.col(ts).cast("timestamp_ntz")}
    return kept.select(*(shown[c].alias(c) for c in df.columns))


def smooth_stream(*_, **__) -> None:
    raise NotImplementedError("a centred window of rows needs rows that haven't come yet; rebin the stream or smooth a table")
