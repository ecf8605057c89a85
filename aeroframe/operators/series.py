"""Time series of one or more values, as lazy immutable wrappers of a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from aeroframe.functions.metrics import no_nan
from aeroframe.model import ALL_DATA, Activity, Bins, Scale, SeriesMeta, common_bins, moment_of_time, periods

#: Rows in a block of a rolling window over one long series.
BLOCK_ROWS = 65_536
#: Rows of a window up to which each row's window is looked through.
FRAME_ROWS = 16
#: Buckets that a rebinning with gaps may make, and those that one row makes.
MOST_BUCKETS, PIECE = 50_000_000, 4096

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "t": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def microseconds(freq: str | timedelta) -> int:
    """Length of a frequency such as ``30s``, ``5min``, ``2.5h``, ``1D`` or ``1h30min``, in any case."""
    if isinstance(freq, timedelta):
        total = round(freq / timedelta(microseconds=1))
    else:
        text = freq.strip().lower()
        parts = re.findall(r"(\d+(?:\.\d+)?|)\s*(us|ms|min|s|t|h|d)", text)
        if not parts or "".join(a + b for a, b in parts) != text.replace(" ", ""):
            raise ValueError(f"not a frequency: {freq!r}")
        total = round(sum(float(n or 1) * _UNITS[u] for n, u in parts))
    if total <= 0:
        raise ValueError(f"not a positive frequency: {freq!r}")
    return total


def ntz(value: datetime) -> Column:
    return F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ")))


def seconds(micros: int | Column) -> Column:
    """An interval of so many microseconds."""
    micros = F.lit(micros) if isinstance(micros, int) else micros
    return F.make_dt_interval(secs=(micros.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


_SMOOTH: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "sum": F.sum, "min": F.min, "max": F.max}


def _skew(c: Column) -> Column:
    """Skewness with the correction for samples: null below three values, 0 without spread."""
    n = F.count(c)
    return F.when(n > 2, F.when(F.var_pop(c) == 0, 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)))


def _kurt(c: Column) -> Column:
    """Excess kurtosis with the correction for samples: null below four values, 0 without spread."""
    n = F.count(c)
    return F.when(n > 3, F.when(F.var_pop(c) == 0, 0.0).otherwise(((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3))))


_REBIN: dict[str, Callable[[Column], Column]] = {
    **_SMOOTH, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)), "skew": _skew, "kurt": _kurt, "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "nunique": F.count_distinct, "size": lambda c: F.count(F.lit(1)), "any": lambda c: F.coalesce(F.bool_or(c != 0), F.lit(False)), "all": lambda c: F.coalesce(F.bool_and(c != 0), F.lit(True)),
}
#: What a bucket without rows has; the others have nothing.
_EMPTY: dict[str, object] = {"sum": 0, "count": 0, "nunique": 0, "size": 0, "prod": 1.0, "any": False, "all": True}
#: By time, whatever the order of the rows: nulls don't count.
_ENDS: dict[str, Callable[[Column, Column], Column]] = {"first": lambda c, ts: F.min_by(c, F.when(c.isNotNull(), ts)), "last": lambda c, ts: F.max_by(c, F.when(c.isNotNull(), ts))}


class Series1D:
    """A DataFrame with a time column, value columns and one flag column for each activity.

    The first value column is the total. ``by`` names columns that tell several
    series apart. Every operation gives a new object; only ``rebin`` reads the
    span of time and ``smooth`` counts rows when they are called, all else is
    computed when rows are asked for.
    """

    def __init__(self, df: DataFrame, meta: SeriesMeta | None = None, ts: str = "ts", values: Sequence[str] = ("total_conc",), by: Sequence[str] = (), original: DataFrame | None = None, extra: DataFrame | None = None):
        self.df, self.meta, self.ts, self.values, self.by = df, meta or SeriesMeta(), ts, tuple(values), tuple(by)
        self.original_data = df if original is None else original
        self.extra_data = extra

    @classmethod
    def from_df(cls, df: DataFrame, ts: str | None = None, values: Sequence[str] | None = None, meta: SeriesMeta | None = None, by: Sequence[str] = (), total: str | None = None) -> Series1D:
        """Take a table; the first column is the time unless named, NaN becomes null, ``total`` is renamed to total_conc."""
        ts = ts or df.columns[0]
        values = list(values or [c for c in df.columns if c != ts and c not in by])
        named = {c: "total_conc" if c == total else c for c in values}
        kinds = dict(df.dtypes)
        clean = [no_nan(F.col(c)).alias(named[c]) if kinds[c] in ("double", "float") else F.col(c).alias(named[c]) for c in values]
        return cls(df.select(F.col(ts).cast("timestamp_ntz").alias("ts"), *clean, *by), meta, "ts", [named[c] for c in values], by)

    def _with(self, df: DataFrame, **changes) -> Series1D:
        made = object.__new__(type(self))
        made.__dict__.update(self.__dict__, df=df, **changes)
        return made

    # Accessors

    @property
    def data(self) -> DataFrame:
        return self.df

    @property
    def time(self) -> DataFrame:
        return self.df.select(self.ts)

    @property
    def total_concentration(self) -> DataFrame:
        return self.df.select(*self.by, self.ts, self.total)

    @property
    def total(self) -> str:
        return "total_conc" if "total_conc" in self.values else self.values[0]

    @property
    def metadata(self) -> SeriesMeta:
        return self.meta

    @property
    def activities(self) -> list[str]:
        return [ALL_DATA, *(a.name for a in self.meta.activities)]

    @property
    def activity_periods(self) -> dict[str, list[tuple[datetime, datetime]]]:
        """Periods by activity; that of all data is read from the rows."""
        first = self.df.agg(F.min(self.ts).alias("a"), F.max(self.ts).alias("b")).first()
        return {ALL_DATA: [(first.a, first.b)]} | {a.name: list(a.periods) for a in self.meta.activities}

    @property
    def data_type(self) -> str | Mapping[str, str] | None:
        return self.meta.data_type or dict(self.meta.kinds) or None

    @property
    def unit(self) -> str | Mapping[str, str] | None:
        return self.meta.unit or dict(self.meta.units) or None

    @property
    def instrument(self) -> str | None:
        return self.meta.instrument

    @property
    def serial_number(self) -> str | None:
        return self.meta.serial_number

    def copy(self) -> Series1D:
        return self._with(self.df)

    def _flag(self, name: str) -> Column:
        if name == ALL_DATA:
            return F.lit(True)
        for a in self.meta.activities:
            if a.name == name:
                return F.col(f"`{a.column}`")
        raise ValueError(f"no activity {name!r}")

    # Rows

    def crop(self, start: str | datetime | None = None, end: str | datetime | None = None) -> Series1D:
        """Rows from start to end, both included."""
        df = self.df
        if start is not None:
            df = df.where(F.col(self.ts) >= ntz(moment_of_time(start)))
        if end is not None:
            df = df.where(F.col(self.ts) <= ntz(moment_of_time(end)))
        return self._with(df)

    def shift(self, seconds_: float = 0, minutes: float = 0, hours: float = 0) -> Series1D:
        """Move the times, and the activities' periods with them."""
        by = timedelta(seconds=seconds_, minutes=minutes, hours=hours)
        df = self.df.withColumn(self.ts, F.col(self.ts) + seconds(round(by / timedelta(microseconds=1))))
        return self._with(df, meta=replace(self.meta, activities=tuple(a.shifted(by) for a in self.meta.activities)))

    def drop_missing(self) -> Series1D:
        """Rows with all values."""
        return self._with(present(self.df, self.values))

    def _marked(self, df: DataFrame, new: list[Activity]) -> Series1D:
        names = {a.name for a in new}
        kept = tuple(a for a in self.meta.activities if a.name not in names)
        return self._with(df, meta=replace(self.meta, activities=(*kept, *new)))

    def mark(self, activities: Mapping[str, object], column: Callable[[str], str] = lambda name: f"act_{name}") -> Series1D:
        """Flag the rows inside any period of each activity; an activity marked before is replaced."""
        new = [Activity(name, periods(given), column(name)) for name, given in activities.items()]
        inside = lambda a: reduce(lambda x, y: x | y, (F.col(self.ts).between(ntz(s), ntz(e)) for s, e in a.periods), F.lit(False))
        return self._marked(self.df.withColumns({a.column: inside(a) for a in new}), new)

    def mark_from(self, name: str, table: DataFrame, start: str = "start", end: str = "end", column: str | None = None) -> Series1D:
        """Flag the rows inside any period of a table of many: merged by day, then an equi-join on days.

        Periods are cut at midnight, so that days need nothing of each other;
        inside a day those of one minute are united first, then those of the
        day, so that a row meets one at most.
        """
        column = column or f"act_{name}"
        given = table.select(F.col(start).cast("timestamp_ntz").alias("s"), F.col(end).cast("timestamp_ntz").alias("e")).where("s <= e")
        days = given.withColumn("day", F.explode(F.sequence(F.to_date("s"), F.to_date("e"))))
        dawn = F.col("day").cast("timestamp_ntz")
        days = days.select("day", F.greatest("s", dawn).alias("s"), F.least("e", dawn + F.expr("INTERVAL '1' DAY")).alias("e"))
        days = _united(_united(days.withColumn("minute", F.date_trunc("minute", F.col("s"))), "day", "minute"), "day")
        hit = self.df.withColumn("__day", F.to_date(self.ts)).join(days, (F.col("__day") == F.col("day")) & F.col(self.ts).between(F.col("s"), F.col("e")), "left")
        hit = hit.withColumn(column, F.col("s").isNotNull()).select(*[F.col(f"`{c}`") for c in self.df.columns if c != column], F.col(f"`{column}`"))
        return self._marked(hit, [Activity(name, (), column)])

    def select_activity(self, name: str) -> DataFrame:
        """Rows of an activity without the flag columns."""
        return self.df.where(self._flag(name)).drop(*(a.column for a in self.meta.activities))

    # Windows

    def smooth(self, window: int = 5, method: str = "mean", block_rows: int = BLOCK_ROWS) -> Series1D:
        """Centred rolling statistic over rows; for an even window the extra row lies before.

        Rows of one time follow by their values. Series of up to ``block_rows``
        rows, which are counted when this is called, are a block each; longer
        ones are numbered in order, cut into blocks that overlap by half a
        window, and rolled block by block. Windows of more than ``FRAME_ROWS``
        rows take time that doesn't grow with the window (the median's grows
        with its logarithm).
        """
        if method not in _SMOOTH:
            raise ValueError(f"unknown method {method!r}; one of {', '.join(_SMOOTH)}")
        if window < 1:
            raise ValueError("a window has at least one row")
        before, after = window // 2, (window - 1) // 2
        size = max(block_rows, window)
        columns = [F.col(f"`{c}`") for c in self.df.columns]
        whole = (self.df.groupBy(*self.by).count().agg(F.max("count")).first()[0] or 0) <= size
        if whole and window <= FRAME_ROWS:
            frame = Window.partitionBy(*self.by).orderBy(self.ts, *self.values).rowsBetween(-before, after)
            return self._with(self.df.withColumns({c: _SMOOTH[method](F.col(c)).over(frame) for c in self.values}))
        if whole:
            order = Window.partitionBy(*self.by).orderBy(self.ts, *self.values)
            spread = self.df.withColumn("__n", F.row_number().over(order) - 1).withColumn("__block", F.lit(0)).withColumn("__copy", F.lit(0))
        else:
            numbered = _numbered(self.df, self.ts, self.values, self.by).withColumn("__block", F.floor(F.col("__n") / size)).withColumn("__place", F.col("__n") % size)
            copies = F.filter(F.array(F.lit(0), F.when(F.col("__place") < after, F.lit(-1)), F.when(F.col("__place") >= size - before, F.lit(1))), lambda x: x.isNotNull())
            spread = numbered.withColumn("__copy", F.explode(copies)).withColumn("__block", F.col("__block") + F.col("__copy")).drop("__place")
        keys = [*self.by, "__block"]
        if window <= FRAME_ROWS:
            frame = Window.partitionBy(*keys).orderBy("__n").rowsBetween(-before, after)
            rolled = spread.withColumns({c: _SMOOTH[method](F.col(c)).over(frame) for c in self.values})
        elif method == "median":
            rolled = _rolling_median(spread, keys, self.values, window)
        else:
            rolled = _rolling(spread, keys, self.values, window, method)
        return self._with(rolled.where("__copy = 0").select(*columns))

    def rebin(self, freq: str | timedelta = "1s", method: str | Callable = "mean", fill_gaps: bool = True, most: int = MOST_BUCKETS, python: bool | None = None) -> Series1D:
        """Tumbling buckets from midnight of the first day; flags by any row.

        ``method`` is the name of an aggregate, or a function: from a column to
        an aggregate of it, or in Python from a pandas series of a bucket's
        values to a number (numpy's functions, and those that can't take a
        column, count as such unless ``python`` says). A bucket's values meet
        in one task for the latter.

        Empty buckets between the first and the last are kept with null values
        (0 for sums and counts, 1 for products) and no activity, unless
        ``fill_gaps`` is off; with ``by`` each series fills its own span. There
        are ``most`` buckets at most, of all series together.
        """
        step = microseconds(freq)
        how, in_python = self._reducer(method, python)
        span = self.df.agg(F.min(self.ts).alias("a"), F.max(self.ts).alias("b")).first()
        if span.a is None:
            return self._with(self.df.select(*self.by, self.ts, *[F.col(c).cast("double").alias(c) for c in self.values], *[F.col(f"`{a.column}`") for a in self.meta.activities]).limit(0))
        midnight = span.a.replace(hour=0, minute=0, second=0, microsecond=0)
        offset = round((midnight - datetime(1970, 1, 1)) / timedelta(microseconds=1)) % step
        flags = [a.column for a in self.meta.activities]
        bucket = F.window(self.ts, f"{step} microseconds", None, f"{offset} microseconds")
        placed = self.df.withColumn("__at", bucket["start"])
        groups = placed.groupBy(*self.by, F.col("__at").alias("__ts"))
        flagged = [F.bool_or(f"`{f}`").alias(f) for f in flags]
        if in_python:
            out = groups.agg(*(how(F.col(c).cast("double")).alias(c) for c in self.values))
            if flags:  # Python's and built-in aggregates can't be in one stage
                out = _null_safe_join(out, groups.agg(*flagged), [*self.by, "__ts"])
        else:
            out = groups.agg(*(how(F.col(c)).alias(c) for c in self.values), *flagged)
        out = out.select(*self.by, F.col("__ts").alias(self.ts), *self.values, *(F.col(f"`{f}`") for f in flags))
        empty = _EMPTY.get(method) if isinstance(method, str) else None
        if fill_gaps:
            grid = self._grid(out, span, midnight, step, most, freq)
            out = _null_safe_join(grid, out, [*self.by, self.ts])
            out = out.select(*self.by, self.ts, *(F.col(c) if empty is None else F.coalesce(c, F.lit(empty)).alias(c) for c in self.values), *(F.coalesce(F.col(f"`{f}`"), F.lit(False)).alias(f) for f in flags))
        return self._with(out)

    def _reducer(self, method: str | Callable, python: bool | None) -> tuple[Callable[[Column], Column], bool]:
        """An aggregate of a column, and whether Python computes it."""
        if isinstance(method, str):
            if method in _ENDS:
                return lambda c: _ENDS[method](c, F.col(self.ts)), False
            if method not in _REBIN:
                raise ValueError(f"unknown method {method!r}; one of {', '.join([*_REBIN, *_ENDS])}")
            return _REBIN[method], False
        if python is None:
            python = (getattr(method, "__module__", None) or "numpy").split(".")[0] in ("numpy", "pandas", "scipy", "statistics", "builtins", "math")
            if not python:
                try:
                    python = not isinstance(method(F.col(self.values[0])), Column)
                except Exception:  # it wants numbers, not a column
                    python = True
        if not python:
            return method, False

        def reduced(values: pd.Series) -> float:
            return float(method(values))

        import pandas as pd

        reduced.__annotations__ = {"values": pd.Series, "return": float}
        return F.pandas_udf(reduced, "double"), True

    def _grid(self, out: DataFrame, span: Row, midnight: datetime, step: int, most: int, freq: str | timedelta) -> DataFrame:
        """All buckets between the first and the last of each series, made from a distributed range or in pieces."""
        too_many = lambda n: ValueError(f"{n} buckets of {freq} between the first and the last row; at most {most}")
        first = midnight + timedelta(microseconds=((span.a - midnight) // timedelta(microseconds=1)) // step * step)
        if not self.by:
            n = (span.b - first) // timedelta(microseconds=1) // step + 1
            if n > most:
                raise too_many(n)
            return self.df.sparkSession.range(n).select((ntz(first) + seconds(F.col("id") * step)).alias(self.ts))
        spans = out.groupBy(*self.by).agg(F.min(self.ts).alias("__a"), F.max(self.ts).alias("__b"))
        spans = spans.withColumn("__buckets", F.floor(F.timestamp_diff("MICROSECOND", F.col("__a"), F.col("__b")) / step) + 1)
        n = spans.agg(F.sum("__buckets")).first()[0]
        if n > most:
            raise too_many(n)
        pieces = spans.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__buckets") - 1) / PIECE)))).repartition(*self.by, "__piece")
        last = F.least((F.col("__piece") + 1) * PIECE, F.col("__buckets")) - 1
        rows = pieces.withColumn("__k", F.explode(F.sequence(F.col("__piece") * PIECE, last)))
        return rows.select(*self.by, (F.col("__a") + seconds(F.col("__k") * step)).alias(self.ts))

    # Summaries

    def summarize(self, rounded: bool = True) -> DataFrame:
        """For each activity with rows: min, max, mean, std (n - 1) of the total, and its rows.

        One pass with a conditional aggregate for each activity, merged map-side.
        """
        v = F.col(self.total)
        parts = []
        for i, name in enumerate(self.activities):
            own = F.when(self._flag(name), v)
            parts.append(F.struct(F.lit(i).alias("seq"), F.lit(name).alias("segment"), F.min(own).alias("min"), F.max(own).alias("max"), F.avg(own).alias("mean"), F.stddev_samp(own).alias("std"), F.count_if(self._flag(name)).alias("n")))
        rows = self.df.agg(F.array(*parts).alias("rows")).select(F.inline("rows")).where("n > 0")
        show = (lambda c: F.bround(c, 3)) if rounded else F.col
        return rows.select("segment", *(show(c).alias(c) for c in ("min", "max", "mean", "std")), "n")

    # Views for drawing

    def total_series(self) -> DataFrame:
        return self.df.select(*self.by, self.ts, F.col(self.total).alias("total"))

    def activity_spans(self, which: bool | Sequence[str] = True) -> DataFrame:
        """Periods to shade: all activities but all data, or those named; unknown names are dropped."""
        wanted = [] if which is False else [a for a in self.meta.activities if which is True or a.name in which]
        rows = [(a.name, s, e) for a in wanted for s, e in a.periods]
        spark = self.df.sparkSession
        return spark.createDataFrame(rows, "activity string, start timestamp_ntz, end timestamp_ntz")

    def observed_spans(self, which: bool | Sequence[str] = True) -> DataFrame:
        """The same periods with the first and last time of the rows inside and their number (none: null and 0), in one pass."""
        wanted = [] if which is False else [a for a in self.meta.activities if which is True or a.name in which]
        parts = []
        for a in wanted:
            for start, end in a.periods:
                own = F.when(F.col(self.ts).between(ntz(start), ntz(end)), F.col(self.ts))
                parts.append(F.struct(F.lit(a.name).alias("activity"), ntz(start).alias("start"), ntz(end).alias("end"), F.min(own).alias("first"), F.max(own).alias("last"), F.count(own).alias("n")))
        if not parts:
            return self.df.sparkSession.createDataFrame([], "activity string, start timestamp_ntz, end timestamp_ntz, first timestamp_ntz, last timestamp_ntz, n long")
        return self.df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))

    # Several files

    def deduplicated(self, order: Sequence[str]) -> Series1D:
        """The first row of each time in the given order, by time."""
        return self._with(first_by_time(self.df, [*self.by, self.ts], order).orderBy(self.ts, *self.by))

    def ordered(self, order: Sequence[str]) -> Series1D:
        """All rows, by time; those of one time in the given order."""
        return self._with(self.df.orderBy(self.ts, *self.by, *order))


def present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with all of these. A condition for each column: Catalyst derives 2**n forms of one about n columns when they are renamed."""
    return df.where(reduce(lambda x, y: x & y, (F.col(f"`{c}`").isNotNull() for c in columns), F.lit(True)))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    renamed = right.select(*(F.col(k).alias(f"__right_{k}") for k in keys), *(F.col(f"`{c}`") for c in right.columns if c not in keys))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys))
    return left.join(renamed, same, "left").drop(*(f"__right_{k}" for k in keys))


def first_by_time(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")


def union(parts: Sequence[Series1D], check: Sequence[str] = ("serial_number",), overlapping: bool = False, keep_all: bool = False) -> Series1D:
    """All rows of series whose checked metadata equal the first one's; of rows with one time the earliest part's stays, or all (``keep_all``).

    Size distributions are brought to the first one's moment and normalisation.
    A bin is told by its edges, so bins of different sizes stay apart, null in
    the rows of parts without them; bins that overlap without being equal are
    an error unless ``overlapping``.
    """
    if not parts:
        raise ValueError("nothing to unite")
    first = parts[0]
    known = lambda p: [getattr(p.meta, c) if hasattr(p.meta, c) else p.meta.extra.get(c) for c in check]
    good = [p for p in parts if known(p) == known(first)]
    if first.meta.bins is not None:
        good = [_as_first(p, first.meta) for p in good]
        bins = common_bins((p.meta.bins for p in good), overlapping)
        first = first._with(first.df, meta=replace(first.meta, bins=bins), values=("total_conc", *bins.columns))
    else:
        bins = None
    join = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    rows = _stacked([(p.df.withColumn("__file", F.lit(i)).withColumn("__row", F.monotonically_increasing_id()), _renamed(p, bins)) for i, p in enumerate(good)])
    if bins is not None:
        rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in bins.columns), *bins.columns)
    out, order = first._with(rows), ["__file", "__row"]
    out = out.ordered(order) if keep_all else out.deduplicated(order)
    extra = [p.extra_data.withColumn("__file", F.lit(i)).withColumn("__row", F.monotonically_increasing_id()) for i, p in enumerate(good) if p.extra_data is not None]
    beside = join(extra) if extra else None
    if extra and not keep_all:
        beside = first_by_time(beside, [first.ts], order)
    return out._with(out.df.drop(*order), original_data=out.df.drop(*order), extra_data=beside and beside.drop(*order))


def _as_first(part: Series1D, meta: SeriesMeta) -> Series1D:
    """A size distribution with the moment and normalisation of ``meta``."""
    if part.meta.bins is None:
        raise ValueError("a series without a size distribution among some that have one")
    if (part.meta.moment, part.meta.scale) == (meta.moment, meta.scale):
        return part
    part = part.unnormalize().convert(meta.moment)
    if meta.scale is Scale.LINEAR:
        raise ValueError("a distribution by linear widths among others; unnormalize it first")
    return part.normalize() if meta.scale is Scale.LOG else part


def _renamed(part: Series1D, bins: Bins | None) -> dict[str, str]:
    """The part's bins, each with the column of ``bins`` with the same edges; none where they are the same."""
    if bins is None or part.meta.bins.spans == bins.spans:
        return {}
    column = dict(zip(bins.spans, bins.columns, strict=True))
    return {own: column[s] for s, own in zip(part.meta.bins.spans, part.meta.bins.columns, strict=True)}


def _stacked(frames: Sequence[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """All rows of frames, some of whose columns get other names; null where a frame hasn't a column.

    The new names come from the columns' places in the union. As aliases in a
    projection they would double, one by one, the forms that Catalyst derives
    of a total over them: 2**n forms for n bins.
    """
    held = [{names.get(c, c): c for c in df.columns} for df, names in frames]
    kinds = {new: df.schema[own].dataType for (df, _), columns in reversed([*zip(frames, held, strict=True)]) for new, own in columns.items()}
    order = list(dict.fromkeys(new for columns in held for new in columns))
    taken = [df.select(*(F.col(f"`{columns[c]}`") if c in columns else F.lit(None).cast(kinds[c]).alias(c) for c in order)) for (df, _), columns in zip(frames, held, strict=True)]
    named = next((k for k, df in enumerate(taken) if df.columns == order), None)
    first = frames[0][0].sparkSession.createDataFrame([], StructType([StructField(c, kinds[c]) for c in order])) if named is None else taken.pop(named)
    taken.insert(0, first)
    return reduce(DataFrame.union, taken)


def _united(periods: DataFrame, *keys: str) -> DataFrame:
    """Periods (s, e) of each key with those that overlap made one; the last key is dropped unless it is the only one."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    run = periods.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = run.withColumn("island", F.sum(F.when(F.col("reach") >= F.col("s"), 0).otherwise(1)).over(order))
    merged = run.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select(*(keys[:-1] or keys), "s", "e")


def _rolling(df: DataFrame, keys: Sequence[str], values: Sequence[str], window: int, method: str) -> DataFrame:
    """Sums, means and extremes of centred windows over ``__n`` (places without gaps), in linear time.

    Rows are cut into runs as long as the window. A window reaches from inside
    one run to inside the next, so it is what is left of the first and what has
    come of the second: running aggregates from either end of a run, fetched
    from the window's ends. Nothing is subtracted, so no digits are lost.
    """
    before, after = window // 2, (window - 1) // 2
    parts = {"sum": ("sum",), "mean": ("sum", "count"), "min": ("min",), "max": ("max",)}[method]
    whole = Window.unboundedPreceding, Window.currentRow
    run = Window.partitionBy(*keys, "__run")
    come, left = run.orderBy("__n").rowsBetween(*whole), run.orderBy(F.desc("__n")).rowsBetween(*whole)
    named = [(i, c, p) for i, c in enumerate(values) for p in parts]
    one = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    df = df.withColumn("__run", F.floor(F.col("__n") / window))
    df = df.withColumns({f"__{p}_left_{i}": one[p](F.col(f"`{c}`")).over(left) for i, c, p in named})
    df = df.withColumns({f"__{p}_come_{i}": one[p](F.col(f"`{c}`")).over(come) for i, c, p in named})
    place = Window.partitionBy(*keys).orderBy("__run", "__n")
    every = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"__first": F.first("__n").over(every), "__last": F.last("__n").over(every), "__lead": F.lead(F.lit(True), after).over(place) if after else F.lit(True)}
    for i, _, p in named:
        ends[f"__{p}_left_{i}"] = F.lag(f"__{p}_left_{i}", before).over(place)
        ends[f"__{p}_next_{i}"] = F.lead(f"__{p}_come_{i}", after).over(place) if after else F.col(f"__{p}_come_{i}")
        ends[f"__{p}_end_{i}"] = F.last(f"__{p}_come_{i}").over(every)
    df = df.withColumns(ends)
    start, end = F.col("__n") - before, F.least(F.col("__n") + after, F.col("__last"))
    alone = F.floor(start / window) == F.floor(end / window)

    def met(i: int, p: str) -> Column:
        far = F.when(F.col("__lead"), F.col(f"__{p}_next_{i}")).otherwise(F.col(f"__{p}_end_{i}"))
        near = F.col(f"__{p}_left_{i}")
        both = {"min": F.least, "max": F.greatest}.get(p, lambda a, b: F.coalesce(a + b, a, b))(near, far)
        return F.when(start < F.col("__first"), far).when(alone, near).otherwise(both)

    shown = lambda i: F.when(met(i, "count") > 0, met(i, "sum") / met(i, "count")) if method == "mean" else met(i, method)
    return df.withColumns({c: shown(i) for i, c in enumerate(values)})


def _rolling_median(df: DataFrame, keys: Sequence[str], values: Sequence[str], window: int) -> DataFrame:
    """Medians of centred windows over ``__n``, block by block: pandas keeps a window's values in an indexable skip list."""
    after = (window - 1) // 2
    df = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in values})
    names = list(values)

    def rolled(table: pa.Table) -> pa.Table:
        import pandas as pd

        table = table.take(pa.array(np.argsort(table.column("__n").to_numpy(), kind="stable")))
        for c in names:
            at = table.schema.get_field_index(c)
            own = np.concatenate([table.column(at).to_numpy(zero_copy_only=False).astype(float), np.full(after, np.nan)])
            found = pd.Series(own).rolling(window, min_periods=1).median().to_numpy()[after:]
            table = table.set_column(at, table.schema.field(at), pa.chunked_array([pa.array(found, mask=np.isnan(found))]))
        return table

    return df.groupBy(*keys).applyInArrow(rolled, df.schema)


def _numbered(df: DataFrame, ts: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``__n``, their place in the time order of their series: counts of days and minutes, then places inside a minute.

    Rows of one time follow by their values, so that reruns agree.
    """
    minute = F.date_trunc("minute", F.col(ts))
    counts = df.groupBy(*by, minute.alias("__minute")).agg(F.count("*").alias("__rows")).withColumn("__day", F.to_date("__minute"))
    earlier = lambda order: F.coalesce(F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = [F.col(c).alias(f"__{c}") for c in by]
    same = lambda a, b: reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"__{c}")), by, F.col(a).eqNullSafe(F.col(b)))
    days = counts.groupBy(*by, "__day").agg(F.sum("__rows").alias("__rows")).select(*shown, F.col("__day").alias("__of"), earlier(Window.partitionBy(*by).orderBy("__day")).alias("__before"))
    inner = counts.withColumn("__inner", earlier(Window.partitionBy(*by, "__day").orderBy("__minute")))
    base = inner.join(days, same("__day", "__of")).select(*shown, F.col("__minute").alias("__at"), (F.col("__inner") + F.col("__before")).alias("__base"))
    order = Window.partitionBy(*by, "__minute").orderBy(ts, *values)
    placed = df.withColumn("__minute", minute).withColumn("__in", F.row_number().over(order))
    return placed.join(base, same("__minute", "__at")).withColumn("__n", F.col("__base") + F.col("__in") - 1).drop("__minute", "__at", "__in", "__base", *(f"__{c}" for c in by))
