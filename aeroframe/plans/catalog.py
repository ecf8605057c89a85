"""All registered queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.functions.physics import PM_CUTS
from aeroframe.operators.series import Series1D, union
from aeroframe.plans.exports import EXPORTS, expected, loaded, other_bins, other_bins_sql
from aeroframe.plans.fixtures import ACTIVITIES, BINS, EDGES, FINE_BINS, events, s1, s2, s2_marked, s2d, s2m
from aeroframe.session import shared_root
from aeroframe.streaming.adapters import deduplicate_stream, rebin_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
N = len(BINS.mids)
COLUMNS = BINS.columns


def _register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


# Pieces of SQL

S1 = "s1 AS (SELECT ts, value AS total_conc FROM events)"


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _counted(width: str) -> str:
    bins = ", ".join(f"count(*) FILTER (value * 25 >= {a} AND value * 25 < {b})::DOUBLE AS {c}" for c, a, b in zip(COLUMNS, EDGES[:-1], EDGES[1:], strict=True))
    return f"s2 AS (SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS ts, {bins} FROM events GROUP BY 1)"


S2, S2M = _counted("1 hour"), _counted("10 minutes")


def _inside(name: str) -> str:
    given = ACTIVITIES[name]
    pairs = [given] if isinstance(given, tuple) else given
    return "(" + " OR ".join(f"ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in pairs) + ")"


def _segments(table: str, columns: str) -> str:
    """Rows of a table once for each activity that they are in."""
    return " UNION ALL ".join(f"SELECT '{name}' AS segment, {columns} FROM {table}" + ("" if name == "All data" else f" WHERE {_inside(name)}") for name in ("All data", *ACTIVITIES))


def _sum(columns: list[str], factors: list[float] | None = None) -> str:
    return " + ".join(f"{c} * {_number(k)}" if factors else c for c, k in zip(columns, factors or columns, strict=True))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Time series

for _name, _a, _b in (("crop_both", "2024-01-05", "2024-01-12 12:00:00"), ("crop_start_only", "2024-01-20", None), ("crop_end_only", None, "2024-01-03 06:00:00")):
    _where = " AND ".join(([f"ts >= TIMESTAMP '{_a}'"] if _a else []) + ([f"ts <= TIMESTAMP '{_b}'"] if _b else []))
    _register(_name, lambda spark, d, a=_a, b=_b: s1(spark, d).crop(a, b).df, f"WITH {S1} SELECT * FROM s1 WHERE {_where}")

_register("shift_forward", lambda spark, d: s1(spark, d).shift(seconds_=30, minutes=15, hours=2).df, f"WITH {S1} SELECT ts + INTERVAL '8130 seconds' AS ts, total_conc FROM s1")
_register("shift_negative_fractional", lambda spark, d: s1(spark, d).shift(seconds_=-0.25, hours=-1.5).df, f"WITH {S1} SELECT ts - INTERVAL '5400250 milliseconds' AS ts, total_conc FROM s1")


def _flags(names: tuple[str, ...]) -> Query:
    return lambda spark, d: s1(spark, d).mark({n: ACTIVITIES[n] for n in names}, column=lambda n: n.lower()).df


for _name, _marks in (("mark_flags", ("Background", "Decay", "Nothing")), ("mark_multi_period", ("Emission",)), ("mark_overlap", ("Emission", "Overlap"))):
    _register(_name, _flags(_marks), f"WITH {S1} SELECT *, " + ", ".join(f"{_inside(m)} AS {m.lower()}" for m in _marks) + " FROM s1")

_PERIODS = [(f"2024-01-{day:02d} {hour:02d}:00:00", f"2024-01-{day:02d} {hour + 1:02d}:30:00") for day in range(2, 29, 2) for hour in (3, 4, 17)]


def _mark_range_join(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([(datetime.fromisoformat(a), datetime.fromisoformat(b)) for a, b in _PERIODS], "start timestamp_ntz, end timestamp_ntz")
    return s1(spark, d).mark_from("shift", table, column="busy").df


_register("mark_range_join", _mark_range_join, f"WITH {S1}, p(a, b) AS (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in _PERIODS) + ") SELECT *, EXISTS (SELECT 1 FROM p WHERE ts BETWEEN a AND b) AS busy FROM s1")
_register("activity_select", lambda spark, d: s1(spark, d).mark(ACTIVITIES).select_activity("Emission"), f"WITH {S1} SELECT * FROM s1 WHERE {_inside('Emission')}")

_SQL_AGG = {"mean": "avg", "median": "median", "sum": "sum", "min": "min", "max": "max", "count": "count", "std": "stddev_samp", "var": "var_samp"}
for _method, _w in (("mean", 5), ("median", 5), ("sum", 4), ("min", 3), ("max", 6)):
    _register(
        f"smooth_{_method}{_w}", lambda spark, d, m=_method, w=_w: _rounded(s1(spark, d).smooth(w, m, block_rows=20_000).df),
        f"WITH {S1} SELECT ts, round({_SQL_AGG[_method]}(total_conc) OVER (ORDER BY ts ROWS BETWEEN {_w // 2} PRECEDING AND {(_w - 1) // 2} FOLLOWING), 9) AS total_conc FROM s1",
    )

#: Added before means are rounded, as a mean of decimals may lie just on the middle between two.
_OFF = 1.234567e-7
for _method, _w, _rows in (("mean", 3600, 4000), ("sum", 101, 1500), ("median", 601, 2000), ("min", 500, 1000), ("max", 1441, 3000)):
    _register(
        f"smooth_{_method}{_w}_blocks", lambda spark, d, m=_method, w=_w, r=_rows: s1(spark, d).smooth(w, m, block_rows=r).df.select("ts", F.round(F.col("total_conc") + _OFF, 6).alias("total_conc")),
        f"WITH {S1} SELECT ts, round({_SQL_AGG[_method]}(total_conc) OVER (ORDER BY ts, total_conc ROWS BETWEEN {_w // 2} PRECEDING AND {(_w - 1) // 2} FOLLOWING) + {_number(_OFF)}, 6) AS total_conc FROM s1",
    )


def _multi_series(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).select("ts", F.col("value").alias("total_conc"), "user_id")
    return _rounded(Series1D.from_df(df, "ts", ["total_conc"], by=["user_id"]).smooth(5, "mean").df)


_register("multi_series_smooth", _multi_series, "SELECT ts, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS total_conc FROM events")


def _rebin_sql(source: str, interval: str, method: str, gaps: bool = True, zero: bool = False) -> str:
    agg = f"{_SQL_AGG[method]}(total_conc)"
    value = f"round(coalesce({agg}, 0), 9)" if zero else f"round({agg}, 9)"
    origin = "(SELECT date_trunc('day', min(ts)) FROM s)"
    bucket = f"time_bucket(INTERVAL '{interval}', ts, {origin})"
    if not gaps:
        return f"WITH {S1}, s AS ({source}) SELECT {bucket} AS ts, {value} AS total_conc FROM s GROUP BY 1"
    return f"""WITH {S1}, s AS ({source}), b AS (SELECT {bucket} AS slot, total_conc FROM s), g AS (
      SELECT unnest(generate_series((SELECT min(slot) FROM b), (SELECT max(slot) FROM b), INTERVAL '{interval}')) AS ts)
      SELECT g.ts, {value} AS total_conc FROM g LEFT JOIN b ON b.slot = g.ts GROUP BY 1"""


for _name, _freq, _interval, _method, _crop, _zero in (
    ("rebin_hour_mean", "1H", "1 hour", "mean", None, False), ("rebin_10min_sum_gaps", "10min", "10 minutes", "sum", None, True), ("rebin_150min_median", "2.5h", "150 minutes", "median", None, False),
    ("rebin_7h_max", "7h", "7 hours", "max", None, False), ("rebin_1h30_std", "1h30min", "90 minutes", "std", None, False), ("rebin_4h_var", "4h", "4 hours", "var", None, False),
    ("rebin_1s_count", "s", "1 second", "count", None, True),
):
    _source = "SELECT * FROM s1" + (f" WHERE ts BETWEEN TIMESTAMP '{_crop[0]}' AND TIMESTAMP '{_crop[1]}'" if _crop else "")
    _register(_name, lambda spark, d, f=_freq, m=_method, c=_crop: _rounded((s1(spark, d).crop(*c) if c else s1(spark, d)).rebin(f, m).df), _rebin_sql(_source, _interval, _method, zero=_zero))

_MORE_AGG = {"skew": "skewness(total_conc)", "kurt": "kurtosis(total_conc)", "sem": "stddev_samp(total_conc) / sqrt(count(total_conc))", "nunique": "count(DISTINCT total_conc)", "size": "count(total_conc)", "ptp": "max(total_conc) - min(total_conc)", "prod": "product(1 + total_conc / 100000)"}
for _method in ("skew", "kurt", "sem", "nunique"):
    _register(f"rebin_6h_{_method}", lambda spark, d, m=_method: _rounded(s1(spark, d).rebin("6h", m).df, 6), _rebin_sql("SELECT * FROM s1", "6 hours", "max", zero=_method == "nunique").replace("max(total_conc)", _MORE_AGG[_method]).replace(", 9)", ", 6)"))


def _scaled(spark: SparkSession, d: str) -> Series1D:
    s = s1(spark, d)
    return s._with(s.df.withColumn("total_conc", 1 + F.col("total_conc") / 100_000))


_register("rebin_6h_prod", lambda spark, d: _rounded(_scaled(spark, d).rebin("6h", "prod").df, 6), _rebin_sql("SELECT * FROM s1", "6 hours", "max").replace("max(total_conc)", f"coalesce({_MORE_AGG['prod']}, 1)").replace(", 9)", ", 6)"))
_register(
    "rebin_6h_python", lambda spark, d: _rounded(s1(spark, d).mark({"Emission": ACTIVITIES["Emission"]}, column=lambda n: n.lower()).rebin("6h", np.ptp).df),
    f"""WITH {S1}, b AS (SELECT time_bucket(INTERVAL '6 hours', ts, (SELECT date_trunc('day', min(ts)) FROM s1)) AS slot, total_conc, {_inside('Emission')} AS em FROM s1),
    g AS (SELECT unnest(generate_series((SELECT min(slot) FROM b), (SELECT max(slot) FROM b), INTERVAL '6 hours')) AS ts)
    SELECT g.ts, round({_MORE_AGG['ptp']}, 9) AS total_conc, coalesce(bool_or(em), false) AS emission FROM g LEFT JOIN b ON b.slot = g.ts GROUP BY 1""",
)


def _series_rebinned(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).select("ts", F.col("value").alias("total_conc"), F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 5).cast("string")).alias("who"))
    return _rounded(Series1D.from_df(df, "ts", ["total_conc"], by=["who"]).rebin("20min", "sum").df, 6)


_register(
    "rebin_by_series", _series_rebinned,
    """WITH s AS (SELECT ts, value, CASE WHEN user_id % 5 <> 0 THEN (user_id % 5)::VARCHAR END AS who FROM events), b AS (SELECT who, value, time_bucket(INTERVAL '20 minutes', ts, (SELECT date_trunc('day', min(ts)) FROM s)) AS slot FROM s),
    g AS (SELECT who, unnest(generate_series(min(slot), max(slot), INTERVAL '20 minutes')) AS ts FROM b GROUP BY who)
    SELECT g.who, g.ts, round(coalesce(sum(value), 0), 6) AS total_conc FROM g LEFT JOIN b ON b.slot = g.ts AND b.who IS NOT DISTINCT FROM g.who GROUP BY ALL""",
)

_register("rebin_1s_count_small", lambda spark, d: s1(spark, d).rebin("s", "count", fill_gaps=False).df, _rebin_sql("SELECT * FROM s1", "1 second", "count", gaps=False))
for _end, _way in (("first", "ASC"), ("last", "DESC")):
    _register(f"rebin_3h_{_end}", lambda spark, d, m=_end: s1(spark, d).rebin("3h", m, fill_gaps=False).df, f"WITH {S1} SELECT time_bucket(INTERVAL '3 hours', ts, (SELECT date_trunc('day', min(ts)) FROM s1)) AS ts, total_conc FROM s1 QUALIFY row_number() OVER (PARTITION BY 1 + epoch_us(time_bucket(INTERVAL '3 hours', ts, (SELECT date_trunc('day', min(ts)) FROM s1))) ORDER BY s1.ts {_way}) = 1")
_register("rebin_no_gaps_min", lambda spark, d: s1(spark, d).rebin("5min", "min", fill_gaps=False).df, _rebin_sql("SELECT * FROM s1", "5 minutes", "min", gaps=False))
_register("rebin_custom_range", lambda spark, d: _rounded(s1(spark, d).rebin("6h", lambda c: F.max(c) - F.min(c)).df), _rebin_sql("SELECT * FROM s1", "6 hours", "max").replace("max(total_conc)", "max(total_conc) - min(total_conc)"))
_register(
    "rebin_flags", lambda spark, d: _rounded(s1(spark, d).mark({n: ACTIVITIES[n] for n in ("Background", "Emission")}, column=lambda n: n.lower()).rebin("10min", "mean").df),
    f"""WITH {S1}, b AS (SELECT time_bucket(INTERVAL '10 minutes', ts, (SELECT date_trunc('day', min(ts)) FROM s1)) AS slot, total_conc, {_inside('Background')} AS bg, {_inside('Emission')} AS em FROM s1),
    g AS (SELECT unnest(generate_series((SELECT min(slot) FROM b), (SELECT max(slot) FROM b), INTERVAL '10 minutes')) AS ts)
    SELECT g.ts, round(avg(total_conc), 9) AS total_conc, coalesce(bool_or(bg), false) AS background, coalesce(bool_or(em), false) AS emission FROM g LEFT JOIN b ON b.slot = g.ts GROUP BY 1""",
)

_SUMMARY_1D = "min(total_conc) AS min, max(total_conc) AS max, avg(total_conc) AS mean, stddev_samp(total_conc) AS std, count(*) AS n"
_register("summary_1d", lambda spark, d: _rounded(s1(spark, d).mark(ACTIVITIES).summarize(rounded=False), 8), f"WITH {S1}, x AS ({_segments('s1', 'total_conc')}) SELECT segment, round(min, 8) AS min, round(max, 8) AS max, round(mean, 8) AS mean, round(std, 8) AS std, n FROM (SELECT segment, {_SUMMARY_1D} FROM x GROUP BY segment)")
_register("summary_1d_rounded", lambda spark, d: s1(spark, d).mark(ACTIVITIES).summarize(), f"WITH {S1}, x AS ({_segments('s1', 'total_conc')}) SELECT segment, round_even(min, 3) AS min, round_even(max, 3) AS max, round_even(mean, 3) AS mean, round_even(std, 3) AS std, n FROM (SELECT segment, {_SUMMARY_1D} FROM x GROUP BY segment)")
_register(
    "activity_spans", lambda spark, d: s1(spark, d).mark(ACTIVITIES).observed_spans(["Emission", "Decay", "Nothing", "unheard of"]),
    f"""WITH {S1}, spans(activity, start, "end") AS (VALUES {', '.join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n in ("Emission", "Decay", "Nothing") for a, b in ([ACTIVITIES[n]] if isinstance(ACTIVITIES[n], tuple) else ACTIVITIES[n]))})
    SELECT activity, start, "end", min(ts) AS first, max(ts) AS last, count(ts) AS n FROM spans LEFT JOIN s1 ON ts BETWEEN start AND "end" GROUP BY ALL""",
)
_register("total_series", lambda spark, d: s1(spark, d).total_series(), "SELECT ts, value AS total FROM events")


# Several files

def _files(spark: SparkSession, d: str) -> list[Series1D]:
    from dataclasses import replace

    df = events(spark, d)
    out = []
    for k, where in enumerate(("event_id % 2 = 0", "event_id % 3 = 0", "true")):
        part = df.where(where).select("ts", (F.col("value") * (k + 1)).alias("total_conc"))
        made = Series1D.from_df(part, "ts", ["total_conc"])
        out.append(made._with(made.df, meta=replace(made.meta, serial_number="A" if k != 1 else "B")))
    return out


_S3 = "s3 AS (SELECT 0 AS f, ts, value AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, ts, value * 2 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 2, ts, value * 3 FROM events)"
_register("folder_union", lambda spark, d: union(_files(spark, d), check=()).df, f"WITH {_S3} SELECT ts, v AS total_conc FROM s3 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY f) = 1")
_register("folder_union_meta_gate", lambda spark, d: union(_files(spark, d)).df, f"WITH {_S3} SELECT ts, v AS total_conc FROM s3 WHERE f <> 1 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY f) = 1")
_register(
    "dedupe_keep_first", lambda spark, d: Series1D.from_df(events(spark, d).select(F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("ts"), F.col("value").alias("total_conc"), "event_id"), "ts", ["total_conc", "event_id"]).deduplicated(["event_id"]).df,
    "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, value AS total_conc, event_id FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) = 1",
)

# Size distributions


def _kappa(moment: str, density: float = 1.0) -> list[float]:
    out = []
    for m in BINS.mids:
        r = m / 2
        out.append({"dN": 1.0, "dS": 4 * math.pi * r * r, "dV": 4 / 3 * math.pi * r**3, "dW": 4 / 3 * math.pi * r**3 * density * 1e-9}[moment])
    return out


def _bins_sql(factors: list[float], source: str = S2, total: list[float] | None = None, digits: int = 6) -> str:
    """Bins times factors and their sum (times the widths, where they are normalised)."""
    scaled = ", ".join(f"round({c} * {_number(k)}, {digits}) AS {c}" for c, k in zip(COLUMNS, factors, strict=True))
    whole = _sum(COLUMNS, total or factors)
    return f"WITH {source} SELECT ts, round({whole}, {digits}) AS total_conc, {scaled} FROM s2"


_ONES = [1.0] * N
_LOG = [math.log10(b / a) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)]
_INVERSE = [1 / w for w in _LOG]
_register("psd_base", lambda spark, d: s2(spark, d).df, _bins_sql(_ONES))
_register("row_total", lambda spark, d: s2(spark, d).total_concentration, f"WITH {S2} SELECT ts, {_sum(COLUMNS)} AS total_conc FROM s2")
_register("size_data", lambda spark, d: s2m(spark, d).size_data, f"WITH {S2M} SELECT * FROM s2")
_register("normalize", lambda spark, d: _rounded(s2(spark, d).normalize().df, 6), _bins_sql(_INVERSE, total=_ONES))
_register("unnormalize_roundtrip", lambda spark, d: _rounded(s2(spark, d).normalize().normalize().unnormalize().unnormalize().df, 6), _bins_sql(_ONES))
for _to in ("dS", "dV", "dW"):
    _register(f"convert_n_to_{_to[1].lower()}", lambda spark, d, to=_to: _rounded(s2(spark, d).convert(to).df, 2), _bins_sql(_kappa(_to), digits=2))
for _from, _to in (("dV", "dS"), ("dV", "dW"), ("dW", "dN"), ("dW", "dV"), ("dS", "dN"), ("dS", "dV")):
    _register(f"convert_{_from[1].lower()}_to_{_to[1].lower()}", lambda spark, d, a=_from, b=_to: _rounded(s2(spark, d).with_density(1.6).convert(a).convert(b).df, 2), _bins_sql(_kappa(_to, 1.6), digits=2))
_register("convert_v_to_n", lambda spark, d: _rounded(s2(spark, d).convert("dV").convert("dN").df, 6), _bins_sql(_ONES))
_register("convert_w_to_s", lambda spark, d: _rounded(s2(spark, d).convert("dW").convert("dS").df, 2), _bins_sql(_kappa("dS"), digits=2))
_register("convert_s_to_w", lambda spark, d: _rounded(s2(spark, d).with_density(1.6).convert("dS").convert("dW").df, 4), _bins_sql(_kappa("dW", 1.6), digits=4))
_register("convert_normalized_keeps_state", lambda spark, d: _rounded(s2(spark, d).normalize().convert("dV").df, 2), _bins_sql([k / w for k, w in zip(_kappa("dV"), _LOG, strict=True)], total=_kappa("dV"), digits=2))
_register("density_rescale", lambda spark, d: _rounded(s2(spark, d).convert("dW").with_density(2.5).df, 4), _bins_sql(_kappa("dW", 2.5), digits=4))


def _diffusion_sql(flow: float) -> str:
    """The losses' formulas over a table of bins."""
    bins = ", ".join(f"('{c}', {_number(m)})" for c, m in zip(COLUMNS, FINE_BINS.mids, strict=True))
    passed = {c: f"(SELECT e FROM passed WHERE b = '{c}')" for c in COLUMNS}
    scaled = ", ".join(f"round({c} / {e}, 6) AS {c}" for c, e in passed.items())
    return f"""WITH {S2}, bins(b, mid) AS (VALUES {bins}), p AS (
      SELECT 0.01::DOUBLE AS d, 2::DOUBLE AS l, {flow}::DOUBLE / 60000 AS q, 293::DOUBLE AS t, 101300::DOUBLE AS pr
    ), gas AS (SELECT *, q / (pi() / 4 * d * d) AS v, 66.5e-9::DOUBLE * (101000::DOUBLE / pr) * (t / 293.15::DOUBLE) * ((1 + 110 / 293.15::DOUBLE) / (1 + 110 / t)) AS mfp,
      1.708e-5::DOUBLE * pow(t / 273.15::DOUBLE, 1.5::DOUBLE) * (393.396::DOUBLE / (t + 120.246::DOUBLE)) AS eta, 1.293::DOUBLE * (273.15::DOUBLE / t) * (pr / 101300) AS rho FROM p
    ), kn AS (SELECT b, gas.*, mid * 1e-9::DOUBLE AS dp, 2 * mfp / (mid * 1e-9::DOUBLE) AS kn, rho * v * d / eta AS re FROM bins, gas
    ), dc AS (SELECT *, 1.380649e-23::DOUBLE * t * (1 + kn * (1.142::DOUBLE + 0.558::DOUBLE * exp(-0.999::DOUBLE / kn))) / (3 * pi() * eta * dp) AS dc FROM kn
    ), xi AS (SELECT *, pi() * dc * l / q AS xi, eta / (rho * dc) AS sc FROM dc
    ), passed AS (SELECT b, exp(-xi * CASE WHEN re < 2000 THEN 3.66::DOUBLE + 0.2672::DOUBLE / (xi + 0.10079::DOUBLE * pow(xi, 1::DOUBLE / 3)) ELSE 0.0118::DOUBLE * pow(re, 7::DOUBLE / 8) * pow(sc, 1::DOUBLE / 3) END) AS e FROM xi)
    SELECT ts, round({' + '.join(f'{c} / {e}' for c, e in passed.items())}, 6) AS total_conc, {scaled} FROM s2"""


_register("diffusion_laminar", lambda spark, d: _rounded(s2d(spark, d).correct_diffusion(0.01, 2, 1.5).df, 6), _diffusion_sql(1.5))
_register("diffusion_turbulent", lambda spark, d: _rounded(s2d(spark, d).correct_diffusion(0.01, 2, 60).df, 6), _diffusion_sql(60))


_PM = (("pm1", 1000), ("pm2_5", 2500), ("pm4", 4000), ("pm10", 10000))


def _metrics_sql(source: str = S2) -> str:
    mass = _kappa("dW")
    total = _sum(COLUMNS)
    parts = [f"{total} AS pnc"]
    parts += [" + ".join(f"{c} * {_number(m)} * greatest(0, least(1, ({cut}::DOUBLE - {a}) / ({b} - {a})))" for c, m, a, b in zip(COLUMNS, mass, EDGES[:-1], EDGES[1:], strict=True)) + f" AS {name}" for name, cut in _PM]
    parts.append(f"{_sum(COLUMNS, mass)} AS total_mass")
    best = f"greatest({', '.join(COLUMNS)})"
    parts.append(f"CASE WHEN {total} = 0 THEN NULL " + " ".join(f"WHEN {c} = {best} THEN {_number(m)}" for c, m in zip(COLUMNS, BINS.mids, strict=True)) + " END AS mode_dp")
    parts.append(f"CASE WHEN {total} = 0 THEN NULL " + " ".join(f"WHEN ({_sum(COLUMNS[: i + 1])}) / ({total}) >= 0.5 THEN {_number(m)}" for i, m in enumerate(BINS.mids)) + " END AS median_dp")
    parts.append(f"CASE WHEN {total} = 0 THEN NULL ELSE exp(({' + '.join(f'ln({_number(m)}) * {c}' for c, m in zip(COLUMNS, BINS.mids, strict=True))}) / ({total})) END AS gmd")
    return f"{source}, m AS (SELECT ts, {', '.join(parts)} FROM s2)"


_register("pm_fractions", lambda spark, d: _rounded(s2(spark, d).metrics().select("ts", *PM_CUTS, "total_mass"), 6), f"WITH {_metrics_sql()} SELECT ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*PM_CUTS, "total_mass")) + " FROM m")
for _metric in ("mode_dp", "median_dp", "gmd"):
    _register(_metric, lambda spark, d, m=_metric: _rounded(s2(spark, d).metrics().select("ts", m), 6), f"WITH {_metrics_sql()} SELECT ts, round({_metric}, 6) AS {_metric} FROM m")

_CONTENT, _SIZES = ("pnc", *PM_CUTS, "total_mass"), ("mode_dp", "median_dp", "gmd")


def _summary_sql(source: str, show: Callable[[str, str], str]) -> str:
    stats = ", ".join(f"{show(f'avg({m})', m)} AS {m}, {show(f'stddev_samp({m})' if m in _CONTENT else f'stddev_pop({m})', m)} AS {m}_std" for m in _CONTENT + _SIZES)
    return f"WITH {_metrics_sql(source)}, x AS ({_segments('m', '*')}) SELECT segment, {stats} FROM x GROUP BY segment"


_register("size_metrics_zero_total_skipped", lambda spark, d: _rounded(s2m(spark, d).mark(ACTIVITIES).summarize(rounded=False), 6), _summary_sql(S2M, lambda c, m: f"round({c}, 6)"))
_register("summary_2d", lambda spark, d: _rounded(s2_marked(spark, d).summarize(rounded=False), 6), _summary_sql(S2, lambda c, m: f"round({c}, 6)"))
_register("summary_2d_rounded", lambda spark, d: s2_marked(spark, d).summarize(), _summary_sql(S2, lambda c, m: f"round_even({c}, {2 if m in _CONTENT else 1})"))


def _psd_sql(factors: list[float]) -> str:
    rows = " UNION ALL ".join(f"SELECT segment AS activity, {i} AS bin_idx, {_number(m)} AS mid, avg({c} * {_number(k)}) AS mean, stddev_samp({c} * {_number(k)}) AS std FROM x GROUP BY segment" for i, (c, m, k) in enumerate(zip(COLUMNS, BINS.mids, factors, strict=True)))
    return f"WITH {S2}, x AS ({_segments('s2', '*')}), r AS ({rows}) SELECT activity, bin_idx, mid, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS lo, round(mean + std, 6) AS hi FROM r"


_register("psd_by_activity", lambda spark, d: _rounded(s2_marked(spark, d).psd(normalize=False), 6), _psd_sql(_ONES))
_register("psd_normalized", lambda spark, d: _rounded(s2_marked(spark, d).psd(), 6), _psd_sql(_INVERSE))


def _long_sql(value: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT ts, {i} AS bin_idx, {_number(m)} AS mid, {value.format(c)} AS value{extra.format(a=_number(a), b=_number(b))} FROM s2" for i, (c, m, a, b) in enumerate(zip(COLUMNS, BINS.mids, EDGES[:-1], EDGES[1:], strict=True)))


_register("heatmap_long", lambda spark, d: s2(spark, d).to_long(), f"WITH {S2} {_long_sql('{}')}")


def _heatmap(spark: SparkSession, d: str) -> DataFrame:
    cells, (low, high) = s2(spark, d).heatmap(low=1.0)
    return cells.withColumns({"z_low": F.lit(low), "z_high": F.lit(high)})


_register(
    "heatmap_clip_scale", _heatmap,
    f"""WITH {S2}, first AS (SELECT ts FROM s2 ORDER BY ts LIMIT 2), half AS (SELECT (max(ts) - min(ts)) / 2 AS h FROM first), top AS (SELECT max(greatest(1.0::DOUBLE, {', '.join(COLUMNS)})) AS z FROM s2)
    SELECT t.*, t.ts - h AS cell_start, t.ts + h AS cell_end, 1.0::DOUBLE AS z_low, z AS z_high FROM ({_long_sql('greatest({}, 1.0::DOUBLE)', ', {a} AS edge_low, {b} AS edge_high')}) t, half, top""",
)

# Formulas of the instruments


def _tem_window(spark: SparkSession, d: str) -> DataFrame:
    from aeroframe.sources.derive import sampled_volume

    df = events(spark, d).select("ts", (F.col("event_type") == "error").cast("long").alias("TEM"), (F.col("value") / 100).alias("Flow"))
    return _rounded(sampled_volume(df), 6)


_register(
    "tem_sample_window", _tem_window,
    """WITH t AS (SELECT ts, event_type = 'error' AS tem, value / 100 AS flow, lag((event_type = 'error')::INT) OVER (ORDER BY ts) AS before FROM events)
    SELECT min(ts) FILTER (tem) AS start, max(ts) FILTER (tem) AS "end", round(avg(flow) FILTER (tem) * 1000 * (epoch(max(ts) FILTER (tem)) - epoch(min(ts) FILTER (tem))) / 60, 6) AS sample_vol_ml,
    count(*) FILTER (tem) AS samples, count(*) FILTER (tem AND before = 0) AS rising_edges FROM t""",
)


def _opc(spark: SparkSession, d: str) -> DataFrame:
    from aeroframe.sources.derive import count_per_volume

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.round(count_per_volume(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 1000), 9).alias("conc"))


def _ops(spark: SparkSession, d: str) -> DataFrame:
    from aeroframe.sources.derive import count_with_deadtime

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.round(count_with_deadtime(F.col("l_quantity"), F.lit(60.0), F.col("l_discount") * 600), 9).alias("conc"))


_register("opc_counts_to_conc", _opc, "SELECT l_orderkey, l_linenumber, CASE WHEN (l_discount * 100) / 100 * ((l_tax * 1000) / 100) = 0 THEN NULL ELSE round(l_quantity / ((l_discount * 100) / 100 * ((l_tax * 1000) / 100)), 9) END AS conc FROM lineitem")
_register("ops_deadtime_conc", _ops, "SELECT l_orderkey, l_linenumber, CASE WHEN 60 - l_discount * 600 = 0 THEN NULL ELSE round(l_quantity / (16.67::DOUBLE * (60 - l_discount * 600)), 9) END AS conc FROM lineitem")


# Streams


def _streamed(spark: SparkSession, d: str, form: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All of events through a stream, to the end of what is there: what has come out by then."""
    table = events(spark, d)
    source = spark.readStream.schema(table.schema).parquet(f"{d}/events.parquet*")
    stream = form(source.select("ts", F.col("value").alias("total_conc"), "event_id"))
    folder = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _first_of_hour(source: DataFrame) -> DataFrame:
    return deduplicate_stream(source.withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")), "ts", "2 hours", ["event_id"])


#: Streams keep back what the watermark, the last time less the delay, hasn't passed.
_register(
    "stream_rebin_10min_sum", lambda spark, d: _rounded(_streamed(spark, d, lambda s: rebin_stream(s, "ts", ["total_conc"], "10min", "sum", "3 hours")), 6),
    "SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS ts, round(sum(value), 6) AS total_conc FROM events GROUP BY 1 HAVING time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') + INTERVAL '10 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '3 hours'",
)
_register(
    "stream_keep_first", lambda spark, d: _streamed(spark, d, _first_of_hour),
    "WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, value AS total_conc, event_id FROM events) SELECT * FROM h WHERE ts <= (SELECT max(ts) FROM h) - INTERVAL '2 hours' QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1",
)

# Loading

for _dialect in EXPORTS:
    _register(f"load_{_dialect}", lambda spark, d, x=_dialect: loaded(spark, d, x), expected(_dialect))
_register("folder_union_other_bins", other_bins, other_bins_sql())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
