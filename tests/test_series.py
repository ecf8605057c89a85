import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroframe.functions import physics
from aeroframe.model import Activity, Bins, Moment, Scale, SeriesMeta, data_type, periods
from aeroframe.operators.series import Series1D, microseconds, union
from aeroframe.operators.sizes import Series2D

START = datetime(2024, 3, 1, 10, 0, 0)
BINS = Bins.arithmetic((100.0, 300.0, 600.0, 1500.0, 3000.0))


def series(spark, values, step=60, start=START):
    rows = [(start + timedelta(seconds=step * i), None if v is None else float(v)) for i, v in enumerate(values)]
    return Series1D.from_df(spark.createDataFrame(rows, "ts timestamp_ntz, total_conc double"))


def sizes(spark, rows, **meta):
    data = [(START + timedelta(seconds=60 * i), *map(lambda x: None if x is None else float(x), r)) for i, r in enumerate(rows)]
    columns = ", ".join(f"b{k} double" for k in range(4))
    return Series2D.from_bins(spark.createDataFrame(data, f"ts timestamp_ntz, {columns}"), BINS, [f"b{k}" for k in range(4)], SeriesMeta(moment=Moment.NUMBER, **meta))


def values(s, column="total_conc"):
    return [r[column] for r in s.df.orderBy("ts").collect()]


def test_text_times_and_nan(spark):
    df = spark.createDataFrame([("2024-03-01 10:00:00", float("nan")), ("2024-03-01 10:01:00", 2.0)], "t string, v double")
    s = Series1D.from_df(df, total="v")
    assert dict(s.df.dtypes) == {"ts": "timestamp_ntz", "total_conc": "double"} and values(s) == [None, 2.0]
    assert s.original_data.count() == 2 and s.copy().df.count() == 2 and s.drop_missing().df.count() == 1


def test_crop_is_inclusive_and_keeps_periods(spark):  # T10
    s = series(spark, range(10)).mark({"a": ("2024/03/01 10:01:00", "2024/03/01 10:08:00")})
    c = s.crop("2024-03-01 10:02:00", "2024-03-01 10:04:00")
    assert values(c) == [2, 3, 4] and c.meta.activities == s.meta.activities
    assert values(s.crop(end=START)) == [0] and len(values(s.crop())) == 10


def test_shift_moves_periods(spark):  # T10
    s = series(spark, [1]).mark({"a": ("2024-03-01 10:00:00", "2024-03-01 10:00:30")}).shift(seconds_=0.5, minutes=-1, hours=1)
    moved = START + timedelta(seconds=3540.5)
    assert s.df.first().ts == moved and s.meta.activities[0].periods[0][0] == moved


def test_crop_and_shift_commute(spark):
    s = series(spark, range(10))
    a, b, d = "2024-03-01 10:02:00", "2024-03-01 10:05:00", timedelta(minutes=7)
    moved = [datetime.fromisoformat(x) + d for x in (a, b)]
    assert s.crop(a, b).shift(minutes=7).df.collect() == s.shift(minutes=7).crop(*moved).df.collect()


def test_marking_again_replaces(spark):  # T11
    s = series(spark, range(5)).mark({"a": ("2024-03-01 10:00:00", "2024-03-01 10:01:00")}).mark({"b": ("2024-03-01 10:03:00", "2024-03-01 10:09:00")})
    s = s.mark({"a": [("2024-03-01 10:04:00", "2024-03-01 10:05:00")]})
    assert s.df.columns.count("act_a") == 1 and [r.total_conc for r in s.select_activity("a").collect()] == [4]
    assert set(s.activities) == {"All data", "a", "b"} and "act_a" not in s.select_activity("a").columns
    assert s.activity_periods["All data"] == [(START, START + timedelta(minutes=4))]
    with pytest.raises(ValueError):
        s.select_activity("c")


def test_periods_are_checked():  # T21
    assert len(periods((("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04")))) == 2
    with pytest.raises(TypeError):
        periods([("2024-01-01", "2024-01-02", "x")])


@pytest.mark.parametrize("method", ["mean", "median", "sum", "min", "max"])
@pytest.mark.parametrize("window", [1, 3, 4, 5])
def test_smooth_against_pandas(spark, method, window):
    rng = np.random.default_rng(window)
    v = [None if rng.random() < 0.2 else round(float(rng.random()), 3) for _ in range(150)]
    got = values(series(spark, v, step=97).smooth(window, method, block_rows=7))
    expected = getattr(pd.Series(v, dtype=float).rolling(window, center=True, min_periods=1), method)()
    assert [np.nan if x is None else x for x in got] == pytest.approx(expected.tolist(), nan_ok=True)


def test_smooth_by_series(spark):
    df = spark.createDataFrame([(START + timedelta(seconds=i), float(i), i % 2) for i in range(10)], "ts timestamp_ntz, total_conc double, k int")
    s = Series1D.from_df(df, "ts", ["total_conc"], by=["k"]).smooth(3, "max")
    assert s.df.where("k = 0 and total_conc = 8").count() == 2
    with pytest.raises(ValueError):
        s.smooth(3, "mode")


@pytest.mark.parametrize("freq", ["7min", "2.5h", "90s"])
@pytest.mark.parametrize("method", ["mean", "sum", "median", "max", "count", "std", "first", "last"])
def test_rebin_against_pandas(spark, freq, method):
    rng = np.random.default_rng(1)
    at = sorted(rng.choice(40_000, 60, replace=False).tolist())
    rows = [(datetime(2024, 3, 1, 21, 13, 7) + timedelta(seconds=a), float(a % 17)) for a in at]
    s = Series1D.from_df(spark.createDataFrame(rows, "ts timestamp_ntz, total_conc double")).rebin(freq, method)
    expected = getattr(pd.Series([r[1] for r in rows], index=pd.DatetimeIndex([r[0] for r in rows])).resample(freq), method)()
    got = s.df.orderBy("ts").collect()
    assert [r.ts for r in got] == list(expected.index.to_pydatetime())
    assert [np.nan if r.total_conc is None else float(r.total_conc) for r in got] == pytest.approx(expected.astype(float).tolist(), nan_ok=True)


def test_rebin_flags_in_gaps(spark):  # T9
    s = series(spark, [1, 2], step=3600).mark({"a": ("2024-03-01 10:00:00", "2024-03-01 12:00:00")}).rebin("20min")
    assert [r.act_a for r in s.df.orderBy("ts").collect()] == [True, False, False, True]
    assert s.summarize().where("segment = 'a'").first().n == 2
    with pytest.raises(ValueError, match="at most"):
        series(spark, [1, 2], step=3600).rebin("1s", most=100)
    assert series(spark, []).rebin("1s").df.count() == 0
    by = Series1D.from_df(spark.createDataFrame([(START + timedelta(hours=h), 1.0, k) for h, k in ((0, 1), (2, 1), (5, 2))], "ts timestamp_ntz, total_conc double, k int"), "ts", ["total_conc"], by=["k"])
    assert sorted((r.k, r.total_conc) for r in by.rebin("1h", "sum").df.collect()) == [(1, 0.0), (1, 1.0), (1, 1.0), (2, 1.0)]


def test_frequencies():
    assert [microseconds(f) // 10**6 for f in ("30S", "5min", "1H", "2.5h", "1D", "1h30min", "s")] == [30, 300, 3600, 9000, 86400, 5400, 1]
    for wrong in ("", "5 parsecs", "0s", "-1h"):
        with pytest.raises(ValueError):
            microseconds(wrong)


def test_summary_of_one_row_and_of_none(spark):
    s = series(spark, [1.0, 2.0, None]).mark({"one": (START, START), "none": ("2020-01-01", "2020-01-02")})
    rows = {r.segment: r for r in s.summarize().collect()}
    assert set(rows) == {"All data", "one"} and rows["one"].std is None and rows["All data"].n == 3 and rows["All data"].std == 0.707


def test_many_periods_by_join(spark):
    s = series(spark, range(2000), step=600)
    table = spark.createDataFrame([(START + timedelta(hours=h), START + timedelta(hours=h + w)) for h, w in ((0, 5), (3, 4), (30, 60), (31, 1), (200, -5))], "start timestamp_ntz, end timestamp_ntz")
    joined = s.mark_from("busy", table)
    literal = s.mark({"busy": [(r.start, r.end) for r in table.collect()]})
    assert joined.df.count() == 2000 and joined.df.select("ts", "act_busy").exceptAll(literal.df.select("ts", "act_busy")).count() == 0


def test_union_keeps_the_first_and_checks(spark):
    a, b, c = (series(spark, v) for v in ([1, 2], [10, 20, 30], [7]))
    b = b._with(b.df.withColumn("more", F.lit(1)))
    u = union([a, b, c._with(c.df, meta=SeriesMeta(serial_number="x"))])
    assert values(u) == [1, 2, 30] and u.df.columns == ["ts", "total_conc", "more"]
    assert values(union([u, u])) == [1, 2, 30]
    with pytest.raises(ValueError):
        union([])


def test_data_types():
    assert data_type("dM/dlogDp") == (Moment.MASS, Scale.LOG) and data_type("dN/dDp")[1] is Scale.LINEAR
    with pytest.raises(ValueError):
        data_type("dX")
    with pytest.raises(ValueError):
        Bins((1.0, 2.0), (1.0, 2.0))


@pytest.mark.parametrize("moment", ["dS", "dV", "dW"])
@pytest.mark.parametrize("normal", [False, True])
def test_conversions_return(spark, moment, normal):  # T1, T3
    s = sizes(spark, [(1, 2, 3, 4), (5, None, 0, 1)], density=1.7)
    s = s.normalize() if normal else s
    there = s.convert(moment)
    assert there.meta.scale is s.meta.scale and there.df.columns.count("total_conc") == 1 and there.unit == Moment(moment).unit
    back = there.convert("dN")
    for x, y in zip(s.df.orderBy("ts").collect(), back.df.orderBy("ts").collect(), strict=True):
        assert list(x)[1:] == pytest.approx(list(y)[1:])
    first = there.df.orderBy("ts").first()
    assert first.total_conc == pytest.approx(sum(first[c] * w for c, w in zip(BINS.columns, BINS.widths(there.meta.scale), strict=True)))


def test_normalising_twice_changes_nothing(spark):  # T2, T4
    s = sizes(spark, [(1, 2, 3, 4)])
    once, twice = s.normalize(), s.normalize().normalize()
    assert once.df.collect() == twice.df.collect() and once.df.first().total_conc == pytest.approx(10)
    assert s.unnormalize().df.collect() == s.df.collect()
    linear = s._with(s.df, meta=SeriesMeta(moment=Moment.NUMBER, scale=Scale.LINEAR, bins=BINS))
    assert linear.unnormalize().df.first().bin_000 == 200.0  # T24


def test_density(spark):  # T4
    s = sizes(spark, [(1, 2, 3, 4)]).convert("dW")
    d = s.with_density(2.0)
    assert d.df.first().total_conc == pytest.approx(2 * s.df.first().total_conc) and d.density == 2.0
    assert s.convert("dN").with_density(3).df.first().bin_000 == pytest.approx(1)


def test_diffusion_figures(spark):  # H10, T22
    mids = [20, 45, 105, 225, 400, 850]
    assert physics.reynolds(0.01, 1.5) == pytest.approx(212.409, abs=1e-3) and physics.reynolds(0.01, 60) == pytest.approx(8496.37, abs=1e-2)
    assert physics.diffusion_efficiency(mids, 0.01, 2, 1.5) == pytest.approx([0.939288808799, 0.977600857959, 0.991959121992, 0.996477510511, 0.997941657469, 0.998889889657], abs=1e-11)
    assert physics.diffusion_efficiency(mids, 0.01, 2, 60) == pytest.approx([0.971364053331, 0.989808143988, 0.996343957257, 0.998385688239, 0.999051209001, 0.999485128047], abs=1e-11)
    s = sizes(spark, [(1, 2, 3, 4)]).correct_diffusion(0.01, 2, 1.5)
    row = s.df.first()
    assert s.meta.extra["diffusion_loss_corrected"] and row.total_conc == pytest.approx(sum(row[c] for c in BINS.columns)) and row.bin_000 > 1


def test_metrics_against_numpy(spark):  # T9, T15, T17
    rows = [(5, 5, 1, 0), (0, 0, 0, 0), (1, 2, 3, 4), (None, None, None, None), (0, 7, 7, 1)]
    s = sizes(spark, rows).mark({"x": (START, START + timedelta(minutes=2))})
    got = s.metrics().orderBy("ts").collect()
    mids, edges = np.array(BINS.mids), np.array(BINS.edges)
    sizes_, pncs = [], []
    for r, row in zip(got, rows, strict=True):
        if row[0] is None:
            assert r.pnc is None and r.gmd is None and r.total_mass is None
            continue
        n = np.array(row, float)
        mass = n * 4 / 3 * np.pi * (mids / 2) ** 3 * 1e-9
        part = np.clip((1000 - edges[:-1]) / (edges[1:] - edges[:-1]), 0, 1)
        assert (r.pnc, r.pm1, r.total_mass) == pytest.approx((n.sum(), (mass * part).sum(), mass.sum()))
        pncs.append(n.sum())
        if n.sum() == 0:
            assert r.mode_dp is None and r.median_dp is None and r.gmd is None
            continue
        one = (mids[n.argmax()], mids[np.searchsorted(np.cumsum(n) / n.sum(), 0.5)], np.exp((np.log(mids) * n).sum() / n.sum()))
        sizes_.append(one)
        assert (r.mode_dp, r.median_dp, r.gmd) == pytest.approx(one)
    whole = {r.segment: r for r in s.summarize(rounded=False).collect()}["All data"]
    assert whole.pnc_std == pytest.approx(np.std(pncs, ddof=1)) and whole.gmd_std == pytest.approx(np.std([x[2] for x in sizes_]))
    assert len(s.summarize().columns) == 19


def test_views(spark):
    s = sizes(spark, [(0, 2, 3, 4), (5, 6, 7, 8)]).mark({"x": (START, START)})
    p = {(r.activity, r.bin_idx): r for r in s.psd(["x", "All data", "nothing"], normalize=False).collect()}
    assert len(p) == 8 and p["x", 1]["mean"] == 2 and p["x", 1]["std"] is None and p["All data", 3].hi == pytest.approx(6 + math.sqrt(8))
    cells, scale = s.heatmap(low=1)
    assert scale == (1.0, 8.0) and cells.agg(F.min("value")).first()[0] == 1.0
    with pytest.raises(ValueError):
        s.heatmap(log=True)
    assert s.heatmap()[1] == (0.0, 8.0) and s.activity_spans(False).count() == 0 and s.activity_spans().count() == 1
    assert s.psd(["nothing"]).count() == 0


def test_plans_stay_in_the_jvm(spark):
    s = sizes(spark, [(0, 2, 3, 4)]).mark({"x": (START, START)})
    for df in (s.summarize(), s.normalize().convert("dV").df, s.psd(), series(spark, [1, 2]).smooth().df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
    assert s.summarize()._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_accessors(spark):
    s = sizes(spark, [(0, 2, 3, 4)], instrument="i", serial_number="n", units={"*": "cm⁻³"})
    assert (s.instrument, s.serial_number, s.unit, s.data_type, s.density) == ("i", "n", "cm⁻³", "dN", 1.0)
    assert s.time.columns == ["ts"] and s.total_concentration.first()[1] == 9 and s.size_data.columns == ["ts", *BINS.columns]
    assert series(spark, [1]).data_type is None and series(spark, [1]).metadata.instrument is None and s.data is s.df
    assert Activity("a", (), "c").shifted(timedelta(1)).periods == ()


def test_smooth_of_ties_agrees_between_reruns(spark):
    rows = [(START + timedelta(seconds=i // 6), float(i * 37 % 11), None if i % 5 == 0 else i % 2) for i in range(600)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, v double, who int")
    for by in ([], ["who"]):
        made = [sorted(map(str, Series1D.from_df(t, "ts", ["v"], by=by).smooth(5, "mean", block_rows=40).df.collect())) for t in (table, table.repartition(7, "v"))]
        assert made[0] == made[1] and len(made[0]) == 600


@pytest.mark.parametrize("block_rows", [10, 10_000])
def test_smooth_by_series_against_pandas(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(START + timedelta(minutes=37 * int(i)), float(rng.random()), None if i % 4 == 0 else int(i % 3)) for i in rng.permutation(300)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, v double, who int")
    got = {(r.ts, r.who): r.v for r in Series1D.from_df(table, "ts", ["v"], by=["who"]).smooth(4, "mean", block_rows=block_rows).df.collect()}
    frame = pd.DataFrame(rows, columns=["ts", "v", "who"]).sort_values("ts")
    for _, own in frame.groupby("who", dropna=False):
        want = [own["v"].iloc[max(0, i - 2) : i + 2].mean() for i in range(len(own))]
        assert [got[t.to_pydatetime(), None if pd.isna(w) else int(w)] for t, w in zip(own["ts"], own["who"])] == pytest.approx(want)


def test_many_periods_across_days(spark):
    rng = np.random.default_rng(5)
    s = series(spark, range(3000), step=97)
    spans = [(START + timedelta(seconds=int(a)), START + timedelta(seconds=int(a + b))) for a, b in zip(rng.integers(-9000, 290_000, 80), rng.choice([0, 5, 600, 7000, 90_000], 80, p=[0.2, 0.3, 0.3, 0.15, 0.05]))]
    spans += [(START + timedelta(hours=14), START + timedelta(hours=14)), (START + timedelta(hours=2), START + timedelta(hours=1))]
    got = s.mark_from("a", spark.createDataFrame(spans, "start timestamp_ntz, end timestamp_ntz")).df.collect()
    assert len(got) == 3000
    assert all(r.act_a == any(a <= r.ts <= b for a, b in spans) for r in got)


@pytest.mark.parametrize("method,expected", [("first", [1.0, 5.0]), ("last", [3.0, 6.0])])
def test_rebin_by_the_ends_follows_time(spark, method, expected):
    s = series(spark, [None, 1, 2, 3, None, 5, 6], step=15)
    for n in (1, 5):
        made = s._with(s.df.repartition(n, "total_conc")).rebin("1min", method)
        assert [r.total_conc for r in made.df.orderBy("ts").collect()] == [1.0 if method == "first" else 3.0, expected[1]]


def test_heat_map_of_nothing(spark):
    s = sizes(spark, [[1, 2, 3, 4]])
    empty = s._with(s.df.limit(0))
    cells, scale = empty.heatmap(low=1)
    assert cells.count() == 0 and scale == (1.0, None)
    assert empty.heatmap()[1] == (None, None)


def test_united_series_are_in_order_of_time(spark):
    parts = [series(spark, [5, 6], start=START + timedelta(hours=1)), series(spark, [1, 2])]
    assert [r.total_conc for r in union(parts).df.collect()] == [1, 2, 5, 6]


@pytest.mark.parametrize("method", ["mean", "median", "sum", "min", "max"])
@pytest.mark.parametrize("window", [17, 18, 50, 91, 300])
@pytest.mark.parametrize("block_rows", [20, 1000])
def test_long_windows_against_pandas(spark, method, window, block_rows):
    """Windows beyond FRAME_ROWS, of several series with gaps, also longer than a series."""
    rng = np.random.default_rng(window)
    rows, want = [], {}
    for who, n in (("a", 230), ("b", 91), ("c", 1), (None, 40)):
        v = [None if rng.random() < 0.2 or 60 < i < 110 else float(x) for i, x in enumerate(rng.normal(0, 100, n))]
        rows += [(START + timedelta(seconds=i), who, x) for i, x in enumerate(v)]
        own = pd.Series([np.nan if x is None else x for x in v])
        rolled = getattr(own.rolling(window, center=True, min_periods=1), method)()
        want |= {(START + timedelta(seconds=i), who): x for i, x in enumerate(rolled)}
    rng.shuffle(rows)
    table = spark.createDataFrame([tuple(r) for r in rows], "ts timestamp_ntz, who string, v double")
    out = Series1D.from_df(table, "ts", ["v"], by=["who"]).smooth(window, method, block_rows=block_rows).df
    got = {(r.ts, r.who): r.v for r in out.collect()}
    assert out.columns == ["ts", "v", "who"] and set(got) == set(want)
    for k, x in want.items():
        assert (got[k] is None) if np.isnan(x) else got[k] == pytest.approx(x, rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("method", ["skew", "kurt", "sem", "prod", "nunique", "size", "any", "all", "std", "sum"])
def test_more_aggregates_against_pandas(spark, method):
    """Buckets of none to many values, of equal ones, with nulls, zeros and negative signs."""
    rng = np.random.default_rng(3)
    rows = []
    for bucket, n in enumerate([5, 0, 1, 2, 3, 4, 40, 0, 6, 7]):
        for i in range(n):
            x = 2.0 if bucket == 8 else 0.0 if bucket == 9 else [-1.5, 0.5, 3.0, None, -2.0, 1.25][rng.integers(0, 6)]
            rows.append((START + timedelta(minutes=10 * bucket, seconds=i), x))
    got = Series1D.from_df(spark.createDataFrame(rows, "ts timestamp_ntz, total_conc double")).rebin("10min", method)
    own = pd.Series([np.nan if x is None else x for _, x in rows], index=pd.DatetimeIndex([t for t, _ in rows])).resample("10min")
    want = own.apply(lambda v: getattr(v, method)()) if method in ("skew", "kurt") else own.agg(getattr(pd.Series, method) if method in ("any", "all") else method)
    for a, b in zip(values(got), want.tolist(), strict=True):
        assert a is None if pd.isna(b) else a == pytest.approx(b), method


def test_reducers_in_python(spark):
    s = series(spark, [1, 5, None, 2, 8, 4], step=600).mark({"a": ("2024-03-01 10:00:00", "2024-03-01 10:10:00")})
    for how in (np.nanmax, lambda v: v.max(), lambda v: max(x for x in v if x == x), F.max):
        made = s.rebin("20min", how)
        assert values(made) == [5, 2, 8] and [r.act_a for r in made.df.orderBy("ts").collect()] == [True, False, False]
    assert values(s.rebin("20min", lambda v: v.iloc[0], python=True)) == [1, None, 8]


def test_grids_of_series_are_made_in_pieces(spark, monkeypatch):
    from aeroframe.operators import series as module

    monkeypatch.setattr(module, "PIECE", 7)
    rows = [(START, 1, 1.0), (START + timedelta(minutes=200), 1, 2.0), (START, None, 3.0), (START + timedelta(minutes=50), None, 4.0), (START, 2, 5.0)]
    s = Series1D.from_df(spark.createDataFrame(rows, "ts timestamp_ntz, k long, total_conc double"), by=["k"])
    got = s.rebin("10min", "sum").df
    assert {r.k: (r.n, r.total) for r in got.groupBy("k").agg(F.count("*").alias("n"), F.sum("total_conc").alias("total")).collect()} == {1: (21, 3), None: (6, 7), 2: (1, 5)}
    assert got.select("k", "ts").distinct().count() == 28
    with pytest.raises(ValueError, match="28 buckets"):
        s.rebin("10min", "sum", most=27)


def test_observed_spans(spark):
    s = series(spark, range(10)).mark({"a": [("2024-03-01 10:02:30", "2024-03-01 10:05:00"), ("2025-01-01", "2025-01-02")], "b": ("2024-03-01 10:00:00", "2024-03-01 10:00:00")})
    got = [(r.activity, r.first, r.last, r.n) for r in s.observed_spans().orderBy("activity", "start").collect()]
    assert got == [("a", START + timedelta(minutes=3), START + timedelta(minutes=5), 3), ("a", None, None, 0), ("b", START, START, 1)]
    assert s.observed_spans(False).count() == 0 and s.observed_spans(["b", "none"]).count() == 1


def test_union_names_other_bins_by_their_edges(spark):
    def made(shift, day):
        bins = Bins.arithmetic(tuple(float(2**k) for k in range(shift, shift + 15)))
        return Series2D.from_bins(spark.range(1).selectExpr(f"timestamp_ntz'2024-01-0{day} 00:00:00' ts", *(f"id + {k + 1}D {c}" for k, c in enumerate(bins.columns))), bins).deduplicated(["ts"])

    out = union([made(5, 1), made(0, 2), made(10, 3)])
    one, two, three = (list(r)[1:] for r in out.df.select("ts", "total_conc", *out.bins.columns).orderBy("ts").collect())
    numbers = [float(k) for k in range(1, 15)]
    assert one == [105.0, *[None] * 5, *numbers, *[None] * 5]
    assert two == [105.0, *numbers, *[None] * 10]
    assert three == [105.0, *[None] * 10, *numbers]
