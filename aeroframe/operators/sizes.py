"""Size distributions: one column for each bin, moments, normalisation, losses, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.functions.metrics import geometric_mean, median_mid, mode_mid, no_nan, row_total, weighted_sum
from aeroframe.functions.physics import PM_CUTS, conversion, diffusion_efficiency, per_particle, share_below
from aeroframe.model import Bins, Moment, Scale, SeriesMeta
from aeroframe.operators.series import Series1D, seconds

MASS_METRICS = ("pnc", *PM_CUTS, "total_mass")
SIZE_METRICS = ("mode_dp", "median_dp", "gmd")


class Series2D(Series1D):
    """A series whose values are the total and the bins; the total is always the sum of the bins as they are without normalisation."""

    @classmethod
    def from_bins(cls, df: DataFrame, bins: Bins, columns: Sequence[str] | None = None, meta: SeriesMeta | None = None, ts: str = "ts", by: Sequence[str] = (), extra: DataFrame | None = None) -> Series2D:
        """Take a table with a column for each bin, in the order of the bins."""
        columns = list(columns or bins.columns)
        meta = replace(meta or SeriesMeta(moment=Moment.NUMBER), bins=bins)
        meta = replace(meta, moment=meta.moment or Moment.NUMBER)
        named = df.select(F.col(ts).cast("timestamp_ntz").alias("ts"), *by, *(no_nan(F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip(columns, bins.columns, strict=True)))
        made = cls(named, meta, "ts", ("total_conc", *bins.columns), by, extra=extra)
        made = made._totalled(named)
        made.original_data = made.df
        return made

    @property
    def bins(self) -> Bins:
        return self.meta.bins

    @property
    def bin_edges(self) -> tuple[float, ...]:
        return self.bins.edges

    @property
    def bin_mids(self) -> tuple[float, ...]:
        return self.bins.mids

    @property
    def density(self) -> float:
        return self.meta.density

    @property
    def size_data(self) -> DataFrame:
        return self.df.select(*self.by, self.ts, *self.bins.columns)

    def _totalled(self, df: DataFrame, meta: SeriesMeta | None = None) -> Series2D:
        meta = meta or self.meta
        total = row_total(meta.bins.columns, meta.bins.widths(meta.scale))
        rest = [c for c in df.columns if c not in (self.ts, "total_conc", *self.by)]
        return self._with(df.select(self.ts, *self.by, total.alias("total_conc"), *(F.col(f"`{c}`") for c in rest)), meta=meta)

    def _scaled(self, factors: Sequence[float], meta: SeriesMeta) -> Series2D:
        return self._totalled(self.df.withColumns({c: F.col(c) * F.lit(float(k)) for c, k in zip(self.bins.columns, factors, strict=True) if k != 1.0}), meta)

    def convert(self, moment: Moment | str) -> Series2D:
        """To number, surface, volume or mass; a normalisation stays as it is."""
        moment = moment if isinstance(moment, Moment) else Moment(moment)
        if moment is self.meta.moment:
            return self
        meta = replace(self.meta, moment=moment, units={**self.meta.units, "*": moment.unit})
        return self._scaled(conversion(self.bins, self.meta.moment, moment, self.density), meta)

    def normalize(self) -> Series2D:
        """Bins divided by their width in log10 of the diameter."""
        if self.meta.scale is Scale.LOG:
            return self
        plain = self.unnormalize()
        return plain._scaled([1 / w for w in self.bins.log_widths], replace(plain.meta, scale=Scale.LOG))

    def unnormalize(self) -> Series2D:
        """Bins as contents of the bins, whatever they were divided by."""
        if self.meta.scale is Scale.NONE:
            return self
        return self._scaled(self.bins.widths(self.meta.scale), replace(self.meta, scale=Scale.NONE))

    def with_density(self, density: float = 1.0) -> Series2D:
        """Another particle density in g/cm3; mass follows it."""
        meta = replace(self.meta, density=float(density))
        if self.meta.moment is not Moment.MASS:
            return self._with(self.df, meta=meta)
        return self._scaled([density / self.density] * len(self.bin_mids), meta)

    def correct_diffusion(self, diameter: float, length: float, flow: float, temperature: float = 293.0, pressure: float = 101300.0) -> Series2D:
        """Bins divided by the part that passes a sampling tube."""
        passed = diffusion_efficiency(self.bin_mids, diameter, length, flow, temperature, pressure)
        meta = replace(self.meta, extra={**self.meta.extra, "diffusion_efficiency": tuple(passed), "diffusion_loss_corrected": True})
        divided = {c: F.try_divide(F.col(c), F.lit(k)) for c, k in zip(self.bins.columns, passed, strict=True)}
        return self._totalled(self.df.withColumns(divided), meta)

    def metrics(self) -> DataFrame:
        """Rows with the nine metrics as columns; sizes are null where there are no particles, all are null where all bins are."""
        plain = self.unnormalize().convert(Moment.NUMBER)
        columns, mids = self.bins.columns, self.bin_mids
        mass = [per_particle(Moment.MASS, m, self.density) for m in mids]
        some = F.coalesce(*columns).isNotNull()
        keep = [c for c in plain.df.columns if c not in ("total_conc", *columns)]
        bins = F.array(*columns)
        total = row_total(columns)
        only = lambda c: F.when(some, c)
        out = plain.df.select(*(F.col(f"`{c}`") for c in keep), *columns, only(total).alias("pnc"))
        made = {name: only(weighted_sum(columns, [m * w for m, w in zip(mass, share_below(self.bins, cut), strict=True)])) for name, cut in PM_CUTS.items()}
        made["total_mass"] = only(row_total(columns, mass))
        there = F.col("pnc") != 0
        made["mode_dp"] = F.when(there, mode_mid(bins, mids))
        made["median_dp"] = F.when(there, median_mid(columns, F.col("pnc"), mids))
        made["gmd"] = F.when(there, geometric_mean(columns, F.col("pnc"), mids))
        return out.withColumns(made).drop(*columns)

    def summarize(self, rounded: bool = True) -> DataFrame:
        """For each activity with rows: mean and std of nine metrics (std with n - 1 for contents, with n for sizes)."""
        rows = self.metrics()
        parts = []
        for i, name in enumerate(self.activities):
            flag = self._flag(name)
            stats = []
            for m in MASS_METRICS + SIZE_METRICS:
                own, digits = F.when(flag, F.col(m)), 2 if m in MASS_METRICS else 1
                show = (lambda c, d=digits: F.bround(c, d)) if rounded else (lambda c: c)
                spread = F.stddev_samp if m in MASS_METRICS else F.stddev_pop
                stats += [show(F.avg(own)).alias(m), show(spread(own)).alias(f"{m}_std")]
            parts.append(F.struct(F.lit(name).alias("segment"), *stats, F.count_if(flag).alias("n")))
        return rows.agg(F.array(*parts).alias("rows")).select(F.inline("rows")).where("n > 0").drop("n")

    def psd(self, activities: Sequence[str] | None = None, normalize: bool | None = True) -> DataFrame:
        """Mean size distribution with std (n - 1) of each bin, by activity, one row for each bin; unknown names are dropped."""
        shown = self if normalize is None else self.normalize() if normalize else self.unnormalize()
        names = [a for a in (activities or self.activities) if a in self.activities]
        parts = []
        for name in names:
            flag = self._flag(name)
            stats = [F.struct(F.lit(i).alias("bin_idx"), F.lit(m).alias("mid"), F.avg(F.when(flag, F.col(c))).alias("mean"), F.stddev_samp(F.when(flag, F.col(c))).alias("std")) for i, (c, m) in enumerate(zip(self.bins.columns, self.bin_mids, strict=True))]
            parts.append(F.struct(F.lit(name).alias("activity"), F.count_if(flag).alias("n"), F.array(*stats).alias("bins")))
        if not parts:
            return self.df.sparkSession.createDataFrame([], "activity string, bin_idx int, mid double, mean double, std double, lo double, hi double")
        out = shown.df.agg(F.array(*parts).alias("rows")).select(F.inline("rows")).where("n > 0").select("activity", F.inline("bins"))
        return out.withColumns({"lo": F.col("mean") - F.col("std"), "hi": F.col("mean") + F.col("std")})

    def to_long(self) -> DataFrame:
        """One row for each time and bin."""
        cells = F.array(*(F.struct(F.lit(i).alias("bin_idx"), F.lit(m).alias("mid"), F.col(c).alias("value")) for i, (c, m) in enumerate(zip(self.bins.columns, self.bin_mids, strict=True))))
        return self.df.select(*self.by, self.ts, F.inline(cells))

    def heatmap(self, low: float = 0, high: float = 0, log: bool = False) -> tuple[DataFrame, tuple[float, float]]:
        """Cells of the drawing and the scale of its colours.

        ``low`` other than 0 clips the values from below; a scale given as 0
        comes from the values, so that they are read when this is called; it is
        None where there are none. A time's cell reaches half of the first step
        to either side.
        """
        columns = self.bins.columns
        if low:
            clipped = self._with(self.df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(float(low)))) for c in columns}))
        else:
            clipped = self
        ends = clipped.df.agg(F.min(F.least(*columns) if len(columns) > 1 else F.col(columns[0])).alias("low"), F.max(F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])).alias("high")).first()
        if log and ends.low is not None and ends.low <= 0:
            raise ValueError("zeros or negative values have no place on a logarithmic scale")
        times = [r[0] for r in self.df.select(self.ts).orderBy(self.ts).limit(2).collect()]
        half = (times[1] - times[0]) / 2 if len(times) == 2 else None
        cells = clipped.to_long()
        if half is not None:
            micros = round(half.total_seconds() * 1e6)
            cells = cells.withColumns({"cell_start": F.col(self.ts) - seconds(micros), "cell_end": F.col(self.ts) + seconds(micros)})
        lower, upper = (F.element_at(F.array(*map(F.lit, e)), F.col("bin_idx") + 1) for e in zip(*self.bins.spans, strict=True))
        top = high or ends.high  # None without rows
        scale = (float(low), top if top is None else float(top)) if (low, high) != (0, 0) else (ends.low, ends.high)
        return cells.withColumns({"edge_low": lower, "edge_high": upper}), scale


def counts_by_bin(df: DataFrame, bucket: Column, diameter: Column, bins: Bins) -> DataFrame:
    """Particles counted one by one to a distribution: rows in [low, high) of each bin for each bucket."""
    inside = [F.count_if((diameter >= a) & (diameter < b)).cast("double").alias(c) for c, (a, b) in zip(bins.columns, bins.spans, strict=True)]
    return df.groupBy(bucket.alias("ts")).agg(*inside)
