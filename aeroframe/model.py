"""What is known about a series besides its rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from enum import Enum

ALL_DATA = "All data"


class Moment(Enum):
    """Number, surface, volume or mass; the value is the data type's prefix."""

    NUMBER = "dN"
    SURFACE = "dS"
    VOLUME = "dV"
    MASS = "dW"

    @property
    def unit(self) -> str:
        return {"dN": "cm⁻³", "dS": "nm²/cm³", "dV": "nm³/cm³", "dW": "ug/m³"}[self.value]


class Scale(Enum):
    """What the bins are divided by."""

    NONE = ""
    LOG = "/dlogDp"
    LINEAR = "/dDp"


def data_type(text: str) -> tuple[Moment, Scale]:
    """``dN/dlogDp`` and the like; ``dM`` means mass as ``dW`` does."""
    head, _, tail = text.partition("/")
    try:
        return Moment("dW" if head == "dM" else head), Scale("/" + tail if tail else "")
    except ValueError:
        raise ValueError(f"unknown data type {text!r}") from None


@dataclass(frozen=True)
class Bins:
    """Edges and mid-points in nm; ``pairs`` has each bin's own edges where bins don't all adjoin."""

    edges: tuple[float, ...]
    mids: tuple[float, ...]
    pairs: tuple[tuple[float, float], ...] | None = None

    def __post_init__(self) -> None:
        if self.pairs is not None:
            if len(self.pairs) != len(self.mids):
                raise ValueError(f"{len(self.mids)} bins need as many pairs of edges, not {len(self.pairs)}")
        elif len(self.edges) != len(self.mids) + 1:
            raise ValueError(f"{len(self.mids)} bins need {len(self.mids) + 1} edges, not {len(self.edges)}")

    @classmethod
    def arithmetic(cls, edges) -> Bins:
        return cls(tuple(map(float, edges)), tuple((a + b) / 2 for a, b in zip(edges[:-1], edges[1:], strict=True)))

    @classmethod
    def apart(cls, mids: Mapping[tuple[float, float], float]) -> Bins:
        """Bins by their (lower, upper) edges, in order of size."""
        pairs = tuple(sorted(mids))
        edges = tuple(sorted({e for p in pairs for e in p}))
        adjoin = tuple(zip(edges[:-1], edges[1:], strict=True)) == pairs
        return cls(edges, tuple(mids[p] for p in pairs), None if adjoin else pairs)

    @property
    def spans(self) -> tuple[tuple[float, float], ...]:
        """Lower and upper edge of each bin."""
        return self.pairs or tuple(zip(self.edges[:-1], self.edges[1:], strict=True))

    @property
    def columns(self) -> list[str]:
        return [f"bin_{i:03d}" for i in range(len(self.mids))]

    @property
    def log_widths(self) -> list[float]:
        return [math.log10(b) - math.log10(a) for a, b in self.spans]

    def widths(self, scale: Scale) -> list[float]:
        if scale is Scale.LOG:
            return self.log_widths
        if scale is Scale.LINEAR:
            return [b - a for a, b in self.spans]
        return [1.0] * len(self.mids)


def common_bins(all_bins: Iterable[Bins], overlapping: bool = False) -> Bins:
    """Every different bin once, told by its edges; bins that overlap without being equal are an error unless wanted."""
    mids: dict[tuple[float, float], float] = {}
    for bins in all_bins:
        for span, mid in zip(bins.spans, bins.mids, strict=True):
            mids.setdefault(span, mid)
    order = sorted(mids)
    for (a, b), (c, d) in zip(order[:-1], order[1:], strict=True):
        if c < b and not overlapping:
            raise ValueError(f"bins of {a:g} to {b:g} nm and of {c:g} to {d:g} nm overlap")
    return Bins.apart(mids)


def moment_of_time(value: str | datetime) -> datetime:
    """A time given as text (``YYYY-MM-DD`` or ``YYYY/MM/DD``, with or without a clock time) or as a datetime."""
    if isinstance(value, datetime):
        return value
    return datetime.fromisoformat(value.strip().replace("/", "-"))


@dataclass(frozen=True)
class Activity:
    """A named set of periods, ends included, and its column of flags."""

    name: str
    periods: tuple[tuple[datetime, datetime], ...]
    column: str

    def shifted(self, by: timedelta) -> Activity:
        return replace(self, periods=tuple((a + by, b + by) for a, b in self.periods))


def periods(given) -> tuple[tuple[datetime, datetime], ...]:
    """One (start, end) or a list of them."""
    if isinstance(given, (tuple, list)) and len(given) == 2 and all(isinstance(x, (str, datetime)) for x in given):
        given = [given]
    out = []
    for pair in given:
        if not isinstance(pair, (tuple, list)) or len(pair) != 2 or not all(isinstance(x, (str, datetime)) for x in pair):
            raise TypeError(f"a period is a pair of times, not {pair!r}")
        out.append((moment_of_time(pair[0]), moment_of_time(pair[1])))
    return tuple(out)


@dataclass(frozen=True)
class SeriesMeta:
    instrument: str | None = None
    serial_number: str | None = None
    units: Mapping[str, str] = field(default_factory=dict)  # by column; "*" for all
    moment: Moment | None = None
    scale: Scale = Scale.NONE
    kinds: Mapping[str, str] = field(default_factory=dict)  # data type by column where there is no size distribution
    density: float = 1.0
    bins: Bins | None = None
    activities: tuple[Activity, ...] = ()
    extra: Mapping[str, object] = field(default_factory=dict)

    @property
    def data_type(self) -> str | None:
        return None if self.moment is None else self.moment.value + self.scale.value

    @property
    def unit(self) -> str | None:
        return self.units.get("*")
