"""Instruments' text exports: what the preamble of each says about its rows.

A dialect reads the first lines of a file on the driver and returns a Layout.
The rows themselves are parsed by built-in expressions over the columns
``c0, c1, ...`` of each line, its place ``i`` among the rows, and the file's
``start`` and ``step``.
"""

from __future__ import annotations

import csv
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from aeroframe.model import Bins, Moment, Scale, SeriesMeta, data_type


@dataclass
class Layout:
    header: list[str]
    first: int  # place of the first row among the file's lines
    time: str  # SQL
    meta: SeriesMeta
    values: dict[str, str] = field(default_factory=dict)  # name: SQL
    bins: list[str] = field(default_factory=list)  # SQL of each bin
    extra: dict[str, str] = field(default_factory=dict)  # name: SQL
    start: datetime | None = None
    step: float | None = None
    footer: int = 0  # lines at the end that are no rows
    complete: bool = False  # rows with a missing cell are dropped


class Head:
    """The first lines of a file, raw, and their cells."""

    def __init__(self, text: str, sep: str):
        self.lines, self.sep = re.split("\r\n|\r|\n", text), sep

    def cells(self, line: int, sep: str | None = None) -> list[str]:
        if line >= len(self.lines):
            raise ValueError(f"the file ends before line {line + 1}")
        return [c.strip() for c in next(csv.reader([self.lines[line]], delimiter=sep or self.sep), [])]

    def table(self, header: int, sep: str | None = None) -> tuple[list[str], int]:
        """Cells of the header-th line that isn't blank, and the place of the line after it."""
        seen = -1
        for at, line in enumerate(self.lines):
            seen += bool(line.strip())
            if seen == header:
                return self.cells(at, sep), at + 1
        raise ValueError("the file has no table")

    def pairs(self, lines: int, sep: str | None = None) -> dict[str, str]:
        """Keys and values before the table."""
        out = {}
        for line in self.lines[:lines]:
            key, found, value = line.partition(sep or self.sep)
            if found:
                out[key.strip()] = value.strip().strip((sep or self.sep) + '"').strip()
        return out


def _num(k: int) -> str:
    return f"try_cast(replace(trim(c{k}), ' ', '') as double)"


def _ts(text: str, *formats: str) -> str:
    return "coalesce(" + ", ".join(f"try_to_timestamp({text}, \"{f}\")" for f in formats) + ")"


def _since(seconds: str) -> str:
    return f"start + make_dt_interval(0, 0, 0, cast({seconds} as decimal(18, 6)))"


def _at(header: list[str], name: str) -> int:
    try:
        return header.index(name)
    except ValueError:
        raise ValueError(f"no column {name!r}") from None


def _others(header: list[str], used: set[int]) -> dict[str, str]:
    return {name or f"column_{k}": f"c{k}" for k, name in enumerate(header) if k not in used and name}


def _rounded(values: list[float], digits: int = 1) -> tuple[float, ...]:
    return tuple(round(v, digits) for v in values)


def _geometric(mids: list[float], low: float, high: float) -> list[float]:
    return [low, *(math.sqrt(a * b) for a, b in zip(mids[:-1], mids[1:], strict=True)), high]


def _middle(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:], strict=True)]


_WORDS = {"Nu": "dN", "Co": "dN", "Su": "dS", "Vo": "dV", "Ma": "dW", "dN": "dN", "dS": "dS", "dV": "dV", "dW": "dW", "dM": "dW"}


def _described(text: str, scale: str = "") -> tuple[Moment, Scale]:
    """From a word for the moment and, possibly, what it is divided by."""
    try:
        word = _WORDS[text[:2]]
    except KeyError:
        raise ValueError(f"unknown weighting {text!r}") from None
    tail = re.search(r"/d(?:log)?Dp", f"{text} {scale}")
    return data_type(word + (tail[0] if tail else ""))


def _sized(instrument: str, serial: str | None, moment: Moment, scale: Scale, edges, mids, density: float = 1.0, **extra) -> SeriesMeta:
    return SeriesMeta(instrument, serial, {"*": moment.unit}, moment, scale, density=density, bins=Bins(tuple(map(float, edges)), tuple(map(float, mids))), extra=extra)


def aethalometer(head: Head) -> Layout:
    header, first = head.table(0)
    cells = head.cells(first)
    core = {"ir_bcc": "IR BCc", "biomass_bcc": "Biomass BCc  (ng/m^3)", "fossil_fuel_bcc": "Fossil fuel BCc  (ng/m^3)", "aae": "AAE"}
    squeezed = [re.sub(r"\s+", " ", h) for h in header]
    at = {}
    for name, label in core.items():
        label = re.sub(r"\s+", " ", label)
        at[name] = next((k for k, h in enumerate(squeezed) if h == label or h == f"{label} (ng/m^3)"), None)
        if at[name] is None:
            raise ValueError(f"no column {label!r}")
    known = lambda name: cells[header.index(name)] if name in header else None
    meta = SeriesMeta("Aethalometer", known("Serial number"), {"*": "ng/m³"}, kinds={"*": "dM"}, extra={"optical_config": known("Optical config")})
    time = _at(header, "Date / time local")
    return Layout(header, first, _ts(f"c{time}", "yyyy-MM-dd'T'HH:mm:ss"), meta, {n: _num(k) for n, k in at.items()}, extra=_others(header, {*range(6), *at.values()} | {k for k, h in enumerate(header) if h == "Optical config"}), complete=True)


def cpc(head: Head) -> Layout:
    """Focused export of 4 columns or the full one of 14, told by the fifth line."""
    n = len(head.cells(4))
    if n == 4 or n < 8:
        at = {k: v for k, v in (head.cells(x)[:2] for x in range(4, 10) if len(head.cells(x)) > 1)}
        day, clock = (next((v for k, v in at.items() if w in k.lower()), None) for w in ("date", "time"))
        start = datetime.strptime(f"{day} {clock}", "%m/%d/%y %H:%M:%S")
        header, first = head.table(14)
        serial = head.cells(5)[1][5:-3] if len(head.cells(5)) > 1 else None
        meta = SeriesMeta("CPC", serial, {"*": Moment.NUMBER.unit})
        return Layout(header, first, _since("i + 1"), meta, {"total_conc": _num(1)}, start=start, footer=3, complete=True)
    header, first = head.table(2)
    day, clock, total = _at(header, "Start Date"), _at(header, "Start Time"), _at(header, "[1] Conc")
    serial = head.cells(first)[_at(header, "Instrument ID")][5:-3]
    meta = SeriesMeta("CPC", serial, {"*": Moment.NUMBER.unit})
    return Layout(header, first, _ts(f"concat(c{day}, ' ', c{clock})", "MM/dd/yy HH:mm:ss"), meta, {"total_conc": _num(total)}, extra=_others(header, {day, clock, total}))


def discmini(head: Head) -> Layout:
    header, first = head.table(4)
    time = next((k for k, h in enumerate(header) if h == "TimeStamp"), 0)
    rest = [k for k in range(min(7, len(header))) if k != time and header[k] != "Time"]
    words = head.lines[2].split(" ")
    meta = SeriesMeta("DiSCmini", words[5].strip() if len(words) > 5 else None, {"total_conc": "cm⁻³", "size": "nm", "ldsa": "nm²/cm³"}, kinds={"total_conc": "dN", "size": "l", "ldsa": "dS"})
    values = {n: _num(k) for n, k in zip(("total_conc", "size", "ldsa"), rest, strict=False)}
    return Layout(header, first, _ts(f"c{time}", "dd-MMM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss"), meta, values, extra={header[k]: f"c{k}" for k in rest[3:]})


def elpi(head: Head) -> Layout:
    known = head.pairs(36, "=")
    floats = lambda key: [float(v) for v in known[key].split(head.sep) if v.strip()]
    edges, mids = [1000 * v for v in floats("D50values(um)")], [1000 * v for v in floats("CalculatedDi(um)")]
    density = float(known.get("Density(g/cm^3)", 1.0))
    if density != 1.0:  # cut points are aerodynamic; between mid-points they are not
        edges[1:-1] = _geometric(mids, 0, 0)[1:-1]
        edges[0], edges[-1] = edges[1] ** 2 / edges[2], edges[-2] ** 2 / edges[-3]
    moment, scale = _described(known["CalculatedMoment"], known.get("CalculatedType", "")[2:])
    header, first = head.table(36)
    if len(head.cells(first)) > len(header):
        header, first = head.cells(39), 42
        header += [f"Unnamed_{k}" for k in range(len(header), len(head.cells(first)))]
    else:
        first += 1  # a line of units
    serial = re.split(r"[,;\t]", head.lines[0])
    time = next((k for k, h in enumerate(header) if h.startswith("Date Time")), 0)
    bins = range(34, 34 + len(mids))
    meta = _sized("ELPI", serial[1][1:-1] if len(serial) > 1 else None, moment, scale, _rounded(edges), _rounded(mids), density, **{k: v for k, v in known.items() if not k.startswith("Calculated")})
    return Layout(header, first, _ts(f"c{time}", "yyyy/MM/dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss"), meta, bins=[_num(k) for k in bins], extra=_others(header, {time, *bins}))


#: Month names of Danish dates.
_DANISH = ("januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december")


def fmps(head: Head) -> Layout:
    if head.lines and "Raw" in head.lines[0]:
        raise ValueError("a raw export; export concentrations instead")
    mids = [float(v) for v in head.cells(13)[1:-11]]
    edges = [5.6, *_middle(mids), 560.0]
    moment, scale = _described(head.cells(12)[0].split(" ")[0])
    header, first = head.cells(14), 15
    said = " ".join(head.cells(0)[1:]).replace('"', "").replace(",", " ")
    danish = re.search(r"(\d{1,2})\.? (\w+) (\d{4}).*?(\d{1,2}):(\d{2}):(\d{2})", said)
    english = re.search(r"([A-Z][a-z]{2})\w* (\d{1,2}) +(\d{4}) +(\d{1,2}:\d{2}:\d{2} [AP]M)", said)
    if danish and danish[2].lower() in _DANISH:
        start = datetime(int(danish[3]), _DANISH.index(danish[2].lower()) + 1, *map(int, (danish[1], danish[4], danish[5], danish[6])))
    elif english:
        start = datetime.strptime(f"{english[1]} {english[2]} {english[3]} {english[4]}", "%b %d %Y %I:%M:%S %p")
    else:
        raise ValueError(f"no date in {said!r}")
    if "Elapsed" in header[0]:
        step, time = None, _since("try_cast(c0 as double)")
    else:
        clock = [head.cells(first + k)[0] for k in (0, 1)]
        form = "%I:%M:%S %p" if clock[0].upper().endswith("M") else "%H:%M:%S"
        step, time = (datetime.strptime(clock[1], form) - datetime.strptime(clock[0], form)).total_seconds(), _since("i * step")
    serial = head.cells(4)[2][-8:] if len(head.cells(4)) > 2 else None
    return Layout(header, first, time, _sized("FMPS", serial, moment, scale, edges, mids), bins=[_num(k) for k in range(1, len(mids) + 1)], start=start, step=step)


def fourtec(head: Head) -> Layout:
    header, first = head.cells(8), 9
    if re.match(r"\d", header[0] if header else ""):
        first = 8
    meta = SeriesMeta("Fourtec", head.cells(2)[2] if len(head.cells(2)) > 2 else None, {"temperature": "°C", "rh": "%"})
    return Layout(header, first, _ts("concat(c0, ' ', c1)", "dd-MM-yyyy HH:mm:ss"), meta, {"temperature": _num(2), "rh": _num(4)})


def _grimm_norm(text: str, mids: list[float]) -> list[float]:
    """What the cells are divided by to give numbers in cm3."""
    if "g/m" in text or "Mass" in text:
        return [math.pi / 6 * (m / 1e7) ** 3 * 1e12 for m in mids]
    if "/l" in text or "Count" in text:
        return [1000.0] * len(mids)
    raise ValueError(f"unknown unit {text!r}")


def grimm(head: Head) -> Layout:
    """Export of the software (begins with <Header>) or of the instrument (begins with File name)."""
    part = lambda line, sign: (line.split(sign, 2) + [""])[1].strip()
    if "<Header>" in head.lines[0]:
        header, first = head.table(13)
        edges = [*(float(h[:-3]) * 1000 for h in header[1:] if h), 34_000.0]
        # Fixed places, counted over lines that aren't blank: the third has the location, the eighth serial number and unit.
        shown = [line for line in head.lines if line.strip()]
        place, serial, told = part(shown[2], ":"), part(shown[7], ":"), part(shown[7], " ")
        time = _ts("right(split_part(c0, '.', 1), 19)", "dd/MM/yyyy HH:mm:ss")
    elif "File name" in head.lines[0]:
        header, first = head.table(1)
        labels = [h for h in header[1:] if h]
        edges = [*(float(x.split("-")[0]) * 1000 for x in labels[:-1]), 32_000.0, 34_000.0]
        told = part(head.cells(0)[2], " ")
        time = _ts("if(length(trim(c0)) <= 10, concat(trim(c0), ' 12:00:00 AM'), c0)", "M/d/yyyy hh:mm:ss a", "M/d/yyyy h:mm:ss a")
        serial, place = "Unknown", None
    else:
        raise ValueError("neither export of this instrument")
    mids = _middle(edges)
    norm = _grimm_norm(told, mids)
    bins = [f"{_num(k + 1)} / {n!r}D" for k, n in enumerate(norm)]
    return Layout(header, first, time, _sized("Grimm", serial, Moment.NUMBER, Scale.NONE, edges, mids, location=place), bins=bins, complete=True)


def nanoscan(head: Head) -> Layout:
    header, first = head.table(5)
    dropped = {k for k, h in enumerate(header) if h in ("File Index", "Sample #", "Total Conc")}
    left = [k for k in range(len(header)) if k not in dropped]
    bins = left[1:14]
    mids = [float(header[k]) for k in bins]
    density = next((float(head.cells(first)[k]) for k, h in enumerate(header) if h.startswith("Particle Density")), 1.0)
    moment, scale = _described(head.cells(5)[0].split(" ")[0])  # fixed places, blank lines counted
    serial = (head.cells(2) + [None, None])[1]
    time = _at(header, "Date Time")
    return Layout(header, first, _ts(f"c{time}", "yyyy/MM/dd HH:mm:ss"), _sized("NanoScan", serial, moment, scale, _rounded(_geometric(mids, 10.0, 420.0)), _rounded(mids), density), bins=[_num(k) for k in bins], extra=_others(header, {time, *bins} | dropped))


def opcn3(head: Head) -> Layout:
    header, first = head.table(0)
    bins = range(1, 25)
    edges = [*(float(header[k].lower().replace("bin", "")) * 1000 for k in bins), 40_000.0]
    period, flow = (next(k for k, h in enumerate(header) if w in h.replace(" ", "")) for w in ("Period", "FlowRate"))
    volume = f"({_num(period)} / 100 * ({_num(flow)} / 100))"
    serial = next((head.cells(first)[k] for k, h in enumerate(header) if "erial" in h), None)
    return Layout(header, first, _ts("substring(c0, 1, 19)", "yyyy-MM-dd'T'HH:mm:ss"), _sized("OPC-N3", serial, Moment.NUMBER, Scale.NONE, edges, _middle(edges)), bins=[f"try_divide({_num(k)}, {volume})" for k in bins], extra=_others(header, {0, *bins}), complete=True)


def ops(head: Head) -> Layout:
    """Export of the software (begins with Sample File) or direct from the instrument (begins with Instrument Name)."""
    start_cell = head.cells(0)[0]
    if start_cell.startswith("Instrument Name"):
        known = head.pairs(36)
        header, first = head.table(next(k for k, line in enumerate([x for x in head.lines if x.strip()]) if line.startswith("Elapsed Time")))
        edges = [float(known[f"Bin {k} Cut Point (um)"]) * 1000 for k in range(1, 18)]
        h, m, s = map(int, next(v for k, v in known.items() if k.startswith("Sample Interval")).split(":"))
        dead, elapsed = _at(header, "Deadtime (s)"), _at(header, "Elapsed Time [s]")
        bins = [_at(header, f"Bin {k}") for k in range(1, 17)]
        start = datetime.strptime(f"{known['Test Start Date']} {known['Test Start Time']}", "%Y/%m/%d %H:%M:%S")
        live = f"(16.67D * (step - {_num(dead)}))"
        meta = _sized("OPS", known.get("Serial Number"), Moment.NUMBER, Scale.NONE, edges, _rounded(_middle(edges)), float(known.get("Density", 1.0)))
        return Layout(header, first, _since(f"{_num(elapsed)}"), meta, bins=[f"try_divide({_num(k)}, {live})" for k in bins], extra=_others(header, {elapsed, *bins}), start=start, step=float(3600 * h + 60 * m + s))
    if not start_cell.startswith("Sample File"):
        raise ValueError("neither export of this instrument")
    known = head.pairs(13)
    header, first = head.table(13)
    lower, upper = head.cells(10), head.cells(11)
    edges = [*(float(v) * 1000 for v in lower[17:-1] if v), float([v for v in upper if v][-1] if upper[-2] == "" else upper[-2]) * 1000]
    bins = range(17, 17 + len(edges) - 1)
    mids = [float(header[k]) * 1000 for k in bins]
    weight = next((v for k, v in known.items() if "Weight" in k), "Number")
    units = next((v for k, v in known.items() if "Units" in k or "Type" in k), "")
    moment, scale = _described(weight, units)
    day, clock = _at(header, "Date"), _at(header, "Start Time")
    density = next((float(v) for k, v in known.items() if k.startswith("Density") or k.startswith("Particle Density")), 1.0)
    serial = next((v for k, v in known.items() if "Serial" in k), None)
    return Layout(header, first, _ts(f"concat(c{day}, ' ', c{clock})", "MM/dd/yyyy HH:mm:ss"), _sized("OPS", serial, moment, scale, edges, _rounded(mids), density), bins=[_num(k) for k in bins], extra=_others(header, {day, clock, *bins}))


def partector(head: Head) -> Layout:
    header, first = head.table(10)
    said = next((re.search(r"Start:?\s*(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2})", line) for line in head.lines[:10] if "Start" in line), None)
    if not said:
        raise ValueError("no start time")
    low = [h.lower() for h in header]
    time, ldsa, tem, flow = (next(k for k, h in enumerate(low) if h.startswith(w)) for w in ("time", "ldsa", "tem", "flow"))
    meta = SeriesMeta("Partector", head.lines[0].strip()[-3:], {"ldsa": "nm²/cm³", "flow": "l/min"}, kinds={"ldsa": "dS"})
    return Layout(header, first, _since(_num(time)), meta, {"ldsa": _num(ldsa), "tem": _num(tem), "flow": _num(flow)}, extra=_others(header, {time, ldsa, tem, flow}), start=datetime.strptime(said[1], "%d.%m.%Y %H:%M:%S"))


def smps(head: Head) -> Layout:
    known = head.pairs(25, "," if "," in head.lines[0] and head.sep == "," else head.sep)
    header, first = head.table(25)
    grid = {round(10 ** ((k - 0.5) / 64), 1): k for k in range(1, 320)}
    labels = [(k, float(h)) for k, h in enumerate(header) if re.fullmatch(r"\d+(\.\d+)?", h)]
    bins = [(k, v, grid[round(v, 1)]) for k, v in labels if round(v, 1) in grid and k >= 7]
    if not bins:
        raise ValueError("no columns of sizes")
    edge = lambda k: round(10 ** ((k - 1) / 64), 2)
    edges = [*(edge(n) for _, _, n in bins), edge(bins[-1][2] + 1)]
    moment, scale = _described(known.get("Weight", "Number"), known.get("Units", ""))
    serial = "-".join(v for k, v in known.items() if "Model" in k or "Serial" in k) or None
    density = next((float(v) for k, v in known.items() if k.startswith("Density")), 1.0)
    day, clock = _at(header, "Date"), _at(header, "Start Time")
    return Layout(header, first, _ts(f"concat(c{day}, ' ', c{clock})", "dd/MM/yyyy HH:mm:ss"), _sized("SMPS", serial, moment, scale, edges, [v for _, v, _ in bins], density, **known), bins=[_num(k) for k, _, _ in bins], extra=_others(header, {day, clock, *(k for k, _, _ in bins)}))


DIALECTS: dict[str, Callable[[Head], Layout]] = {f.__name__: f for f in (aethalometer, cpc, discmini, elpi, fmps, fourtec, grimm, nanoscan, opcn3, ops, partector, smps)}


def layout(dialect: str | Callable[[Head], Layout], text: str, sep: str) -> Layout:
    """By the name of a dialect, or by a function of one's own."""
    own = dialect if callable(dialect) else DIALECTS.get(dialect)
    try:
        made = (own or DIALECTS[dialect])(Head(text, sep))
    except KeyError as error:
        if own is None:
            raise ValueError(f"unknown dialect {dialect!r}; one of {', '.join(DIALECTS)}") from None
        raise ValueError(f"the preamble lacks {error}") from None
    except (IndexError, StopIteration) as error:
        raise ValueError(f"the preamble isn't that of {dialect}") from error
    width = max(len(made.header), 1)
    return replace(made, header=made.header[:width])
