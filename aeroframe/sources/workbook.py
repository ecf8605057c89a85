"""Workbooks (zipped XML) read and written with the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from datetime import date, datetime, time, timedelta
from decimal import Decimal
from io import BytesIO
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Rows that a sheet holds, its header included.
SHEET_ROWS = 1 << 20
#: Numbers of the built-in formats of dates and times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_DAY = timedelta(days=1)


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element: ElementTree.Element) -> str:
    """The text of a cell or shared string, without readings of it."""
    out = []
    for child in element:
        if _name(child) == "t":
            out.append(child.text or "")
        elif _name(child) == "r":
            out.append(_texts(child))
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(out))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """Whether each style of cells shows a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for item in root.iter():
        if _name(item) == "numFmt":
            bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", item.get("formatCode", ""))
            own[int(item.get("numFmtId", 0))] = bool(re.search("[dmyhs]", bare, re.I))
    for item in root:
        if _name(item) == "cellXfs":
            numbers = [int(x.get("numFmtId", 0)) for x in item]
            return [own.get(k, k in _DATE_FORMATS) for k in numbers]
    return []


def _moment(serial: float, from_1904: bool) -> datetime | time:
    """A serial number as a time: days since the end of 1899, or since 1904; below one, a time of day."""
    micros = round(serial * 86_400_000) * 1000
    if serial < 1 and not from_1904:
        return (datetime.min + timedelta(microseconds=micros)).time()
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if serial >= 61 else datetime(1899, 12, 31)
    return start + timedelta(microseconds=micros)


def _column(reference: str) -> int:
    at = 0
    for sign in reference:
        if not sign.isalpha():
            break
        at = at * 26 + ord(sign.upper()) - 64
    return at - 1


def sheets(content: bytes | BinaryIO) -> list[str]:
    """Names of a workbook's sheets, in order."""
    with zipfile.ZipFile(BytesIO(content) if isinstance(content, bytes) else content) as book:
        return [x.get("name", "") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _name(x) == "sheet"]


def read_sheet(content: bytes | BinaryIO, sheet: int = 0) -> Iterator[list[object]]:
    """Rows of a sheet: text, numbers as they are written, booleans, dates and times; None where a cell is empty.

    Rows and cells that the file leaves out are filled in, so that places count.
    Errors of formulas are None. Not a workbook: ValueError.
    """
    try:
        book = zipfile.ZipFile(BytesIO(content) if isinstance(content, bytes) else content)
        listed = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        raise ValueError(f"not a workbook: {error}") from None
    with book:
        from_1904 = any(_name(x) == "workbookPr" and x.get("date1904") in ("1", "true") for x in listed.iter())
        ids = [next(v for k, v in x.attrib.items() if k.endswith("}id")) for x in listed.iter() if _name(x) == "sheet"]
        target = links[ids[sheet]]
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)

        def value(cell: ElementTree.Element) -> object:
            kind, said = cell.get("t", "n"), None
            for child in cell:
                if _name(child) == "v":
                    said = child.text
                elif _name(child) == "is":
                    return _texts(child)
            if said is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(said)]
            if kind == "b":
                return said.strip() == "1"
            if kind == "d":
                return datetime.fromisoformat(said)
            style = int(cell.get("s", 0))
            if kind == "n" and style < len(dates) and dates[style]:
                return _moment(float(said), from_1904)
            return said

        with book.open(target[1:] if target.startswith("/") else f"xl/{target}") as stream:
            place = 0
            parent = None
            for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                if event == "start":
                    parent = element if _name(element) == "sheetData" else parent
                    continue
                if _name(element) != "row":
                    continue
                at = int(element.get("r", place + 1))
                while place + 1 < at:
                    place += 1
                    yield []
                row: list[object] = []
                for cell in element:
                    where = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (where - len(row))
                    row.append(value(cell))
                place = at
                yield row
                if parent is not None:
                    parent.clear()


# Writing

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_RELATION = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_BOOK = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{}</sheets></workbook>'
_SHEET = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
#: Styles by number: plain, date and time, date, time of day.
_STYLES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss.000"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="21" applyNumberFormat="1"/></cellXfs></styleSheet>'
_UNSAID = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_x[0-9A-Fa-f]{4}_")


def _escaped(text: str) -> str:
    """XML can't say control signs; they are written as _x0001_, and so is the first sign of what looks like that."""
    return escape(_UNSAID.sub(lambda m: f"_x{ord(m[0][0]):04X}_" + m[0][1:], text))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)) or isinstance(value, float) and value - value == 0:
        return f"<c><v>{value!r}</v></c>" if isinstance(value, float) else f"<c><v>{value}</v></c>"
    if isinstance(value, datetime) and value.year >= 1900 and value.tzinfo is None:
        return f'<c s="1"><v>{(value - datetime(1899, 12, 30)) / _DAY!r}</v></c>'
    if isinstance(value, date) and not isinstance(value, datetime) and value.year >= 1900:
        return f'<c s="2"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(str(value))}</t></is></c>'


def write_workbook(target: BinaryIO, header: Sequence[str], rows: Iterable[Sequence[object]], sheet_rows: int = SHEET_ROWS) -> int:
    """A workbook of rows that come one by one; returns the number of its sheets.

    A further sheet, with the header again, begins where one is full; no row is
    held longer than it takes to write it.
    """
    left = iter(rows)
    top = "<row>" + "".join(map(_cell, header)) + "</row>"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=3) as book:
        count, row = 0, next(left, None)
        while row is not None or not count:
            count += 1
            with book.open(f"xl/worksheets/sheet{count}.xml", "w", force_zip64=True) as out:
                out.write((_SHEET + top).encode())
                for _ in range(sheet_rows - 1):
                    if row is None:
                        break
                    out.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
                    row = next(left, None)
                out.write(b"</sheetData></worksheet>")
        numbers = range(1, count + 1)
        book.writestr("xl/styles.xml", _STYLES)
        book.writestr("xl/workbook.xml", _BOOK.format("".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>' for k in numbers)))
        book.writestr("xl/_rels/workbook.xml.rels", _RELATIONS.format("".join(_RELATION.format(k, "worksheet", f"worksheets/sheet{k}.xml") for k in numbers) + _RELATION.format(count + 1, "styles", "styles.xml")))
        book.writestr("_rels/.rels", _RELATIONS.format(_RELATION.format(1, "officeDocument", "xl/workbook.xml")))
        book.writestr("[Content_Types].xml", _TYPES.format("".join(map(_SHEET_TYPE.format, numbers))))
    return count
