"""Encoding and delimiter of a text export, from its bytes."""

from __future__ import annotations

import statistics
from collections.abc import Iterator

#: The signs looked for; of equally steady ones the first wins.
DELIMITERS = (",", ";", "\t", "|")


def _rows(text: str) -> Iterator[str]:
    """Lines that hold something and are no comment, the last one first."""
    for line in reversed(text.splitlines()):
        shown = line.strip()
        if shown and shown[0] != "#":
            yield line


def decode(data: bytes, whole: bool = True) -> tuple[str, str]:
    """Text and the name of its encoding: a byte order mark, else UTF-8 if it is valid, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "strict" if whole else "ignore"), name
    try:
        return data.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError as error:
        if not whole and error.start >= len(data) - 3:  # a sign cut in two at the end
            return data[: error.start].decode("utf-8"), "UTF-8"
        return data.decode("latin-1"), "ISO-8859-1"


def delimiter(text: str, sample_lines: int = 10, at_least: int = 3, tolerance: int = 1) -> str:
    """The sign that most of the last lines have about as often as is usual for it."""
    sample = [line for line, _ in zip(_rows(text), range(sample_lines))]
    table = {sign: [line.count(sign) for line in reversed(sample)] for sign in DELIMITERS}

    def steadiness(sign: str) -> int:
        found = table[sign]
        low, high = (statistics.mode(found) + way * tolerance for way in (-1, 1)) if found else (0, 0)
        return len([n for n in found if max(1, low) <= n <= high])

    best = max(DELIMITERS, key=steadiness)
    if steadiness(best) < max(1, at_least):
        raise ValueError("no delimiter found; the file may not be converted to text")
    return best
