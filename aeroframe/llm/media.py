"""Operator 2: a media column of baseline JPEG files, read back by DC thumbnails.

``encode_texts`` stores a payload losslessly in the format's own unit: each byte
is the DC level of one 8x8 luminance block (quantiser 8, so that the block's
samples equal the byte), 64 blocks a row, each row a restart interval. A comment
segment holds the length without padding. Payloads beyond one image's height
make several images, one after another.

``features`` parses the markers of stored files, Huffman-decodes their scans
and rebuilds the DC-only luminance thumbnail: all restart intervals of a batch
of files with the same tables advance together, a symbol a step, in numpy. It
reads any baseline file of 8 bits with one scan for its components, AC
coefficients included (they are decoded and passed over).

A null or empty text is a payload of 64 zero bytes. A null media value, or one
that isn't a baseline JPEG, has null features and an error text. Repeated rows
give equal values, and so do rows that tie in their text. A very long text is
several images, made one by one. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.storage import small_batches
from aeroframe.llm.textbytes import blocks, text_bytes

ROW = 64  # blocks in a row of an image, and bytes that payloads are padded to
MOST_ROWS = 8191  # 8 * 8191 lines fit the format's 16 bits
_WIDE = 112  # bytes a row may take before stuffing: 64 codes of 13 bits, padding and a marker

# DC categories 0 to 8: six codes of 3 bits for the frequent ones, three of 4 bits.
_DC_SYMBOLS = [2, 3, 4, 5, 6, 7, 0, 1, 8]
_DC_COUNTS = [0, 0, 6, 3] + [0] * 12
_AC_COUNTS, _AC_SYMBOLS = [1] + [0] * 15, [0]  # end of block alone


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical code and its length for each symbol."""
    code, out, at = 0, {}, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """For each difference of levels (-255..255): the block's bits with its end of block, and how many."""
    codes = _codes(_DC_COUNTS, _DC_SYMBOLS)
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        code, length = codes[category]
        extra = diff if diff > 0 else diff + (1 << category) - 1
        bits[diff + 255] = ((code << category | extra) << 1) if category else code << 1
        size[diff + 255] = length + category + 1
    return bits, size


_BITS, _SIZE = _dc_words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, n_bytes: int) -> bytes:
    table = lambda kind, counts, symbols: bytes([kind, *counts, *symbols])
    return b"\xff\xd8" + b"".join((
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, b"bytes=%d" % n_bytes), _segment(0xDB, bytes([0, 8, *[1] * 63])),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, table(0x00, _DC_COUNTS, _DC_SYMBOLS)), _segment(0xC4, table(0x10, _AC_COUNTS, _AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _scan_rows(levels: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of blocks with the marker after each, and where each row ends.

    ``place`` counts rows inside an image, ``last`` marks an image's last one.
    """
    n = len(levels)
    diff = levels.astype(np.int64)
    diff[:, 1:] -= levels[:, :-1]
    diff += 255
    bits, size = _BITS[diff], _SIZE[diff]
    until = np.cumsum(size, axis=1)
    out = np.zeros((n, _WIDE), np.uint8)
    flat, base = out.ravel(), np.arange(n) * _WIDE
    for j in range(ROW):
        start = until[:, j] - size[:, j]
        at = base + (start >> 3)
        word = bits[:, j] << (24 - size[:, j] - (start & 7)).astype(np.uint32)
        flat[at] |= (word >> 16).astype(np.uint8)
        flat[at + 1] |= (word >> 8).astype(np.uint8)
        flat[at + 2] |= word.astype(np.uint8)
    total = until[:, -1]
    length = (total + 7) >> 3
    flat[base + length - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)
    flat[base + length] = 0xFF
    flat[base + length + 1] = np.where(last, 0xD9, 0xD0 + (place & 7))
    column = np.arange(_WIDE)
    used = column < (length + 2)[:, None]
    data = out[used]
    stuffed = (out == 0xFF) & (column < length[:, None])
    after = np.flatnonzero(stuffed[used]) + 1
    return np.insert(data, after, 0), np.cumsum(length + 2 + stuffed.sum(axis=1))


def encode_payloads(sizes: np.ndarray, payload: np.ndarray) -> list[bytes]:
    """JPEG files of texts of ``sizes`` bytes, lying padded one after another in ``payload``."""
    rows = np.maximum(1, -(-sizes // ROW))
    owner = np.repeat(np.arange(len(sizes)), rows)
    place = np.arange(len(owner)) - (np.cumsum(rows) - rows)[owner]
    last = (place % MOST_ROWS == MOST_ROWS - 1) | (place == rows[owner] - 1)
    stream, ends = _scan_rows(payload.reshape(-1, ROW).astype(np.int16) - 128, place % MOST_ROWS, last)
    raw, files, at, row = stream.tobytes(), [], 0, 0
    for size, n in zip(sizes.tolist(), rows.tolist(), strict=True):
        parts = []
        for first in range(0, n, MOST_ROWS):
            take = min(MOST_ROWS, n - first)
            end = int(ends[row + take - 1])
            parts += [_header(take, size), raw[at:end]]
            at, row = end, row + take
        files.append(b"".join(parts))
    return files


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its media file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for i, j in blocks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                sizes = np.diff(own)
                padded = np.maximum(ROW, -(-sizes // ROW) * ROW)
                payload = np.zeros(int(padded.sum()), np.uint8)
                shift = np.cumsum(padded) - padded - own[:-1]
                payload[np.arange(own[-1]) + np.repeat(shift, sizes)] = data[offsets[i] : offsets[j]]
                files = encode_payloads(sizes, payload)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(files, pa.binary())], ["doc_id", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, media binary")


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    interval: int = 0
    quant: dict[int, bytes] = field(default_factory=dict)
    huff: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    parts: list[tuple[int, int, int]] = field(default_factory=list)  # component, h << 4 | v, quantiser
    tables: list[int] = field(default_factory=list)  # DC << 4 | AC of each component
    scan: tuple[int, int] = (0, 0)


def parse(data: bytes) -> list[Frame]:
    """The images of a media value; ValueError if it isn't baseline JPEG."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no start of image at byte {at}")
        frame, at = Frame(), at + 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("quantiser of 16 bits")
                    frame.quant[body[0] & 15], body = body[1:65], body[65:]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.huff[body[0]], body = (tuple(body[1:17]), tuple(body[17 : 17 + n])), body[17 + n :]
            elif marker == 0xC0:
                depth, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("not 8 bits a sample")
                frame.parts = [(body[6 + 3 * k], body[7 + 3 * k], body[8 + 3 * k]) for k in range(n)]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                (frame.interval,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                frame.comment = body
            elif marker == 0xDA:
                named = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if set(named) != {p[0] for p in frame.parts}:
                    raise ValueError("components in several scans")
                frame.tables = [named[p[0]] for p in frame.parts]
                break
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise ValueError("no end of image")
            if data[end + 1] == 0xD9:
                break
            if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                raise ValueError("marker inside a scan")
            end += 2
        frame.scan = (at, end)
        frames.append(frame)
        at = end + 2
    return frames


_lookups: dict = {}


def _lookup(table: tuple[tuple[int, ...], tuple[int, ...]]) -> np.ndarray:
    """By the next 16 bits: code length << 8 | symbol; 0 where no code fits."""
    if table not in _lookups:
        found = np.zeros(1 << 16, np.int32)
        for symbol, (code, length) in _codes(list(table[0]), list(table[1])).items():
            found[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        _lookups[table] = found
    return _lookups[table]


def _plan(frame: Frame) -> tuple[list[int], int, int]:
    """Component of each block of an MCU, and how many MCUs lie across and down."""
    if len(frame.parts) == 1:
        return [0], -(-frame.width // 8), -(-frame.height // 8)
    wide, high = (max(s) for s in zip(*((p[1] >> 4, p[1] & 15) for p in frame.parts), strict=True))
    units = [k for k, p in enumerate(frame.parts) for _ in range((p[1] >> 4) * (p[1] & 15))]
    return units, -(-frame.width // (8 * wide)), -(-frame.height // (8 * high))


def _decode(frames: list[Frame], scans: list[bytes]) -> list[np.ndarray]:
    """DC levels of the first component of images with the same tables: blocks in the order of the scan."""
    first = frames[0]
    units = _plan(first)[0]
    dc = [_lookup(first.huff[t >> 4]) for t in first.tables]
    ac = [_lookup(first.huff[0x10 | t & 15]) for t in first.tables]
    tables = np.concatenate([*dc, *ac])
    data = np.frombuffer(b"".join(scans) + bytes(8), np.uint8)
    escape = np.zeros(len(data), bool)
    escape[:-1] = data[:-1] == 0xFF
    begin = np.cumsum([0, *map(len, scans)])
    restart = np.zeros(len(data), bool)
    restart[:-1] = escape[:-1] & (data[1:] >= 0xD0) & (data[1:] <= 0xD7)
    keep = ~restart
    keep[1:] &= ~escape[:-1]
    plain = data[keep]
    before = np.concatenate([[0], np.cumsum(keep)])
    starts, mcus = [], []
    marks = np.flatnonzero(restart)
    for k, frame in enumerate(frames):
        own = marks[np.searchsorted(marks, begin[k]) : np.searchsorted(marks, begin[k + 1])]
        _, across, down = _plan(frame)
        total = across * down
        step = frame.interval or total
        if len(own) + 1 != -(-total // step):
            raise ValueError("restart intervals missing")
        starts.append(np.concatenate([[before[begin[k]]], before[own + 2]]))
        mcus.append(np.minimum(step, total - step * np.arange(len(own) + 1)))
    bit = np.concatenate(starts) * 8
    want = np.concatenate(mcus) * len(units)
    limit = len(plain) - 4
    wide = plain.astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    unit = np.array(units)
    most = int(want.max())
    levels = np.zeros((len(want), most), np.int16)
    live = np.arange(len(want))
    block, at = np.zeros(len(want), np.int64), np.zeros(len(want), np.int64)
    previous = np.zeros((len(want), len(first.parts)), np.int64)
    while len(live):
        part = unit[block[live] % len(units)] if len(units) > 1 else np.zeros(len(live), np.int64)
        inner = at[live] > 0
        where = bit[live]
        if where.max() >> 3 > limit:
            raise ValueError("scan ends early")
        peek = ((window[where >> 3] << (where & 7).astype(np.uint32)) >> 16).astype(np.int64)
        found = tables[peek + ((part + len(dc) * inner) << 16)]
        if not found.all():
            raise ValueError("no such code")
        symbol = found & 255
        where = where + (found >> 8)
        size = np.where(inner, symbol & 15, symbol)
        extra = ((window[np.minimum(where >> 3, len(window) - 1)] << (where & 7).astype(np.uint32)) >> 16).astype(np.int64) >> (16 - size)
        bit[live] = where + size
        opened = np.flatnonzero(~inner)
        if len(opened):
            own, value, s = live[opened], extra[opened], size[opened]
            value = np.where(value < (1 << s) >> 1, value - (1 << s) + 1, value)
            previous[own, part[opened]] += value
            levels[own, block[own]] = previous[own, part[opened]]
        run = np.where(symbol == 0, 64, (symbol >> 4) + 1)
        at[live] = np.where(inner, at[live] + run, 1)
        over = at[live] >= 64
        done = live[over]
        at[done] = 0
        block[done] += 1
        live = live[block[live] < want[live]]
    out, row = [], 0
    for k in range(len(frames)):
        n = len(starts[k])
        flat = levels[row : row + n][np.arange(most) < want[row : row + n, None]]
        out.append(flat)
        row += n
    return out


def thumbnails(files: list[bytes | None]) -> list[list[tuple[Frame, np.ndarray]] | str]:
    """For each file its images with their DC-only luminance thumbnails, or what is wrong with it."""
    out: list = []
    groups: dict = {}
    for i, data in enumerate(files):
        try:
            frames = parse(data) if data is not None else []
            out.append([None] * len(frames) if frames else "no image")
            for k, frame in enumerate(frames):
                key = (tuple(sorted(frame.huff.items())), tuple(frame.tables), tuple(frame.parts))
                groups.setdefault(key, []).append((i, k, frame, data[frame.scan[0] : frame.scan[1]]))
        except (ValueError, IndexError, KeyError, struct.error) as error:
            out.append(str(error) or "broken")
    for members in groups.values():
        try:
            decoded = _decode([m[2] for m in members], [m[3] for m in members])
        except (ValueError, IndexError, KeyError):
            decoded = []
            for m in members:  # one broken file doesn't spoil the others
                try:
                    decoded += _decode([m[2]], [m[3]])
                except (ValueError, IndexError, KeyError) as error:
                    decoded.append(str(error) or "broken")
        for (i, k, frame, _), levels in zip(members, decoded, strict=True):
            if isinstance(out[i], str):
                continue
            if isinstance(levels, str):
                out[i] = levels
                continue
            units, across, down = _plan(frame)
            h, v = (frame.parts[0][1] >> 4, frame.parts[0][1] & 15) if len(units) > 1 else (1, 1)
            own = levels.reshape(down, across, len(units))[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            gray = np.clip(np.rint(own * (frame.quant[frame.parts[0][2]][0] / 8)) + 128, 0, 255).astype(np.uint8)
            out[i][k] = (frame, gray)
    return out


def difference_hash(gray: np.ndarray) -> str:
    """64 bits: whether a cell of an 8 x 9 grid of means is brighter than the next."""
    rows = np.linspace(0, gray.shape[0], 9).astype(int)
    columns = np.linspace(0, gray.shape[1], 10).astype(int)
    sums = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    sums[1:, 1:] = gray.cumsum(0, dtype=np.float64).cumsum(1)
    top, bottom = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=gray.shape[0])
    top = np.minimum(top, bottom - 1)
    left, right = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1).clip(max=gray.shape[1])
    left = np.minimum(left, right - 1)
    cell = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    mean = cell / ((bottom - top)[:, None] * (right - left)[None, :])
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, images long, width long, height long, error string"


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Dimensions, payload digests and thumbnail hashes, all from the stored bytes.

    ``feature`` has the size and hash of every image, joined by '+'; ``width`` and ``height`` are the first image's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FEATURES.split(", ")]
        for batch in batches:
            ids, stored = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.binary_length(stored), 0).to_numpy()
            edges = np.concatenate([[0], np.cumsum(size)])
            for i, j in blocks(edges):
                files = [x.as_py() for x in stored.slice(i, j - i)]
                rows = []
                for key, data, images in zip(ids.slice(i, j - i).to_pylist(), files, thumbnails(files), strict=True):
                    if isinstance(images, str):
                        rows.append((key, *[None] * 4, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, *[None] * 3, images))
                        continue
                    frame = images[0][0]
                    sizes = [f"{f.width}x{f.height}" for f, _ in images]
                    sizes[0] += f"x{len(images)}"
                    feature = "+".join(f"{size}:{difference_hash(gray)}" for size, (_, gray) in zip(sizes, images, strict=True))
                    payload = b"".join(g.tobytes() for _, g in images)
                    note = frame.comment.decode("latin-1")
                    n = int(note[6:]) if note.startswith("bytes=") and note[6:].isdigit() else len(payload)
                    rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(images), frame.width, frame.height, None))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _FEATURES.split(", ")])
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(read, _FEATURES)
