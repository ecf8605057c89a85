import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aeroframe.llm import media


def padded(raw):
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode(raws):
    return media.encode_payloads(np.array([len(r) for r in raws]), np.frombuffer(b"".join(map(padded, raws)), np.uint8))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=6))
def test_bytes_come_back(raws):
    for raw, images in zip(raws, media.thumbnails(encode(raws)), strict=True):
        assert b"".join(g.tobytes() for _, g in images) == padded(raw)


def test_extremes_come_back():
    rng = np.random.default_rng(0)
    raws = [bytes(64), b"\xff" * 640, bytes([0, 255] * 320), rng.integers(0, 256, 64 * (media.MOST_ROWS + 3)).astype(np.uint8).tobytes()]
    found = media.thumbnails(encode(raws))
    assert [b"".join(g.tobytes() for _, g in images) for images in found] == raws
    assert [len(images) for images in found] == [1, 1, 1, 2] and found[3][0][0].height == 8 * media.MOST_ROWS


# The codes of DC categories 0 to 8 in the standard's example table for luminance, and that table.
DC_CODES = "00 010 011 100 101 110 1110 11110 111110".split()
DC_TABLE = bytes([0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, *range(9)])


def _segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _foreign(ac_symbol=0x11, colour=False):
    """A file of another layout, written bit by bit: AC coefficients, no restart intervals, two components."""
    bits = ""

    def block(diff):
        nonlocal bits
        n = abs(diff).bit_length()
        bits += DC_CODES[n] + (f"{diff if diff > 0 else diff + (1 << n) - 1:0{n}b}" if n else "")
        bits += "01" + "1" + "00"  # a coefficient of size 1, and the end of the block

    luma = [5, -3, 100, -128, 7, 7, 0, 1]
    last, chroma = 0, 0
    groups = [luma[i : i + 4] for i in range(0, 8, 4)] if colour else [[v] for v in luma]
    for group in groups:
        for v in group:
            block(v - last)
            last = v
        if colour:
            block(9 - chroma)
            chroma = 9
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    parts = [(1, 0x22 if colour else 0x11, 0)] + ([(2, 0x11, 0)] if colour else [])
    size = (16, 32) if colour else (8, 64)
    sof = bytes([8, *size[0].to_bytes(2, "big"), *size[1].to_bytes(2, "big"), len(parts)]) + b"".join(bytes(p) for p in parts)
    sos = bytes([len(parts)]) + b"".join(bytes([p[0], 0]) for p in parts) + bytes([0, 63, 0])
    tables = _segment(0xC4, b"\x00" + DC_TABLE) + _segment(0xC4, bytes([0x10, 0, 2, *[0] * 14, 0x00, ac_symbol]))
    return b"\xff\xd8" + _segment(0xDB, bytes([0, 8, *[1] * 63])) + _segment(0xC0, sof) + tables + _segment(0xDA, sos) + scan + b"\xff\xd9", luma


def plain_images(data):
    """Width, height and thumbnail of each image of one component, read bit by bit after the standard."""
    at, images = 0, []
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xd8"
        at, interval, codes, marker = at + 2, None, {}, None
        while marker != 0xDA:
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xC4:
                kind, counts, symbols, word = body[0], body[1:17], iter(body[17:]), 0
                codes[kind] = {}
                for n in range(16):
                    for _ in range(counts[n]):
                        codes[kind][f"{word:0{n + 1}b}"] = next(symbols)
                        word += 1
                    word *= 2
            elif marker == 0xC0:
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            elif marker == 0xDB:
                quant = body[1]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
        runs = [""]
        while data[at : at + 2] != b"\xff\xd9":
            if data[at] == 0xFF and data[at + 1]:
                runs.append("")
                at += 2
                continue
            runs[-1] += f"{data[at]:08b}"
            at += 2 if data[at] == 0xFF else 1
        at += 2
        across, total = -(-width // 8), -(-width // 8) * -(-height // 8)
        levels = []
        for run in runs:
            where, level = 0, 0

            def symbol(kind):
                nonlocal where
                end = where + 1
                while run[where:end] not in codes[kind]:
                    assert end <= len(run)
                    end += 1
                found, where = codes[kind][run[where:end]], end
                return found

            for _ in range(min(interval or total, total - len(levels))):
                n = symbol(0x00)
                if n:
                    value = int(run[where : where + n], 2)
                    level += value if run[where] == "1" else value - 2**n + 1
                    where += n
                levels.append(level)
                k = 1
                while k < 64:
                    both = symbol(0x10)
                    if both == 0:
                        break
                    k, where = k + (both >> 4) + 1, where + (both & 15)
        assert len(levels) == total
        gray = [min(255, max(0, round(v * quant / 8) + 128)) for v in levels]
        images.append((width, height, [gray[i : i + across] for i in range(0, total, across)]))
    return images


def plain_hash(gray):
    """Means of 8 x 9 cells, summed sample by sample, each against the next one."""
    high, wide, bits = len(gray), len(gray[0]), ""

    def cell(k, parts, most):
        end = min(most, max((k + 1) * most // parts, k * most // parts + 1))
        return range(min(k * most // parts, end - 1), end)

    for i in range(8):
        means = []
        for j in range(9):
            own = [gray[y][x] for y in cell(i, 8, high) for x in cell(j, 9, wide)]
            means.append(Fraction(sum(own), len(own)))
        bits += "".join("1" if a < b else "0" for a, b in zip(means, means[1:], strict=False))
    return f"{int(bits, 2):016x}"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=4))
def test_files_read_by_a_plain_decoder(raws):
    """With images of at most three rows of blocks, so that most payloads have several."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(media, "MOST_ROWS", 3)
        files = encode(raws)
    for raw, data, found in zip(raws, files, media.thumbnails(files), strict=True):
        images = plain_images(data)
        assert bytes(v for _, _, gray in images for row in gray for v in row) == padded(raw)
        assert [(w, h, g) for w, h, g in images] == [(f.width, f.height, g.tolist()) for f, g in found]
        assert [plain_hash(g) for _, _, g in images] == [media.difference_hash(g) for _, g in found]


def test_features_by_a_plain_decoder(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "a", "ü" * 333, *("".join(map(chr, rng.integers(1, 0x2FF, n))) for n in (63, 64, 65, 700, 5000))]
    stored = media.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    rows = {r.doc_id: r for r in media.features(spark.createDataFrame(stored, "doc_id long, media binary")).collect()}
    for i, data in stored:
        ((width, height, gray),) = plain_images(bytes(data))
        raw, r = bytes(v for row in gray for v in row), rows[i]
        assert raw == padded((texts[i] or "").encode())
        assert (r.feature, r.payload_sha256, r.media_sha256) == (f"{width}x{height}x1:{plain_hash(gray)}", hashlib.sha256(raw).hexdigest(), hashlib.sha256(data).hexdigest())


def test_other_layouts():
    data, luma = _foreign()
    ((frame, gray),) = media.thumbnails([data])[0]
    assert (frame.width, frame.height) == (64, 8) and (gray.ravel().astype(int) - 128).tolist() == luma
    assert plain_images(data) == [(64, 8, gray.tolist())]
    data, luma = _foreign(colour=True)
    ((_, gray),) = media.thumbnails([data])[0]
    assert (gray.astype(int) - 128).tolist() == [[5, -3, 7, 7], [100, -128, 0, 1]]


def test_broken_files_dont_spoil_others():
    good = encode([b"hello"])[0]
    cut, no = good[:-10], b"plain"
    found = media.thumbnails([good, cut, no, None, good[:2] + b"\xff\xc2\x00\x04ab"])
    assert found[0][0][1].tobytes() == padded(b"hello") and all(isinstance(x, str) for x in found[1:])


def test_columns(spark):
    texts = [None, "", "a", "ä" * 100, "x" * 64, "long text " * 60_000, "same", "same"]
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("media", F.lit("clash"))
    rows = media.features(media.encode_texts(docs)).collect()
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), by[i if i != 4 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded(raw)), hashlib.sha256(padded(raw)).hexdigest(), zlib.crc32(padded(raw)[-64:]))
    assert by[6][1:] == by[7][1:] and by[5].images == 2 and by[0][1:] == by[1][1:]
    assert media.features(media.encode_texts(docs.limit(0))).count() == 0
    broken = media.features(spark.createDataFrame([(1, None), (2, bytearray(b"x"))], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert broken[0].error and broken[1].error and broken[1].media_bytes == 1 and broken[1].feature is None


def test_feature_covers_every_image(spark):
    same = "x" * (64 * media.MOST_ROWS)
    up = "".join(map(chr, range(40, 104)))
    texts = [same + up, same + up[::-1], same + up * 2, same]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = media.features(media.encode_texts(docs)).orderBy("doc_id").collect()
    assert [r.images for r in rows] == [2, 2, 2, 1] and len({r.feature for r in rows}) == 4
    first = f"512x{8 * media.MOST_ROWS}x"
    hashes = [media.difference_hash(np.frombuffer(t.encode(), np.uint8).reshape(-1, 64)) for t in (same, up, up[::-1], up * 2)]
    assert [r.feature for r in rows] == [f"{first}2:{hashes[0]}+512x8:{hashes[1]}", f"{first}2:{hashes[0]}+512x8:{hashes[2]}", f"{first}2:{hashes[0]}+512x16:{hashes[3]}", f"{first}1:{hashes[0]}"]


def test_hash_follows_brightness():
    ramp = np.tile(np.arange(64, dtype=np.uint8), (8, 1))
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8
    assert len(media.difference_hash(np.zeros((1, 1), np.uint8))) == 16
