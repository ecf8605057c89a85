"""Vectorised work on the UTF-8 bytes of Arrow text columns: words, hashes, shingles.

Texts stay in Arrow buffers; numpy sees them as one byte array with offsets,
so no Python string is made for a word. Blocks of whole documents of about
``BLOCK`` bytes bound the memory of a task; a longer document is a block alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19

_MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, n + 1, from 0) and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents with about ``size`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LONG = 64  # bytes from which a span is hashed by itself
_SEEDS = (0xD6E8FEB86659FD93, 0xA3B195354A39B70D)
_STEPS = (0x9FB21C651E98DF25, 0xD1342543DE82EF95)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[s:e] for each span.

    Words of eight bytes are chained through ``mix``, which isn't linear; spans
    of more than ``_LONG`` bytes get a keyed BLAKE2 digest each.
    """
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes, or the ``left`` ones of them."""
        return word[at] & (np.uint64(_MASK) >> (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)))

    state = [mix(size.astype(np.uint64) * np.uint64(seed) + np.uint64(seed)) for seed in _SEEDS]
    rows = np.flatnonzero((size > 0) & (size <= _LONG))
    done = 0
    while len(rows):
        own = part(starts[rows] + done, size[rows] - done)
        for k, step in enumerate(_STEPS):
            state[k][rows] = mix((state[k][rows] ^ own) * np.uint64(step))
        done += 8
        rows = rows[size[rows] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=b"span").digest()
        state[0][i], state[1][i] = np.frombuffer(digest, "<u8")
    return state[0], state[1]


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ``white`` (space and 9-13), cut at documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~white[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    last[inner - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[s:e] of each span, which must be UTF-8, as an Arrow string array."""
    size = (ends - starts).astype(np.int64)
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.repeat(starts - (stop - size), size) + np.arange(total)
    offsets = np.concatenate([[0], stop])
    kind, offsets = (pa.large_string(), offsets.astype(np.int64)) if total >= 1 << 31 else (pa.string(), offsets.astype(np.int32))
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


_WEIGHTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xB42F5CD7A7D3A5C1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of each distinct k-word shingle, sorted by document, then hash.

    ASCII letters are lower-cased. A document of 1 to k - 1 words has its whole
    word sequence as one shingle; one without words has none.
    """
    docs = len(offsets) - 1
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words, _ = span_hashes(data, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(owner, minlength=docs)
    begin = np.cumsum(count) - count
    n = len(words)
    made = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        made[: n - j] += words[j:] * np.uint64(_WEIGHTS[j])
    whole = np.flatnonzero(np.arange(n) - begin[owner] <= count[owner] - k)
    hashes, owners = mix(made[whole]), owner[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += words[begin[short[has]] + j] * np.uint64(_WEIGHTS[j])
        extra = mix(extra ^ (count[short].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        hashes, owners = np.concatenate([hashes, extra]), np.concatenate([owners, short])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owners[order], kind="stable")]
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return owners[fresh], hashes[fresh]
