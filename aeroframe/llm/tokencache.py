"""Exact tokenizer ids with a memory of words already encoded.

A text is cut where the tokenizer's own pre-splitting always cuts, whatever
surrounds the place; the pieces are hashed with numpy and only pieces not seen
before by this Python worker go to the tokenizers library. Texts in which an
added token's marker may occur go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from aeroframe.llm.storage import KEPT
from aeroframe.llm.textbytes import LOWER, blocks, span_hashes, text_bytes

#: Pieces remembered by one worker; beyond it the memory starts afresh.
REMEMBERED = 1_500_000

# Classes of bytes: space, other white space, letter, digit, other ASCII sign, apostrophe, anything else.
_S, _W, _L, _D, _P, _A, _U = range(7)
_CLASS = np.full(256, _U, np.uint8)
_CLASS[0x21:0x7F] = _P
_CLASS[[*range(0x30, 0x3A)]] = _D
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _L
_CLASS[0x27] = _A
_CLASS[0x20] = _S
_CLASS[0x09:0x0E] = _W
_SLOT_BITS = 22
_LATIN = np.zeros(256, bool)
_LATIN[[0xC3, 0xC4, 0xC5]] = True

_KNOWN = (_L, _D, _P, _A)
_PLAIN = (_L, _D, _P)
_CUT_SPACED = np.zeros((8, 8), bool)
_CUT_DROPPED = np.zeros((8, 8), bool)
for _p in _PLAIN:
    for _q in _PLAIN:
        _CUT_SPACED[_p, _q] = _CUT_DROPPED[_p, _q] = _p != _q
for _p in _KNOWN:
    _CUT_SPACED[_p, _S] = _CUT_SPACED[_p, _W] = True

_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+"
_SIMPLE_SPACED = re.compile(rb" ?(?:" + _LETTERS + rb"|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
_SIMPLE_DROPPED = re.compile(_LETTERS + rb"|[!-&(-/:-@\[-`{-~]+")


def _classes(data: np.ndarray) -> np.ndarray:
    found = _CLASS[data]
    lead = np.flatnonzero(_LATIN[data[:-1]]) if len(data) > 1 else np.zeros(0, np.int64)
    if len(lead):
        after = data[lead + 1]
        # Not the signs of multiplication and division, nor the dotted capital I, whose lower case ends in a mark.
        good = ~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((data[lead] == 0xC4) & (after == 0xB0))
        found[lead[good]] = _L
        found[lead[good] + 1] = _L
    return found


def _high(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - _SLOT_BITS)


def _low(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64((1 << _SLOT_BITS) - 1)


def _room(array: np.ndarray, need: int) -> np.ndarray:
    """The array, longer where needed."""
    return array if need <= len(array) else np.concatenate([array, np.zeros(max(need - len(array), len(array)), array.dtype)])


class WordMemory:
    """Encodes whole texts with one tokenizer file. ``drops_space``: white space makes no token and case doesn't count."""

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.width = np.zeros(size, np.int64)
        self.closes = np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
            self.closes[i] = token.endswith("</w>")
        marks = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.mark = re.compile("|".join(map(re.escape, sorted(marks))).encode()) if marks else None
        self.forget()

    def forget(self) -> None:
        """Entry 0 stands for none. Two tables lead from bits of the hash to an entry; what fits in neither is in a dict."""
        self.keys = np.zeros(1 << 16, np.uint64)
        self.seconds = np.zeros(1 << 16, np.uint64)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.entries = 1
        self.by_high = np.zeros(1 << _SLOT_BITS, np.int32)
        self.by_low = np.zeros(1 << _SLOT_BITS, np.int32)
        self.others: dict[int, int] = {}
        self.clashing: dict[tuple[int, int], int] = {}  # pieces whose first hash another piece has
        self.ids = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _find(self, keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """Entries of pieces by both hashes; 0 for pieces not known."""
        entry = self.by_high[_high(keys)]
        miss = np.flatnonzero(self.keys[entry] != keys)
        if len(miss):
            entry[miss] = self.by_low[_low(keys[miss])]
            still = miss[self.keys[entry[miss]] != keys[miss]]
            entry[still] = [self.others.get(k, 0) for k in keys[still].tolist()]
        wrong = np.flatnonzero((entry != 0) & (self.seconds[entry] != seconds))
        if len(wrong):
            entry[wrong] = [self.clashing.get(k, 0) for k in zip(keys[wrong].tolist(), seconds[wrong].tolist(), strict=True)]
        return entry

    def _first_hash(self, keys: np.ndarray) -> np.ndarray:
        """Whether a piece with this first hash is known."""
        known = (self.keys[self.by_high[_high(keys)]] == keys) | (self.keys[self.by_low[_low(keys)]] == keys)
        known[~known] = [k in self.others for k in keys[~known].tolist()]
        return known

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, cut at documents as well."""
        kinds = _classes(data)
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        table = (_CUT_DROPPED if self.drops_space else _CUT_SPACED).ravel()
        cut[1:n] |= table[(kinds[:-1] << 3) | kinds[1:]]
        white = kinds <= _W
        if self.drops_space:
            cut[1:n] |= white[1:] != white[:-1]
            edges = np.flatnonzero(cut)
            starts, ends = edges[:-1], edges[1:]
            keep = ~white[starts]
            return starts[keep], ends[keep]
        inside = np.ones(n + 1, bool)
        inside[offsets] = False  # the neighbours belong to the same document
        known = (kinds >= _L) & (kinds <= _A)
        # A space before a visible sign always opens a piece.
        cut[1 : n - 1] |= (kinds[1:-1] == _S) & known[2:] & inside[2:n]
        # One line break between two visible signs is a piece alone.
        cut[2:n] |= known[2:] & (kinds[1:-1] == _W) & known[:-2] & inside[1 : n - 1]
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def _learn(self, keys: np.ndarray, seconds: np.ndarray, pieces: list[bytes]) -> None:
        simple = _SIMPLE_DROPPED if self.drops_space else _SIMPLE_SPACED
        joint = np.fromiter((simple.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        lists: list = [None] * len(pieces)
        where = np.flatnonzero(joint)
        for at in range(0, len(where), 2000):
            part = where[at : at + 2000]
            made = self._joint([pieces[i] for i in part])
            if made is None:
                joint[part] = False
            else:
                for i, ids in zip(part, made, strict=True):
                    lists[i] = ids
        rest = np.flatnonzero(~joint)
        if len(rest):
            for i, e in zip(rest, self.tokenizer.encode_batch([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
                lists[i] = np.array(e.ids, self.dtype)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists)
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        a, b = self.entries, self.entries + len(keys)
        for name in ("keys", "seconds", "first", "count"):
            setattr(self, name, _room(getattr(self, name), b))
        self.keys[a:b], self.seconds[a:b], self.count[a:b], self.first[a:b] = keys, seconds, count, self.used + np.cumsum(count) - count
        self.entries, self.used = b, self.used + len(flat)
        entry = np.arange(a, b, dtype=np.int32)
        _, lone = np.unique(keys, return_index=True)
        known = self._first_hash(keys[lone])
        plain = np.zeros(len(keys), bool)
        plain[lone[~known]] = True
        self.clashing.update(zip(zip(keys[~plain].tolist(), seconds[~plain].tolist(), strict=True), entry[~plain].tolist(), strict=True))
        keys, entry = keys[plain], entry[plain]
        for table, slots in ((self.by_high, _high), (self.by_low, _low)):
            slot = slots(keys)
            free = table[slot] == 0
            table[slot[free]] = entry[free]
            rest = table[slot] != entry
            keys, entry = keys[rest], entry[rest]
        self.others.update(zip(keys.tolist(), entry.tolist(), strict=True))

    def _joint(self, pieces: list[bytes]) -> list[np.ndarray] | None:
        """Ids of pieces encoded as one text of lines, or None where they can't be told apart."""
        text = b"\n".join(pieces).decode()
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        if self.drops_space:
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(pieces) or ends[-1] != len(ids):
                return None
            return np.split(ids, ends[:-1])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(size + 1)  # byte after each line break
        done = np.cumsum(self.width[ids])
        if done[-1] != stops[-1] - 1:
            return None
        ends = np.searchsorted(done, stops - 1) + 1  # tokens up to the end of each piece
        if (done[ends - 1] != stops - 1).any() or (self.width[ids[ends[:-1]]] != 1).any():
            return None
        starts = np.concatenate([[0], ends[:-1] + 1])
        return [ids[a:b] for a, b in zip(starts, ends, strict=True)]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and how many each has."""
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(docs, np.int64)
        data = LOWER[data] if self.drops_space else data
        starts, ends = self._cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(docs, np.int64)
        keys, seconds = span_hashes(data, starts, ends)
        if self.entries > REMEMBERED:
            self.forget()
        entry = self._find(keys, seconds)
        new = np.flatnonzero(entry == 0)
        if len(new):
            order = new[np.lexsort((seconds[new], keys[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (keys[order[1:]] != keys[order[:-1]]) | (seconds[order[1:]] != seconds[order[:-1]])
            sample, raw = order[fresh], data.tobytes()
            self._learn(keys[sample], seconds[sample], [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)])
            entry[new] = self._find(keys[new], seconds[new])
        count = self.count[entry].astype(np.int64)
        total = np.cumsum(count)
        flat = self.ids[np.repeat(self.first[entry] - total + count, count) + np.arange(total[-1] if len(total) else 0)]
        owner = np.searchsorted(offsets, starts, "right") - 1
        return flat, np.bincount(owner, weights=count, minlength=docs).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and each text's number of ids. Null is empty."""
        offsets, data = text_bytes(column)
        parts, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i, j in blocks(offsets):
            own, piece = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            if self.mark is not None and self.mark.search(piece):
                for a, b in zip(own[:-1], own[1:], strict=True):
                    if self.mark.search(text := piece[a:b].tobytes()):
                        ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)
                        parts.append(ids)
                        counts.append(np.array([len(ids)]))
                    else:
                        ids, n = self._block(piece[a:b], np.array([0, b - a]))
                        parts.append(ids)
                        counts.append(n)
            else:
                ids, n = self._block(piece, own)
                parts.append(ids)
                counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)


def memory(path: str, drops_space: bool) -> WordMemory:
    """This worker's memory for a tokenizer file."""
    if (path, drops_space) not in KEPT:
        KEPT[path, drops_space] = WordMemory(path, drops_space)
    return KEPT[path, drops_space]
