"""Operator 13: licence scans with a positional index of rare words.

Templates are passages of known licences, with the phrases that a text must
have to count. Their words are looked up in all documents once, to learn how
many documents have each (``document_counts``); a template's words with the
highest inverse document frequency, and their places, are its postings.

A file's words that are in the index are looked up; a posting at word p of the
file and place q of a template says that the template begins at p - q. Postings
of one template whose beginnings agree, up to ``SLACK`` words put in or left
out, are intersected; where ``NEED`` of them meet, the passage is compared word
by word, and counts where its share of equal words reaches the template's and
every mandatory phrase stands in it. A template indexes so many words that a
passage with the least share has at least ``NEED`` of them (all but the share,
and ``NEED`` more), so no candidate is lost by not indexing the common words.

Names of licences (``mit license`` and the like) are templates of their own
without slack, which must be there in full: the rarest word is looked up and the
others are intersected at their places.

Results for odd input: null and empty texts, and texts without a word, have no
matches and score 0; very long texts are read whole, in a block of their own;
each row is scanned alone, so repeated rows give repeated results; words of
equal frequency are ordered by the word, so the index is the same in reruns; an
empty table gives no rows. Other columns are ignored, whatever their names.
Words are compared by two 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.storage import small_batches
from aeroframe.llm.textbytes import LOWER, blocks, span_hashes, text_bytes, word_spans

#: Words that may be put in or left out between two places that count as aligned; postings that must meet.
SLACK, NEED = 8, 2

_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    """A passage of a licence; ``share`` of its words and all ``phrases`` must be there."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    share: float = 0.75
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


# Names and passages of public licences.
NAMES = (Template("mit", "mit license", share=1, base=True), Template("apache", "apache license", share=1, base=True), Template("gpl", "general public license", share=1, base=True))
PASSAGES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("permission is hereby granted free of charge to any person obtaining a copy", "merge publish distribute sublicense"),
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ("apache org licenses license 2 0", "without warranties or conditions of any kind"),
    ),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license as published by",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license as published by",)),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license as published by",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ("subject to the terms of the mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ("free and unencumbered software released into the public domain",)),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("to alter it and redistribute it freely",),
    ),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ("to any person or organization obtaining a copy", "prepare derivative works")),
    Template("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law", ("dedicated the work to the public domain",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",), share=0.8),
)


@dataclass
class Index:
    """The templates' words by number, and the places of their rare ones."""

    templates: tuple[Template, ...]
    hashes: np.ndarray  # sorted, by word number
    seconds: np.ndarray
    sought: list[np.ndarray]  # word numbers of each template
    phrases: list[list[np.ndarray]]
    rare: list[np.ndarray] = field(default_factory=list)  # places of each template that are indexed
    first: np.ndarray | None = None  # of the postings of each word
    postings: np.ndarray | None = None  # (template, place)

    @classmethod
    def of(cls, templates: Sequence[Template]) -> Index:
        known = sorted({w for t in templates for w in [*t.words, *(w for p in t.phrases for w in words_of(p))]})
        offsets, data = text_bytes(pa.array(known, pa.string()))
        first, second = span_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(first)
        number = {known[k]: i for i, k in enumerate(order.tolist())}
        coded = lambda words: np.array([number[w] for w in words], np.int64)
        return cls(tuple(templates), first[order], second[order], [coded(t.words) for t in templates], [[coded(words_of(p)) for p in t.phrases] for t in templates])

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those in no template."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        one, two = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, one), len(self.hashes) - 1)
        return np.where((self.hashes[at] == one) & (self.seconds[at] == two), at, -1)

    def with_counts(self, documents: np.ndarray) -> Index:
        """Index the rarest words of each template, so many that none can be missed; ties by the word's number."""
        pairs = []
        for k, (template, words) in enumerate(zip(self.templates, self.sought, strict=True)):
            spare = len(words) - int(np.ceil(template.share * len(words) - 1e-9))
            order = np.lexsort((np.arange(len(words)), words, documents[words]))
            self.rare.append(order[: min(len(words), spare + self.need(k))])
            pairs += [(words[q], k, q) for q in self.rare[-1].tolist()]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.hashes) + 1))
        self.postings = pairs[:, 1:]
        return self

    def need(self, k: int) -> int:
        return 1 if self.templates[k].base else NEED

    def matches(self, numbers: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(document, template, first word, words, share) in a block; ``doc`` of each word, ``begin`` of each document and the end."""
        seen = np.flatnonzero(numbers >= 0)
        of = numbers[seen]
        count = self.first[of + 1] - self.first[of]
        seen, of, count = seen[count > 0], of[count > 0], count[count > 0]
        hit = np.repeat(seen, count)
        which = self.postings[np.repeat(self.first[of] - (np.cumsum(count) - count), count) + np.arange(len(hit))]
        template, place = which[:, 0], which[:, 1]
        start = hit - place
        out = []
        for k, sought in enumerate(self.sought):
            own = template == k
            if not own.any():
                continue
            m, at, row = len(sought), start[own], doc[hit[own]]
            if self.templates[k].base:
                whole = (at >= begin[row]) & (at + m <= begin[row + 1])
                at, row = at[whole], row[whole]
                same = (numbers[at[:, None] + np.arange(m)] == sought).all(axis=1)
                out += [(d, k, a, m, 1.0) for d, a in zip(row[same].tolist(), at[same].tolist(), strict=True)]
                continue
            # Bands of 2 x SLACK beginnings, each beginning in two of them.
            band = np.concatenate([at // SLACK, at // SLACK - 1])
            rows, places = np.tile(row, 2), np.tile(place[own], 2)
            order = np.lexsort((places, band, rows))
            rows, band, places = rows[order], band[order], places[order]
            fresh = np.ones(len(rows), bool)
            same_band = (rows[1:] == rows[:-1]) & (band[1:] == band[:-1])
            fresh[1:] = ~(same_band & (places[1:] == places[:-1]))
            edge = np.flatnonzero(np.concatenate([[True], ~same_band]))
            met = np.add.reduceat(fresh.astype(np.int64), edge) >= NEED
            best: dict[int, tuple[int, int, float]] = {}
            for d, b in zip(rows[edge[met]].tolist(), band[edge[met]].tolist(), strict=True):
                found = self._compared(k, numbers, int(begin[d]), int(begin[d + 1]), b * SLACK)
                if found:
                    begin_at, length, share = found
                    last = best.get(d)
                    if last and begin_at < last[0] + last[1]:  # the same passage in the next band
                        if share > last[2]:
                            best[d] = found
                        continue
                    if last:
                        out.append((d, k, *last))
                    best[d] = found
            out += [(d, k, *found) for d, found in best.items()]
        return out

    def _compared(self, k: int, numbers: np.ndarray, low: int, high: int, start: int) -> tuple[int, int, float] | None:
        """The passage whose beginning is in [start, start + 2 * SLACK), if it is near enough and has the phrases."""
        sought = self.sought[k]
        m = len(sought)
        at = np.arange(m)[:, None] + np.arange(start, start + 2 * SLACK)
        same = (numbers[np.clip(at, low, high - 1)] == sought[:, None]) & (at >= low) & (at < high)
        share = float(same.any(axis=1).mean())
        if share < self.templates[k].share:
            return None
        first, last = max(low, start), min(high, start + 2 * SLACK + m)
        inside = numbers[first:last]
        for phrase in self.phrases[k]:
            n = len(phrase)
            if len(inside) < n or not (np.lib.stride_tricks.sliding_window_view(inside, n) == phrase).all(axis=1).any():
                return None
        hits = at[same]
        return int(hits.min()), int(hits.max() - hits.min() + 1), share


def _blocks(batches: Iterator[pa.RecordBatch], column: int, index: Index) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch, runs [i, j) of its documents, word numbers, document of each word, and where each document begins."""
    for batch in batches:
        offsets, data = text_bytes(batch.column(column))
        for i, j in blocks(offsets):
            own, edges = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            starts, ends = word_spans(own, edges, _OUTSIDE)
            begin = np.searchsorted(starts, edges)
            yield batch, i, j, index.numbers(own, starts, ends), np.searchsorted(edges, starts, "right") - 1, begin


def document_counts(docs: DataFrame, index: Index, text_col: str = "text") -> np.ndarray:
    """How many of all documents have each of the templates' words."""
    size = len(index.hashes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, _, _, numbers, doc, _ in _blocks(batches, 0, index):
            seen = numbers >= 0
            total += np.bincount(np.unique(doc[seen] * size + numbers[seen]) % size, minlength=size)
        yield pa.RecordBatch.from_pydict({"word": np.flatnonzero(total), "docs": total[total > 0]})

    rows = docs.select(text_col).mapInArrow(counted, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).toArrow()  # a row for each word of the templates
    out = np.zeros(size, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("docs").to_numpy()
    return out


_MATCH = "struct<label: string, base: boolean, first: bigint, words: bigint, share: double>"


def license_matches(docs: DataFrame, templates: Sequence[Template] = NAMES + PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and ``matches``: label, whether it is a licence's name, first word, words and share of equal words."""
    small_batches(docs.sparkSession)
    index = Index.of(templates)
    shared = docs.sparkSession.sparkContext.broadcast(index.with_counts(document_counts(docs, index, text_col)))  # the templates' size

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, i, j, numbers, doc, begin in _blocks(batches, 1, index):
            found = [[] for _ in range(j - i)]
            for d, k, first, words, share in index.matches(numbers, doc, begin):
                found[d].append({"label": index.templates[k].label, "base": index.templates[k].base, "first": first - int(begin[d]), "words": words, "share": share})
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(begin)), pa.array(found, kind)], ["id", "n_words", "matches"])

    sent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return sent.mapInArrow(scanned, f"id {sent.schema['id'].dataType.simpleString()}, n_words bigint, matches array<{_MATCH}>").withColumnRenamed("id", id_col)


def license_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    places = F.transform(base, lambda m: m["first"])
    best: Column = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return license_matches(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), best.alias("score"),
    )
