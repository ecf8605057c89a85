"""Operator 12: collocations of 2 to 4 words, counted by ERA-style vertical partitioning.

Texts are split into pieces and words; every word begins a suffix of its piece,
cut after ``DEPTH`` words. The suffixes are divided by their prefixes into
groups that fit a memory budget, and each group's part of the suffix tree is
built alone:

* ``partition_vertically``: words are counted; a word that begins more suffixes
  than the budget is extended by the next word, counted again, and so on. What
  is left is gathered into groups up to the budget, by sums over slots of a
  hash of the prefix.
* ``subtrees``: the suffixes of a group are sorted by their prefixes of 1, 2,
  ... words; runs of equal prefixes are the nodes, and a node's count is the
  total of its leaves. Only nodes above a group's prefixes get counts from
  several groups, which are added up.

Suffixes end before a word, or a pair of words, that is rarer than ``least``:
no phrase with it counts. Frequent words and pairs are known by bit tables of
bounded size (a byte counter for each slot, saturating, added up over tasks); a
slot shared by chance only keeps suffixes longer than need be, and counts stay
exact. Equal suffixes of a block of texts are counted, and those of one group
packed, before they are moved.

What reaches the driver is bounded: 2^20 slot sums, at most 2^20 prefixes above
the budget for each length (a text of more than 2^40 words gets groups of more
suffixes), and the bit tables (at most 2^26 bits each).

Results for odd input: null and empty texts have no words; a null lang is
``und``, one group with a lang of that name; very long texts are read whole, in
a block of their own; repeated rows count each; ties in the ranking are ordered
by count, then phrase in the order of UTF-8 bytes, so reruns agree; an empty
table gives no rows. Other columns are ignored, whatever their names. Within
blocks and groups, prefixes are compared by 64-bit hashes of words of their
language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch, small_batches
from aeroframe.llm.textbytes import LOWER, blocks, gather, mix, span_hashes, text_bytes, word_spans

#: Words of a phrase at most; occurrences of a candidate at least.
DEPTH, LEAST = 4, 30
#: Suffixes of a group, at most, and groups, at least, of any but the smallest tables; prefixes and slots that the driver may get are at most 2^MOST_BITS.
BUDGET, GROUPS, MOST_BITS = 1 << 20, 64, 20
#: Bytes of texts whose equal suffixes are made one.
TEXT_BLOCK = 1 << 22
#: Bits of the tables of frequent words and pairs, from and to.
FEWEST, MOST = 18, 26
#: Parts of a language that are ranked on their own first.
PARTS = 64
_CHUNK = 16  # bits of the slots in a row of counters
_STEP = np.uint64(0x9FB21C651E98DF25)

_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@dataclass
class Words:
    """Words of a block of texts: 64-bit keys by language, rows, spans, and whether the next one is in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    key: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> Words:
        data = LOWER[data]
        kinds = _KINDS[data]
        starts, ends = word_spans(data, offsets, _KINDS > 0)
        row = np.searchsorted(offsets, starts, "right") - 1
        hashes, _ = span_hashes(data, starts, ends)
        piece = np.cumsum(kinds == 2, dtype=np.int64)[starts] if len(starts) else starts
        joined = np.zeros(len(starts), bool)
        joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        return cls(data, starts, ends, row, mix(hashes ^ salt[row]), joined)

    def longer(self, prefix: np.ndarray, by: int) -> np.ndarray:
        """Keys of prefixes of ``by`` words, from those of one word less; what stands past a piece's end is of no use."""
        out = np.zeros(len(prefix), np.uint64)
        out[: max(0, len(prefix) - by + 1)] = self.key[by - 1 :]
        return mix(mix(prefix + np.uint64(by)) + out * _STEP)

    def go_on(self, there: np.ndarray, going: np.ndarray, by: int) -> None:
        """Keep those of ``there`` (first words) from whose last but one of ``by`` words a step goes on to the last."""
        room = max(0, len(there) - by + 1)
        there[:room] &= going[by - 2 : by - 2 + room]
        there[room:] = False


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for each row's language, by its name alone."""
    coded = langs.dictionary_encode()
    offsets, data = text_bytes(coded.dictionary)
    return span_hashes(data, offsets[:-1], offsets[1:])[1][coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Bits:
    """A bounded table of bits by the upper bits of a key."""

    size: int
    table: np.ndarray  # bytes of eight slots

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


@dataclass
class Plan:
    """Which prefixes are extended, and the group of each slot."""

    least: int
    budget: int
    heavy: list[np.ndarray] = field(default_factory=list)  # sorted keys, by length from 1
    slot_bits: int = 0
    groups: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    words: Bits | None = None
    pairs: Bits | None = None

    def is_heavy(self, keys: np.ndarray, length: int) -> np.ndarray:
        if length > len(self.heavy) or not len(self.heavy[length - 1]):
            return np.zeros(len(keys), bool)
        known = self.heavy[length - 1]
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def group(self, keys: np.ndarray) -> np.ndarray:
        return self.groups[(keys >> np.uint64(64 - self.slot_bits)).astype(np.int64)] if self.slot_bits else np.zeros(len(keys), np.int32)


def _each_block(batches: Iterator[pa.RecordBatch], size: int = TEXT_BLOCK) -> Iterator[tuple[Words, pa.Array]]:
    """Words and languages of runs of documents; batches have (lang, text)."""
    for batch in batches:
        langs = batch.column(0).fill_null("und")
        offsets, data = text_bytes(batch.column(1))
        salts = _salts(langs)
        for i, j in blocks(offsets, size):
            if offsets[j] > offsets[i]:
                yield Words.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salts[i:j]), langs[i:j]


def _count_prefixes(texts: DataFrame, plan: Plan, length: int) -> DataFrame:
    """(lang, key, n): occurrences of prefixes of ``length`` words whose shorter ones are all above the budget."""
    shared = texts.sparkSession.sparkContext.broadcast(plan)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for words, langs in _each_block(batches):
            keys, there = words.key, np.ones(len(words.key), bool)
            for by in range(2, length + 1):
                there &= plan.is_heavy(keys, by - 1)
                words.go_on(there, words.joined, by)
                keys = words.longer(keys, by)
            found, first, n = np.unique(keys[there], return_index=True, return_counts=True)
            row = words.row[there][first]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(row)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    return texts.mapInArrow(counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _slot_bits(n: int, fewest: int, most: int) -> int:
    return int(min(most, max(fewest, n.bit_length())))


def _frequent_words(counts: DataFrame, least: int) -> Bits:
    """Bits of the words that occur at least so often; rows of 64 bits reach the driver."""
    often = counts.where(F.col("n") >= least)
    size = _slot_bits(32 * often.count(), FEWEST, MOST)
    slot = F.shiftrightunsigned("key", 64 - size)
    rows = often.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    packed = np.zeros(1 << (size - 6), "<u8")
    packed[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bits(size, packed.view(np.uint8))


def _frequent_pairs(texts: DataFrame, plan: Plan, size: int) -> Bits:
    """Bits of the slots in which pairs of frequent words occur at least ``least`` times, counted by saturating bytes."""
    chunk = min(_CHUNK, size)
    width, least = 1 << chunk, plan.least
    shared = texts.sparkSession.sparkContext.broadcast(plan.words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_words = shared.value
        table = np.zeros(1 << size, np.uint8)
        for words, _ in _each_block(batches):
            often = often_words.has(words.key)
            both = words.joined.copy()
            both[:-1] &= often[:-1] & often[1:]
            slots, n = np.unique((words.longer(words.key, 2)[both] >> np.uint64(64 - size)).astype(np.int64), return_counts=True)
            table[slots] = np.minimum(table[slots] + n, 255)
        for at in np.flatnonzero(table.reshape(-1, width).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pa.compress(table[at * width : (at + 1) * width].tobytes(), "zstd", asbytes=True)])], ["at", "counters"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for packed in batch.column("counters"):
                total += np.frombuffer(pa.decompress(packed.as_buffer(), width, "zstd"), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], ["at", "bits"])

    rows = texts.mapInArrow(counted, "at long, counters binary").groupBy("at").applyInArrow(added, "at long, bits binary").collect()  # at most 2^26 bits
    table = np.zeros((1 << (size - chunk), width >> 3), np.uint8)
    for r in rows:
        table[r.at] = np.frombuffer(r.bits, np.uint8)
    return Bits(size, table.ravel())


def partition_vertically(scratch: Scratch, texts: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[Plan, DataFrame]:
    """The plan of groups, and (lang, n): all words of each language. ``texts``: (lang, text)."""
    plan = Plan(least, budget)
    counts = scratch.save(_count_prefixes(texts, plan, 1), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    plan.budget = max(1, min(budget, total // GROUPS), total >> MOST_BITS)
    plan.words = _frequent_words(counts, least)
    plan.slot_bits = _slot_bits(16 * total // plan.budget, 4, MOST_BITS)
    sums = np.zeros(1 << plan.slot_bits, np.int64)
    for length in range(1, DEPTH + 1):
        slots = counts.where(F.col("n") <= plan.budget).groupBy(F.shiftrightunsigned("key", 64 - plan.slot_bits).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
        sums[slots.column("slot").to_numpy()] += slots.column("n").to_numpy()
        above = counts.where(F.col("n") > plan.budget).select("key").toArrow().column("key").to_numpy()
        plan.heavy.append(np.sort(above.view(np.uint64)))
        if not len(above) or length == DEPTH:
            break
        counts = scratch.save(_count_prefixes(texts, plan, length + 1), f"prefixes-{length + 1}")
    plan.groups = ((np.cumsum(sums) - sums) // plan.budget).astype(np.int32)
    plan.pairs = _frequent_pairs(texts, plan, _slot_bits(total // 4, FEWEST, MOST))
    return plan, totals


def _suffixes(texts: DataFrame, plan: Plan) -> DataFrame:
    """(grp, lang, size, packed): suffixes up to the first rare word or pair, those of a block, group and language packed into one row."""
    shared = texts.sparkSession.sparkContext.broadcast(plan)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for words, langs in _each_block(batches):
            count = len(words.key)
            often = plan.words.has(words.key)
            going = words.joined.copy()  # from a word to the next one
            going[:-1] &= often[:-1] & often[1:]
            going[going] = plan.pairs.has(words.longer(words.key, 2)[going])
            length = often.astype(np.int64)
            keys, whole = words.key, words.key.copy()
            group, cut = words.key.copy(), np.ones(count, np.uint8)
            ahead = np.ones(count, bool)
            for by in range(2, DEPTH + 1):
                words.go_on(ahead, going, by)
                heavy = plan.is_heavy(keys, by - 1) & (cut == by - 1)
                keys = words.longer(keys, by)
                length[ahead] = by
                whole[ahead] = keys[ahead]
                cut[heavy] = by
                group[heavy & ahead] = keys[heavy & ahead]
            whole = mix(whole + length.astype(np.uint64))
            kept = np.flatnonzero(length)
            if not len(kept):
                continue
            _, first, n = np.unique(whole[kept], return_index=True, return_counts=True)
            at = kept[first]
            coded = langs.dictionary_encode()
            names, lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[words.row[at]]
            grp = plan.group(group[at])
            order = np.lexsort((group[at], words.key[at], lang, grp))
            at, n, lang, grp = at[order], n[order].astype("<u4"), lang[order], grp[order]
            # The words one by one with a space behind each, so that a suffix is one span.
            size = words.ends - words.starts + 1
            stop = np.cumsum(size)
            begin = stop - size
            spaced = words.data[np.minimum(np.repeat(words.starts - begin, size) + np.arange(int(stop[-1])), len(words.data) - 1)]
            spaced[stop - 1] = 0x20
            begin, span, cut = begin[at], stop[at + length[at] - 1] - begin[at], cut[at]
            edge = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (lang[1:] != lang[:-1]), [True]]))
            sizes, packed = [], []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                ends = np.cumsum(span[i:j])
                text = spaced[np.repeat(begin[i:j] - (ends - span[i:j]), span[i:j]) + np.arange(int(ends[-1]))]
                text[ends - 1] = 0x0A
                raw = np.uint32(j - i).tobytes() + n[i:j].tobytes() + cut[i:j].tobytes() + text.tobytes()
                sizes.append(len(raw))
                packed.append(pa.compress(raw, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(grp[edge[:-1]]), names.take(pa.array(lang[edge[:-1]])), pa.array(sizes), pa.array(packed, pa.binary())], ["grp", "lang", "size", "packed"])

    return texts.mapInArrow(emitted, "grp int, lang string, size long, packed binary")


def subtrees(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n, partial): nodes of each group's suffix tree that occur often enough, or may go on in other groups."""

    def grown(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cuts, bodies, langs = [], [], [], []  # a group: the budget's suffixes, about
        for batch in batches:
            for lang, size, packed in zip(batch.column("lang"), batch.column("size").to_pylist(), batch.column("packed"), strict=True):
                raw = pa.decompress(packed.as_buffer(), size, "zstd")
                rows = int(np.frombuffer(raw, "<u4", 1)[0])
                counts.append(np.frombuffer(raw, "<u4", rows, 4))
                cuts.append(np.frombuffer(raw, np.uint8, rows, 4 + 4 * rows))
                bodies.append(np.frombuffer(raw, np.uint8, offset=4 + 5 * rows))
                langs += [lang.as_py()]
        coded = pa.array(langs, pa.string()).dictionary_encode()
        lang = np.repeat(coded.indices.to_numpy(), [len(c) for c in counts])
        n, cut, data = np.concatenate(counts).astype(np.int64), np.concatenate(cuts), np.concatenate(bodies)
        salt = _salts(coded.dictionary)[lang]
        offsets = np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1])
        starts, ends = word_spans(data, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(n)))[row]
        hashes, stops = np.zeros((DEPTH, len(n)), np.uint64), np.zeros((DEPTH, len(n)), np.int64)
        for d in range(DEPTH):
            own, stop = row[place == d], ends[place == d]
            hashes[d, own] = mix(span_hashes(data, offsets[own], stop)[0] ^ salt[own]) | np.uint64(1)
            stops[d, own] = stop
        order = np.lexsort(hashes[::-1])
        for d in range(DEPTH):
            inside = order[hashes[d, order] > 0]
            if not len(inside):
                break
            run = hashes[d, inside]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            totals = np.add.reduceat(n[inside], first)
            node = inside[first]
            partial = cut[node] > d + 1
            kept = partial | (totals >= least)
            node = node[kept]
            if len(node):
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(lang[node])), gather(data, offsets[node], stops[d, node]), pa.array(np.full(len(node), d + 1, np.int32)), pa.array(totals[kept]), pa.array(partial[kept])], ["lang", "phrase", "words", "n", "partial"])

    return suffixes.groupBy("grp").applyInArrow(grown, "lang string, phrase string, words int, n long, partial boolean")


def frequent_phrases(scratch: Scratch, texts: DataFrame, plan: Plan) -> DataFrame:
    """(lang, phrase, words, f): all phrases of up to four words that occur often enough."""
    nodes = scratch.save(subtrees(_suffixes(texts, plan), plan.least), "nodes")
    split = nodes.where("partial").groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("n")).where(F.col("n") >= plan.least)
    return scratch.save(nodes.where("not partial").select("lang", "phrase", "words", "n").unionByName(split).withColumnRenamed("n", "f"), "phrases")


def ranked_phrases(scratch: Scratch, phrases: DataFrame, totals: DataFrame, top: int = 2000, share: int = 80) -> DataFrame:
    """The best phrases of each language by their weakest cut, without those that mostly stand in one longer phrase."""
    part = lambda name, as_: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - words)")})
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as bigint)")
    weakest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = "flatten(transform(sequence(2, words - 1), w -> transform(sequence(1, words - w + 1), i -> array_join(slice(split(phrase, ' '), i, w), ' '))))"
    longer = phrases.where("words > 2").select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    free = weakest.join(longer, ["lang", "phrase"], "left").where(F.expr(f"most is null or cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(share)}"))
    rows = scratch.save(free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    parts = first(rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part").drop("part", "rank")
    return first(parts, "lang").join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = 2000, share: int = 80, budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of every language."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    plan, totals = partition_vertically(scratch, texts, least, budget)
    return ranked_phrases(scratch, frequent_phrases(scratch, texts, plan), totals, top, share)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), grams AS (SELECT lang, w, i, unnest(range(1, 5)) AS k FROM spans
), phrases AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM phrases WHERE k > 1
), scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, h.f AS l, t.f AS r, (2000000::HUGEINT * x.a) // (h.f + t.f) AS score FROM cuts x
  JOIN phrases h ON h.lang = x.lang AND h.phrase = array_to_string(x.w[1:x.c], ' ') JOIN phrases t ON t.lang = x.lang AND t.phrase = array_to_string(x.w[x.c + 1:], ' ')
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), longer AS (
  SELECT DISTINCT b.lang, b.phrase FROM (SELECT lang, phrase, f, k, unnest(range(1, k)) AS at, string_split(phrase, ' ') AS w FROM phrases WHERE k > 2) z
  CROSS JOIN (SELECT unnest([2, 3]) AS size) s JOIN phrases b ON b.lang = z.lang AND b.k = s.size AND s.size < z.k AND z.at + s.size - 1 <= z.k AND b.phrase = array_to_string(z.w[z.at:z.at + s.size - 1], ' ')
  WHERE 100 * z.f >= 80 * b.f
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM weakest ANTI JOIN longer USING (lang, phrase)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
