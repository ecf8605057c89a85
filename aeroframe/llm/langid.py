"""Operator 5: language identification with string kernels.

The kernel is the blended spectrum of byte n-grams (1 to 4 bytes of the text
with ASCII lower-cased) by presence: common n-grams over the root of the
product of their numbers, restricted to n-grams of the landmarks. Landmarks are
sampled documents of each language; a Nystroem map from them and one-versus-rest
kernel ridge regression give a weight for each n-gram, so a batch of texts is
scored by one product of its presence matrix with the weights.

Fitting uses a bounded sample of labelled rows: at most ``TRAIN`` different
texts and ``LANDMARKS`` landmarks, taken alike from every language by the
smallest hashes of id and text; landmarks are texts of at most ``LONGEST`` bytes
as long as a language has them, and longer ones beyond. Rows that agree in both
count once, and so do ties. All else covers every row and the whole
text. The sums that training needs are made on the executors; the driver gets
matrices of LANDMARKS x LANDMARKS and the landmarks' n-grams.

Null texts and texts without a letter are ``und`` with score 0; so is every
text where there is no labelled row to learn from. Very long texts are read
whole. Repeated rows get equal predictions. Null languages are not learned.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from aeroframe.llm.storage import lean, small_batches
from aeroframe.llm.textbytes import LOWER, blocks, text_bytes

#: Labelled rows learned from, and landmarks, at most (and one more for a language); bytes of a text that is a landmark before longer ones are.
TRAIN, LANDMARKS, LONGEST = 3000, 128, 1 << 14
#: Parts of a language's draws from which the smallest ones are taken first, so that no task gets a whole language.
PARTS = 256
GRAMS = 4
#: Bytes of texts whose n-grams are looked up at once; bounds the working arrays.
BLOCK = 1 << 18
RIDGE = 1e-3
_SLOT_BITS = (22, 18)  # of the first table of slots, and of those for what it can't place
_SALT = 0x9E3779B97F4A7C15


def _codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to GRAMS: place and code of every n-gram inside a document."""
    n = len(data)
    wide = data.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # bytes up to the document's end
    for k in range(min(GRAMS, n)):
        code[: n - k] |= wide[k:] << np.uint64(8 * k)
        where = np.flatnonzero(room > k)
        yield where, code[where] | np.uint64((k + 1) << 40)


def _slot(codes: np.ndarray, level: int = 0) -> np.ndarray:
    salt = (_SALT + 2 * level * 0x9FB21C651E98DF25) & (1 << 64) - 1  # odd
    return (codes * np.uint64(salt)) >> np.uint64(64 - _SLOT_BITS[min(level, 1)])


class Vocabulary:
    """N-grams with a number each, from 1, found by tables of slots; those whose slot is taken go to the next table."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.concatenate([np.zeros(1, np.uint64), np.unique(codes)])
        self.levels = []
        left = np.arange(1, len(self.codes), dtype=np.int32)
        while len(left) or not self.levels:
            level = len(self.levels)
            table = np.zeros(1 << _SLOT_BITS[min(level, 1)], np.int32)
            slot = _slot(self.codes[left], level)
            table[slot[::-1]] = left[::-1]
            left = left[table[slot] != left]
            self.levels.append(table)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Number of each n-gram, 0 for those not here."""
        entry = self.levels[0][_slot(codes)]
        wrong = np.flatnonzero(self.codes[entry] != codes)
        if len(self.levels) > 1:
            wrong = wrong[entry[wrong] != 0]  # an empty slot has sent nothing on
        for level, table in enumerate(self.levels[1:], 1):
            entry[wrong] = table[_slot(codes[wrong], level)]
            wrong = wrong[self.codes[entry[wrong]] != codes[wrong]]
        entry[wrong] = 0
        return entry

    def presence(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Documents x n-grams, 1 where the document has it; column 0 is for none.

        ``known`` gets the number of each document's n-grams found here added, repeats included.
        """
        docs = len(offsets) - 1
        found = np.zeros((docs, len(self.codes)), np.float32)
        flat = found.ravel()
        data = LOWER[data]
        base = np.repeat(np.arange(docs) * len(self.codes), np.diff(offsets))
        for where, codes in _codes(data, offsets):
            entry = self.find(codes)
            flat[base[where] + entry] = 1
            if known is not None:
                until = np.zeros(len(data) + 1, np.int64)
                until[where + 1] = entry != 0
                until = np.cumsum(until)
                known += until[offsets[1:]] - until[offsets[:-1]]
        found[:, 0] = 0
        return found


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    weights: np.ndarray  # n-grams x languages

    def scores(self, column: pa.Array, known: np.ndarray | None = None) -> np.ndarray:
        """One-versus-rest outputs of every text; ``known``, zeros, gets the share of its n-grams that the landmarks have."""
        offsets, data = text_bytes(column)
        out = [np.zeros((0, len(self.languages)))]
        for i, j in _blocks(offsets, self.vocabulary):
            there = self.vocabulary.presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], None if known is None else known[i:j])
            size = np.sqrt(np.maximum(1, there.sum(axis=1, dtype=np.float64)))
            out.append((there @ self.weights) / size[:, None])
        if known is not None:
            length = np.diff(offsets)
            known /= np.maximum(1, sum(np.maximum(0, length - k) for k in range(GRAMS)))
        return np.concatenate(out)


def _blocks(offsets: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[int, int]]:
    """Blocks of about ``BLOCK`` bytes, with no more documents than a presence matrix of 16 MB holds."""
    most = max(1, (1 << 22) // len(vocabulary.codes))
    for i, j in blocks(offsets, BLOCK):
        for a in range(i, j, most):
            yield a, min(j, a + most)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from rows with a language; None where there are none."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("langid")).alias("draw"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())  # a row for each language
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    rows = rows.where(_letters(F.col("text"))).select("text", "lang", "draw")

    def drawn(rows: DataFrame, most: int, longest: int | None = None) -> DataFrame:
        """About ``most`` different rows in all, alike from every language: those of the smallest draws, longer texts after the others."""
        own = -(-most // len(languages))
        rows = rows.withColumn("late", F.lit(0) if longest is None else (F.octet_length("text") > longest).cast("int"))
        first = lambda rows, *keys: rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("late", "draw"))).where(F.col("place") <= own)
        parts = rows.select("lang", "late", "draw").distinct().withColumn("part", F.pmod("draw", F.lit(PARTS)))
        last = first(first(parts, "lang", "part"), "lang").groupBy("lang").agg(F.max(F.struct("late", "draw")).alias("last")).collect()  # a row for each language
        chosen = F.lit(False)
        for r in last:
            chosen |= (F.col("lang") == r.lang) & (F.struct("late", "draw") <= F.struct(F.lit(r.last.late).alias("late"), F.lit(r.last.draw).alias("draw")))
        return rows.where(chosen).groupBy("lang", "draw").agg(F.first("text").alias("text")).select("text", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = [np.unique(codes) for _, codes in _codes(LOWER[data[i:j]], np.array([0, j - i]))] if j > i else []
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(own).tobytes() if own else b""], pa.binary())], ["codes"])

    sets = [np.frombuffer(r.codes, np.uint64) for r in drawn(rows, LANDMARKS, LONGEST).select("text").mapInArrow(lean(grams), "codes binary").collect()]  # the different n-grams of LANDMARKS rows
    if not sets:
        return None
    vocabulary = Vocabulary(np.concatenate(sets))
    marks = np.zeros((len(sets), len(vocabulary.codes)), np.float32)
    for k, own in enumerate(sets):
        marks[k, vocabulary.find(own)] = 1
    marks[:, 0] = 0
    marks /= np.sqrt(np.maximum(1, marks.sum(axis=1)))[:, None]
    shared = labelled.sparkSession.sparkContext.broadcast((vocabulary.codes, marks))  # bounded by the landmarks

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, marks = shared.value
        vocabulary = Vocabulary(codes[1:])
        m = len(marks)
        inner, outer, n = np.zeros((m, m)), np.zeros((m, len(languages) + 1)), 0
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            names = np.array([number[x] for x in batch.column(1).to_pylist()])
            for i, j in _blocks(offsets, vocabulary):
                there = vocabulary.presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                kernel = (there @ marks.T).astype(np.float64) / np.sqrt(np.maximum(1, there.sum(axis=1, dtype=np.float64)))[:, None]
                target = np.full((j - i, len(languages) + 1), -1.0)
                target[np.arange(j - i), names[i:j]] = 1
                target[:, -1] = 0
                inner += kernel.T @ kernel
                outer += kernel.T @ target
                n += j - i
        if n:
            yield pa.RecordBatch.from_pydict({"inner": [inner.tobytes()], "outer": [outer.tobytes()], "n": [n]})

    m = len(marks)
    inner, outer, n = np.zeros((m, m)), np.zeros((m, len(languages) + 1)), 0
    learned = drawn(rows, TRAIN).coalesce(16).mapInArrow(lean(sums), "inner binary, outer binary, n long")
    for r in learned.collect():  # 16 rows at most
        inner += np.frombuffer(r.inner).reshape(m, m)
        outer += np.frombuffer(r.outer).reshape(m, -1)
        n += r.n
    own = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # landmarks to Nystroem features
    ridge = np.linalg.solve(root.T @ inner @ root + RIDGE * max(1, n) * np.eye(keep.sum()), root.T @ outer[:, :-1])
    return Model(languages, vocabulary, (marks.T @ (root @ ridge)).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", added: tuple[str, str] = ("lang_pred", "score"), keep: tuple[str, ...] = (), share: str | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the predicted language and its score.

    ``share`` names a column for the share of the text's n-grams that the landmarks have.
    """
    names = [F.col(f"`{c}`") for c in keep]
    if model is None:
        return docs.select(*names, F.lit("und").alias(added[0]), F.lit(0.0).alias(added[1]), *([F.lit(0.0).alias(share)] if share else []))
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    sent = docs.select(*names, *([] if text_col in keep else [F.col(text_col)]), _letters(F.col(text_col)))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.vocabulary.codes, model.weights))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, codes, weights = shared.value
        own = Model(languages, Vocabulary(codes[1:]), weights)
        said = np.array([*languages, "und"], object)
        for batch in batches:
            known = np.zeros(batch.num_rows) if share else None
            scores = own.scores(batch.column(text_at), known)
            best = scores.argmax(axis=1)
            score = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1)
            silent = ~batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            best[silent], score[silent] = len(languages), 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(said[best], pa.string()), pa.array(score, pa.float64()), *([pa.array(known)] if share else [])], names=[*batch.schema.names[: len(keep)], *added, *([share] if share else [])])

    schema = StructType(sent.schema.fields[: len(keep)]).add(added[0], StringType()).add(added[1], DoubleType())
    if share:
        schema = schema.add(share, DoubleType())
    return sent.mapInArrow(lean(classify), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slim, model, keep=("doc_id", "held_out"))
