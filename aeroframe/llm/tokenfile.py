"""Operator 9: flat files of unsigned token ids with 64-bit document offsets.

Documents are range-partitioned and sorted by id, a hash of the text, and a
number among rows that agree in both. Each task encodes its range and writes
three flat little-endian files to the shared folder:

``part-K.ids``  all ids of the range, unsigned 16 or 32 bits by the vocabulary
``part-K.off``  unsigned 64-bit offsets of its documents in ids, and the end
``part-K.doc``  the documents' ids, signed 64 bits (null: the lowest value)

``manifest.json`` lists the parts with the prefix sums of their tokens, so a
document's place in the whole is its part's base plus its own offset. Reading
maps the files into memory; no part is ever merged or passed by the driver.

Null and empty texts give a document of the end id alone. Repeated rows give a
document each: rows of one id are ordered by a hash of their texts, and may be
dealt to several tasks, even where they agree; those that do are written with
their numbers first, so that a repeated task can't number them otherwise. A
null id sorts first. An empty table gives a manifest without parts. Very
long texts are encoded whole and are one document; where a part is one such
text, it is larger than the others. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch, SharedFiles, small_batches
from aeroframe.llm.tokencache import memory
from aeroframe.session import qualified

NO_ID = -(1 << 63)
#: Bytes of texts in a part, about, up to ``MOST_PARTS``; parts are larger beyond.
PART_BYTES, MOST_PARTS = 1 << 24, 100_000


def _ordered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and text in parts by doc_id, mark (a hash of the text) and place (among rows that agree)."""
    rows = docs.withColumn("mark", F.xxhash64("text"))
    counts = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    counts = scratch.save(counts, "counts")
    count = min(MOST_PARTS, max(1, -(-(counts.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES)))
    several = scratch.save(counts.where("rows > 1").select(F.col("doc_id").alias("several"), F.col("mark").alias("of")), "several")
    if several.isEmpty():
        placed = rows.withColumn("place", F.lit(0).cast("long"))
    else:
        same = F.col("doc_id").eqNullSafe(F.col("several")) & (F.col("mark") == F.col("of"))
        told = scratch.save(rows.join(several, same, "left_semi").withColumn("place", F.monotonically_increasing_id()), "told")
        placed = rows.join(several, same, "left_anti").withColumn("place", F.lit(0).cast("long")).unionByName(told)
    order = ("doc_id", "mark", "place")
    return placed.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text, append ``end_id``, write the files below ``uri``; returns the manifest's parts."""
    spark = docs.sparkSession
    small_batches(spark)
    uri = qualified(spark, uri)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, files = memory(tokenizer, drops_space), SharedFiles(uri)
        if end_id > np.iinfo(words.dtype).max:
            raise ValueError(f"end id {end_id} doesn't fit the file's {words.dtype}")
        name = f"part-{TaskContext.get().partitionId():06d}"
        counts, keys = [], []

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                ids, n = words.encode(batch.column(1))
                out = np.full(len(ids) + len(n), end_id, words.dtype)
                stop = np.cumsum(n + 1)
                inner = np.ones(len(out), bool)
                inner[stop - 1] = False
                out[inner] = ids
                counts.append(n + 1)
                keys.append(batch.column(0).fill_null(NO_ID).to_numpy())
                yield out.tobytes()

        files.write(f"{name}.ids", encoded())
        size = np.concatenate([np.zeros(0, np.int64), *counts])
        if not len(size):
            return
        files.write(f"{name}.off", [np.concatenate([[0], np.cumsum(size)]).astype("<u8").tobytes()])
        files.write(f"{name}.doc", [np.concatenate(keys).astype("<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [name], "documents": [len(size)], "tokens": [int(size.sum())], "bits": [words.dtype.itemsize * 8]})

    ordered = _ordered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), Scratch(spark, "token-files"))
    parts, base = [], 0
    for row in sorted(ordered.mapInArrow(write, "part string, documents long, tokens long, bits long").collect()):  # a row for each task
        parts.append(row.asDict() | {"base": base})
        base += row.tokens
    SharedFiles(uri).write("manifest.json", [json.dumps({"parts": parts, "end_id": end_id, "tokens": base}).encode()])
    return parts


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each document from the mapped files: doc_id, start, n_tokens, ids_crc32."""
    uri = qualified(spark, uri)
    parts = json.loads(bytes(SharedFiles(uri).map("manifest.json")))["parts"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(uri)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(files.map(row["part"] + ".ids"), f"<u{row['bits'] // 8}")
                offset = np.frombuffer(files.map(row["part"] + ".off"), "<u8").astype(np.int64)
                keys = np.frombuffer(files.map(row["part"] + ".doc"), "<i8")
                for at in range(0, len(keys), 10_000):
                    edge = offset[at : at + 10_001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                    key = keys[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NO_ID), pa.array(row["base"] + edge[:-1]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(p["part"], p["base"], p["bits"]) for p in parts], "part string, base long, bits long")
    return listed.repartition(max(1, len(parts))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
