"""Operator 1: packing documents into sequences of a fixed length.

Every document is encoded once, its end id appended, and cut into whole
sequences and one remainder. The pieces are dealt into randomised groups of a
bounded expected size; in each group first-fit decreasing places them, finding
the first bin with room by a tournament tree of the bins' free capacities. Only
the pieces' numbers are written and shuffled, never their ids.

Null and empty texts give one piece with the end id alone. Repeated rows give
pieces each (a row's place in its input split salts its group; as the pieces
are written first, a repeated task can't deal them otherwise). An empty table
gives no rows. Other columns are ignored. Very long texts are encoded whole, a
block of their own, and give as many whole sequences as they fill. Pieces that
tie in size are placed in the order of id, start, checksum and row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch, lean, small_batches
from aeroframe.llm.tokencache import memory

#: Stands for a null id while pandas holds it.
_NO_ID = -(1 << 63)
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the given order; each goes to the first bin with room."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    free = [capacity] * (2 * leaves)  # a node holds the most room below it
    bins, offsets = [], []
    for need in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= need
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def cut(docs: DataFrame, tokenizer: str, end_id: int, length: int, drops_space: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``length`` tokens: whole sequences first, then the remainder."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = memory(tokenizer, drops_space), 0
        for batch in batches:
            ids, count = words.encode(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row")}
            at = 0
            for key, n in zip(batch.column(0).to_pylist(), count.tolist(), strict=True):
                own = np.append(ids[at : at + n].astype("<u4"), np.uint32(end_id)).astype("<u4")
                at += n
                for start in range(0, n + 1, length):
                    piece = own[start : start + length]
                    for name, value in zip(out, (key, start, len(piece), zlib.crc32(piece), n + 1, row), strict=True):
                        out[name].append(value)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(pieces, keep=True), _PIECE)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, drops_space: bool = True, group_docs: int = 1024, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece with its sequence and the offset there."""
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.select(F.lit(1)).count() // group_docs))

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = first_fit(frame["length"].tolist(), length)
        return frame.assign(sequence_id=(np.int64(key[0]) << 32) + np.array(bins, np.int64), offset=np.array(offsets, np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    made = Scratch(docs.sparkSession, "packing").save(cut(docs, tokenizer, end_id, length, drops_space, id_col, text_col), "pieces")
    dealt = made.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "row", "start", F.lit(seed)), F.lit(groups)))
    placed = dealt.groupBy("pack_group").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
