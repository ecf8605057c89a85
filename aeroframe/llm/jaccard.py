"""Operator 3: Jaccard join on word n-grams by rare-first prefix filtering.

1. A sketch counts all distinct shingles of all documents; its counters grow
   with the bytes of the texts. Any total order gives exact results; this one
   puts the rare shingles first.
2. Each document is reduced to its digest, its size, its prefix (the rarest
   shingles that any partner must share one of) and the parities of its
   shingles in slots, two to four slots for each shingle. Documents with equal
   sets fall together here.
3. Sets that share a prefix shingle are first paired with leaders of that
   shingle only; the links found there are contracted, and leaders are drawn
   anew while that keeps closing groups. Only pairs of sets that are then still
   in different components meet each other, by shingle and band of sizes, and
   have to pass the length and positional filters and the parities already in
   the join. No pair is verified twice.
4. A pair is verified once, on its whole shingle sets: the suffix filter first
   (recursive halves of one set, the sizes of the other's parts between the
   same pivots, and their bound on the Hamming distance), then the exact
   overlap.

Every join is an equi-join that Spark can split where a key is hot; counts of
groups are pre-aggregated. Working tables are written to the shared folder.

Shingles are compared by 64-bit hashes. Null, empty and word-less texts have no
shingle and link with nothing. Repeated rows and equal sets share a component.
Rows of one doc_id with different texts count as one document. Rows without an
id take part by their sets; a component's id is its smallest non-null doc_id,
or null if it has none. Other columns are ignored. An empty table gives no rows.
Very long texts are read whole, in blocks of their own. Shingles that tie in
rarity are ordered by their hash, so every set has one order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.graph import components
from aeroframe.llm.storage import Scratch, lean, small_batches
from aeroframe.llm.textbytes import blocks, mix, shingles, text_bytes

#: Bits of the number of counters of the sketch of shingle counts (4 bytes each), at least and at most; one for some 1,600 bytes of text between.
SKETCH_BITS = (21, 24)
_SLICE_BITS = 15
#: 64-bit words of parities that a row of the join has, and that a set has at least; larger sets have more.
JOIN_WORDS = 8
#: Bits of the filter that tells which documents' sets are wanted, at least and at most (32 MB); 16 to 32 for each of them between.
FILTER_BITS = (16, 28)
#: Leaders of one shingle in a round, about.
LEADERS = 4


def _overlap(n: int | np.ndarray, num: int, den: int):
    """Shingles that a set of n must share with any partner."""
    return -(-num * n // den)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = text_bytes(batch.column(1))
    for i, j in blocks(offsets):
        owner, hashes = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        yield i, j, owner, hashes


_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _digest(hashes: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each document's set, whatever its order; 0 for empty sets."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), (np.cumsum(n) - n)[full])
    return out.view(np.int64)


def _bits(n: float, limits: tuple[int, int]) -> int:
    """Bits of the first power of two from n, within limits."""
    return min(max(limits[0], math.ceil(math.log2(max(1.0, n)))), limits[1])


def shingle_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all documents' distinct shingles by the high bits of their hash."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bits(size / 1600, SKETCH_BITS)
    high = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, _, _, hashes in _sets(batch, k):
                np.add.at(counts, hashes >> high, 1)
        parts = counts.reshape(-1, 1 << _SLICE_BITS)
        for part in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"part": [part], "counts": [parts[part].tobytes()]})

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLICE_BITS, np.int64)
        for table in tables:
            for value in table.column("counts"):
                total += np.frombuffer(value.as_buffer(), np.int32)
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "counts": [np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()]})

    made = docs.mapInArrow(lean(count), "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary")
    whole = np.zeros((1 << (bits - _SLICE_BITS), 1 << _SLICE_BITS), np.int32)
    for row in made.collect():  # 2**bits counters in all
        whole[row.part] = np.frombuffer(row.counts, np.int32)
    return whole.ravel()


def _words(n: np.ndarray) -> np.ndarray:
    """64-bit words of parities of a set of n: a power of two, 2 n slots or more."""
    return np.maximum(JOIN_WORDS, 1 << np.ceil(np.log2(np.maximum(1, n / 32))).astype(np.int64))


def _profiles(docs: DataFrame, k: int, num: int, den: int, sketch) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), prefix (rarest first), parity (bits)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        high = np.uint64(65 - len(counts).bit_length())
        for batch in batches:
            for i, j, owner, hashes in _sets(batch, k):
                docs_here = j - i
                n = np.bincount(owner, minlength=docs_here)
                begin = np.cumsum(n) - n
                digests = [_digest(hashes, n, salt) for salt in _SALTS]
                words = np.where(n > 0, _words(n), 0)
                last = np.cumsum(words)
                parity = np.zeros(last[-1], np.uint64)
                slot = (last - words)[owner] + ((hashes >> np.uint64(6)).astype(np.int64) & (words[owner] - 1))
                np.bitwise_xor.at(parity, slot, np.uint64(1) << (hashes & np.uint64(63)))
                order = np.argsort(counts[hashes >> high], kind="stable")  # ties by hash
                order = order[np.argsort(owner[order], kind="stable")]
                size = np.where(n > 0, n - _overlap(n, num, den) + 1, 0)
                place = np.arange(len(hashes)) - begin[owner]
                kept = hashes[order][place < size[owner]]
                edges = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, docs_here), pa.array(n, pa.int64()), *map(pa.array, digests),
                        pa.ListArray.from_arrays(edges(size), pa.array(kept.view(np.int64))),
                        pa.ListArray.from_arrays(edges(words), pa.array(parity.view(np.int64))),
                    ],
                    ["doc_id", "n", "d1", "d2", "prefix", "parity"],
                )

    return docs.mapInArrow(lean(profile), "doc_id long, n long, d1 long, d2 long, prefix array<long>, parity array<long>")


def _filter_of(nodes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of one hash as 64-bit words."""
    word = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
    rows = nodes.select(F.shiftright(word, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(1 << (bits - 6), np.int64)
    found = rows.toArrow()  # 2**(bits - 6) words at most
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def _whole_sets(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that may be among ``nodes``, and of all without an id; shingles ascend.

    A filter of bounded size lets few others pass. Beyond what it can tell apart, texts are joined with the nodes.
    """
    count = nodes.count()
    bits = _bits(16 * count, FILTER_BITS)
    if count > 1 << (FILTER_BITS[1] - 2):
        docs = docs.where("doc_id is not null").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_of(nodes, bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            keep = np.flatnonzero((slot < 0) | ((words[slot >> 6] >> (slot & 63)) & 1 == 1))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            for i, j, owner, hashes in _sets(batch, k):
                n = np.bincount(owner, minlength=j - i)
                own = _digest(hashes, n, _SALTS[0])
                node = pc.coalesce(batch.column(0).slice(i, j - i), pa.array(own))
                edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                rising = (hashes ^ np.uint64(1 << 63)).view(np.int64)
                found = pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(edges), pa.array(rising))], ["node", "shingles"])
                _, first = np.unique(np.stack([node.to_numpy(), own]), axis=1, return_index=True)  # repeated rows once
                yield found.take(pa.array(np.sort(first)))

    marked = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))).alias("slot"))
    return marked.mapInArrow(lean(sets), "node long, shingles array<long>")


def _folded(parity: str, words: Column) -> Column:
    """Parities with as many words as said, a power of two."""
    return F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.sequence(i, F.size(parity) - 1, words), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(parity, j))))


def _halves(depth: int = 2) -> Column:
    """The suffix filter's bound on the Hamming distance of set_a and set_b.

    set_b is halved ``depth`` times; set_a falls into parts at the same pivots,
    and each part differs by its difference in size at least.
    """
    parts = 1 << depth
    places = [F.lit(0), *(F.expr(f"{i} * size(set_b) div {parts}") for i in range(1, parts)), F.size("set_b")]
    below = lambda at: F.size(F.filter("set_a", lambda x: x < F.get("set_b", at)))
    pivots = [F.lit(0), *map(below, places[1:-1]), F.size("set_a")]
    return sum((F.abs((pivots[i + 1] - pivots[i]) - (places[i + 1] - places[i])) for i in range(parts)), F.lit(0))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two sets link when den * intersection >= num * union."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = spark.sparkContext.broadcast(shingle_sketch(docs, k))
    profiles = scratch.save(_profiles(docs, k, num, den, sketch), "profiles")

    sets = profiles.where("n > 0").groupBy("d1", "d2").agg(F.coalesce(F.min("doc_id"), F.col("d1")).alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    sets = scratch.save(sets, "sets")
    outline = sets.select("node", "n", "parity")
    rows = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    leaders = rows.groupBy("token").agg(F.min("node").alias("leader"), F.max("node").alias("other"), F.count("*").alias("k")).where("leader <> other").select("token", "leader", "k")
    rows = scratch.save(rows.join(leaders, "token"), "rows")

    need = F.expr(f"({num} * (n_a + n_b) + {num + den - 1}) div {num + den}")
    close = F.expr(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")

    def alike(parity_a: Column, parity_b: Column) -> Column:
        """Overlap is at most half of what the sizes have beyond the differing parities."""
        differing = F.aggregate(F.zip_with(parity_a, parity_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        return F.col("n_a") + F.col("n_b") - differing >= 2 * need

    seen: list[DataFrame] = []  # verified pairs and links of each round
    linked: list[DataFrame] = []

    def verify(pairs: DataFrame, turn: int) -> None:
        """Filter pairs (a, b) not seen before by size and parities, then compare whole sets."""
        fresh = pairs.select("a", "b", F.lit(False).alias("old"))
        for old in seen:
            fresh = fresh.unionByName(old.select("a", "b", F.lit(True).alias("old")))
        fresh = fresh.groupBy("a", "b").agg(F.bool_or("old").alias("old")).where("not old").select("a", "b")
        side = lambda x: outline.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
        words = F.least(F.size("parity_a"), F.size("parity_b"))
        fit = fresh.join(side("a"), "a").join(side("b"), "b").where(close).where(alike(_folded("parity_a", words), _folded("parity_b", words)))
        fit = scratch.save(fit.select("a", "b", "n_a", "n_b"), f"pairs-{turn}")
        seen.append(fit)
        if fit.isEmpty():
            linked.append(fit.select("a", "b"))
            return
        # Only the sets of this round's documents are moved; they are read from the texts again.
        nodes = fit.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        whole = scratch.save(_whole_sets(docs, k, nodes), f"whole-{turn}")
        both = fit.join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        near = both.where(F.size("set_a") + F.size("set_b") - _halves() >= 2 * need)
        inter = F.size(F.array_intersect("set_a", "set_b"))
        good = near.where(F.lit(den) * inter >= F.lit(num) * (F.size("set_a") + F.size("set_b") - inter))
        linked.append(scratch.save(good.select("a", "b").distinct(), f"links-{turn}"))
        scratch.drop(f"whole-{turn}")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def pair(x: str, y: str):
        return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")

    verify(rows.where("node <> leader").select(*pair("node", "leader")).distinct(), 0)
    rows = rows.where("k > 2")  # the one pair of two sets is done
    turn, before = 0, float("inf")
    while True:
        turn += 1
        joined = components(scratch, union(linked), f"components-{turn}")
        placed = rows.select("token", "node", "n", "pos").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        drawn = F.struct(F.xxhash64("node", F.pmod(F.xxhash64("token"), F.lit(LEADERS)), F.lit(turn)).alias("h"), "node", "component")
        mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(drawn).alias("leader")).where("low <> high")
        open_rows = scratch.save(placed.join(mixed.select("token", F.col("leader.node").alias("leader"), F.col("leader.component").alias("leader_component")), "token"), f"open-{turn}")
        scratch.drop(f"open-{turn - 1}")
        sizes = open_rows.groupBy("token", "component").count().groupBy("token").agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.col("count")).alias("same"))
        work = sizes.agg(F.sum("k").alias("rows"), (F.sum(F.col("k") * F.col("k") - F.col("same")) / 2).alias("pairs")).first()
        left_pairs = work.pairs or 0
        if left_pairs > 4 * (work.rows or 0) and left_pairs < 0.7 * before:
            before = left_pairs
            verify(open_rows.where("component <> leader_component").select(*pair("node", "leader")).distinct(), turn)
            continue
        # Every pair that is left: the larger set's prefix against the smaller one's shorter prefix, in the same or the next lower band of sizes.
        band = F.floor(F.log("n") / math.log(den / num) * (1 - 1e-9)).cast("int") if num < den else F.col("n").cast("int")
        open_rows = open_rows.join(outline.select("node", _folded("parity", F.lit(JOIN_WORDS)).alias("parity")), "node").withColumn("band", band)
        side = lambda x: open_rows.select("token", "band", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "component", "parity")))
        left = side("a").withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
        right = side("b").where(F.expr(f"pos_b <= n_b - ({2 * num} * n_b + {num + den - 1}) div {num + den}"))
        room = F.expr("least(pos_a, pos_b) + 1 + least(n_a - pos_a - 1, n_b - pos_b - 1)")
        bits = sum((F.bit_count(F.get("parity_a", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i)))) for i in range(JOIN_WORDS)), F.lit(0))
        met = left.join(right, ["token", "band"]).where("component_a <> component_b and (n_b < n_a or (n_b = n_a and node_b < node_a))").where(close & (room >= need) & (F.col("n_a") + F.col("n_b") - bits >= 2 * need))
        verify(met.select(*pair("node_a", "node_b")), turn)
        break

    final = joined if linked[-1].isEmpty() else components(scratch, union(linked), "components-final")
    members = profiles.select("doc_id", "n", "d1", "d2").join(sets.select("d1", "d2", "node"), ["d1", "d2"], "left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    real = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    out = members.join(real, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))
