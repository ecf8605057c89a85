"""Operator 4: k-d tree partitioning of documents into shards of near equal bytes.

Each node of the tree is split along its widest metadata dimension (extent over
the whole table's extent) at the weighted median of the bytes, until every leaf
is one shard of about the target bytes. A node is named by its first shard, and
the nodes of a level are a written table. A median is found exactly by repeated
sums over buckets of the value's range, for all nodes of a level at once, until
the bucket that holds it has few rows, which are put in order. Sums, running sums
and the choice of the bucket stay on the executors; the driver only asks whether
a node still has many rows. Rows that tie at the median are split by a row
number, so a large group of equal documents is divided as well. Slots come from
counts of buckets and a row number inside each. DataFrame operations only.

Null text counts as empty; null ids, sources and languages have a value of
their own. Repeated rows are separate rows. A very long text is one row: a shard is
larger than the others by no more than that. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch

#: Buckets of all nodes of a level together in one pass, as long as each has at least ``LEAST``.
BUCKETS, LEAST = 1 << 16, 1 << 8
#: Rows about a median that are put in order in one window; a node of more is narrowed first.
FEW = 1 << 14
#: Rows numbered in one window, about.
SLOT_ROWS = 4096
_LOWEST = -(1 << 62)
DIMS = ("doc", "size", "source", "lang")
_DIV = lambda a, b: F.call_function("div", a, b)


def _value() -> Column:
    return F.element_at(F.array(*DIMS), F.col("dim"))


def _inside(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows in their node's range: of the value, or of row numbers where a value ties."""
    key = F.when(F.col("tie").isNotNull(), F.col("row")).otherwise(_value())
    return rows.join(nodes, "node").withColumn("key", key).where("key between lo and hi").where(F.col("tie").isNull() | (_value() == F.col("tie")))


def _opened(rows: DataFrame, nodes: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Nodes with their widest dimension, its range, the rows in it and the bytes that go left."""
    stats = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *(f(d).alias(f"{d}_{f.__name__}") for d in DIMS for f in (F.min, F.max)))
    extents = F.array(*((F.col(f"{d}_max") - F.col(f"{d}_min")) / F.lit(spans[d]) for d in DIMS))
    ends = [F.element_at(F.array(*(f"{d}_{end}" for d in DIMS)), F.col("dim")) for end in ("min", "max")]
    wide = nodes.join(stats, "node").withColumn("dim", F.array_position(extents, F.array_max(extents)).cast("int"))
    need = F.col("bytes") * F.col("half") / F.col("shards")
    return wide.select("node", "shards", "half", "dim", ends[0].alias("lo"), ends[1].alias("hi"), "n", need.alias("need"), F.lit(None).cast("long").alias("tie"))


def _narrowed(rows: DataFrame, nodes: DataFrame, buckets: int, most: int) -> DataFrame:
    """Nodes of many rows after one more pass, with the bucket that holds the median as their range; others as they are."""
    step = _DIV(F.col("hi") - F.col("lo"), F.lit(buckets)) + 1
    wide = nodes.where(F.col("n") > FEW).select("node", "dim", "lo", "hi", "tie", "need", step.alias("step"))
    sums = _inside(rows, wide.drop("need")).groupBy("node", _DIV(F.col("key") - F.col("lo"), F.col("step")).alias("bucket")).agg(F.sum("size").alias("weight"), F.count("*").alias("found"))
    running = F.sum("weight").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("until", running).join(wide.select("node", "need"), "node").where("until > need")
    chosen = over.groupBy("node").agg(F.min_by(F.struct("bucket", "weight", "until", "found"), "bucket").alias("at"))
    low = F.col("lo") + F.col("at.bucket") * step
    high = F.least(F.col("hi"), low + step - 1)
    tied = (low == high) & F.col("tie").isNull()
    keep = lambda name, new: F.when(F.col("at").isNull(), F.col(name)).otherwise(new).alias(name)
    return nodes.join(chosen, "node", "left").select(
        "node", "shards", "half", "dim", keep("lo", F.when(tied, F.lit(0)).otherwise(low)), keep("hi", F.when(tied, F.lit(most)).otherwise(high)), keep("n", F.col("at.found")),
        keep("need", F.col("need") - (F.col("at.until") - F.col("at.weight"))), keep("tie", F.when(tied, low).otherwise(F.col("tie"))),
    )


def _cut(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of few rows in their range, with the value and row up to which rows go left."""
    placed = _inside(rows, nodes.select("node", "dim", "lo", "hi", "tie", "need")).select("node", F.struct(_value().alias("value"), "row").alias("place"), "size", "need")
    until = F.sum("size").over(Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rest = F.col("need") - (F.col("until") - F.col("size"))
    left = (F.col("until") <= F.col("need")) | ((rest >= 0) & (2 * rest >= F.col("size")))
    ends = placed.withColumn("until", until).groupBy("node").agg(F.max(F.when(left, F.col("place"))).alias("last"), F.min("place").alias("next"))
    row = F.when(F.col("last").isNull(), F.col("next.row") - 1).otherwise(F.col("last.row"))
    return nodes.join(ends, "node").select("node", "shards", "half", "dim", F.coalesce("last.value", "next.value").alias("cut"), row.alias("cut_row"))


def _halved(nodes: DataFrame) -> DataFrame:
    """Nodes of more than one shard, with how many go left."""
    return nodes.where("shards > 1").withColumn("half", _DIV(F.col("shards"), F.lit(2)))


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; ``shards`` or else ``target_bytes`` sets the leaves."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    code = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.crc32(F.col(c).cast("string"))).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(F.shiftright(F.col(id_col).cast("long"), 2), F.lit(_LOWEST)).alias("doc"), code(source_col).alias("source"), code(lang_col).alias("lang"), F.monotonically_increasing_id().alias("row"),
    )
    rows = scratch.save(rows.withColumn("node", F.lit(0).cast("long")), "level-0")  # row numbers are fixed from here on
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("row").alias("row"), *(f(d).alias(f"{d}_{f.__name__}") for d in DIMS for f in (F.min, F.max))).first()
    if shards is None:
        shards = max(1, -(-(whole.bytes or 0) // target_bytes))
    spans = {d: max(1, whole[f"{d}_max"] - whole[f"{d}_min"]) for d in DIMS} if whole.n else {}
    nodes = spark.range(0, 1, 1, 1).select(F.col("id").alias("node"), F.lit(shards).cast("long").alias("shards"))
    for level in range((shards - 1).bit_length() if whole.n else 0):
        opened, turn = scratch.save(_opened(rows, _halved(nodes), spans), f"nodes-{level}-0"), 0
        while not opened.where(F.col("n") > FEW).isEmpty():
            turn += 1
            opened = scratch.save(_narrowed(rows, opened, max(LEAST, BUCKETS >> level), whole.row), f"nodes-{level}-{turn}")
            scratch.drop(f"nodes-{level}-{turn - 1}")
        cuts = scratch.save(_cut(rows, opened), f"cuts-{level}")
        right = (_value() > F.col("cut")) | ((_value() == F.col("cut")) & (F.col("row") > F.col("cut_row")))
        placed = rows.join(cuts.select("node", "dim", "half", "cut", "cut_row"), "node", "left")
        rows = scratch.save(placed.withColumn("node", F.when(right, F.col("node") + F.col("half")).otherwise(F.col("node"))).select(*rows.columns), f"level-{level + 1}")
        scratch.drop(f"level-{level}")
        nodes = cuts.select(F.inline(F.array(F.struct("node", F.col("half").alias("shards")), F.struct((F.col("node") + F.col("half")).alias("node"), (F.col("shards") - F.col("half")).alias("shards")))))
    rows = rows.select("doc_id", "size", "text_crc32", "row", F.col("node").cast("int").alias("shard"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(max(1, whole.n // (shards * SLOT_ROWS)))))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    placed = rows.join(base, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
