"""Operator 11: the trie of conversation prefixes, by van Emde Boas recursion.

A node is a distinct sequence of first turns. The depths of the trie are cut at
half, the prefixes that end at the cut get names, and the upper trie and the
lower forests, one under each name, are trees of half the depth that are cut in
the same way. All trees of one size are worked on at once, so a trie of depth D
takes log2(D) rounds down:

* Upward, the digests of blocks of 1, 2, 4, ... turns of each conversation,
  each made of two halves (``block_digests``).
* Downward, from the largest block on: the prefix that ends at a cut is named
  by the name of the prefix at the block's start and the digest of the upper
  half (``name_prefixes``). The cuts of a round are the starts of the next.
* Upward again, totals are grafted: what the lower forests of a round hold is
  summed by cut prefix and added to that prefix's ancestors in the upper trie,
  along the turns of one conversation that has it (``graft``). As such a
  conversation has a turn for each ancestor, a round makes no more rows than
  there are turns.

Rows are keyed by conversation and place, so a conversation of very many turns
is spread like any other; names shared by many conversations are only ever
aggregated, or joined where skewed joins are split. Names and digests are 128
bits of SHA-256; texts aren't moved.

Results for odd input: null role and text count as empty; a null turn sorts
first; turns that tie are ordered by the SHA-256 of the role's length, the role
and the text; repeated rows are turns each; rows with a null conv_id belong to
no conversation and are left out; empty and very long texts are turns as any;
an empty table gives no nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch

#: Consecutive turns, and conv_ids, that a join or a list takes as one group.
CHUNK_BITS = 10
LIST_BITS = 12
ROOT = b"\0" * 16


def _digest(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _root() -> Column:
    return F.lit(bytearray(ROOT))


def numbered_turns(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, p, digest, chars) with p from 1 in the order of turns, and (conv_id, n).

    Turns are sorted by ranges of conversation and turn, so that one
    conversation may take many tasks; a turn's place is its place in its part
    plus its conversation's turns in the parts before.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.char_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest(said).alias("digest"), F.char_length(text("text")).cast("long").alias("chars"))
    slim = scratch.save(slim.withColumn("place", F.monotonically_increasing_id()), "slim")
    order = ("conv_id", "turn", "digest", "place")
    placed = scratch.save(slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "starts")
    turns = placed.join(starts.select("conv_id", "part", "first", "before"), ["conv_id", "part"])
    turns = turns.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("p"), "digest", "chars")
    return scratch.save(turns, "numbered"), starts.groupBy("conv_id").agg(F.sum("rows").alias("n"))


def shared_openings(scratch: Scratch, turns: DataFrame, lengths: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of conversation c - c % every, then their own after the first h; h = crc32(c) % most."""
    drawn = lengths.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = lengths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    taken = F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    made = scratch.save(drawn.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "lengths")
    # A conversation's turns are joined in runs, so that one of very many isn't one group.
    runs = made.withColumn("length", F.col("n") - F.col("taken") + F.col("h")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("length", CHUNK_BITS))))
    own = turns.withColumn("run", F.shiftright("p", CHUNK_BITS)).join(runs.drop("length"), ["conv_id", "run"]).where("p > h")
    own = own.select("conv_id", (F.col("taken") + F.col("p") - F.col("h")).alias("p"), "digest", "chars", (F.col("taken") + F.col("p") - F.col("h") == F.col("n")).alias("ends"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("p") < most)).withColumnRenamed("conv_id", "base")
    opened = made.where("taken > 0").join(heads, "base").where("p <= taken").select("conv_id", "p", "digest", "chars", (F.col("p") == F.col("n")).alias("ends"))
    return scratch.save(own.unionByName(opened), "rebuilt"), made.select("conv_id", "n")


def block_digests(scratch: Scratch, turns: DataFrame, longest: int) -> list[DataFrame]:
    """For j = 0, 1, ...: every whole block b of 2^j turns of a conversation, its digest and what its last turn is."""
    levels = [scratch.save(turns.select("conv_id", (F.col("p") - 1).alias("b"), "digest", "chars", "ends"), "blocks-0")]
    while longest >> len(levels):
        half = lambda c, odd: F.max(F.when(F.col("b") % 2 == odd, F.col(c)))
        two = levels[-1].groupBy("conv_id", F.shiftright("b", 1).alias("to")).agg(half("digest", 0).alias("left"), half("digest", 1).alias("right"), half("chars", 1).alias("chars"), half("ends", 1).alias("ends"))
        two = two.where("right is not null").select("conv_id", F.col("to").alias("b"), _digest(F.concat("left", "right")).alias("digest"), "chars", "ends")
        levels.append(scratch.save(two, f"blocks-{len(levels)}"))
    return levels


def name_prefixes(scratch: Scratch, blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, p, name, chars, ends): the name of each conversation's first p turns, for every p, by halving."""
    named: DataFrame | None = None
    for j in reversed(range(len(blocks))):
        upper = blocks[j].where("b % 2 = 0").withColumn("start", F.shiftleft("b", j))
        if named is None:
            upper = upper.withColumn("before", _root())
        else:
            upper = upper.join(named.select("conv_id", F.col("p").alias("start"), F.col("name").alias("above")), ["conv_id", "start"], "left").withColumn("before", F.coalesce("above", _root()))
        cut = upper.select("conv_id", F.shiftleft(F.col("b") + 1, j).alias("p"), _digest(F.concat("before", "digest")).alias("name"), "chars", "ends")
        cut = scratch.save(cut, f"names-{j}")
        named = cut if named is None else named.unionByName(cut)
    return named


def graft(scratch: Scratch, own: DataFrame, paths: DataFrame, rounds: int, sums: tuple[str, ...]) -> DataFrame:
    """(name, ``sums``): what every node gets from the nodes below it, where there are any.

    ``own`` has a node's own values; ``paths`` the names along conversations.
    In round j a node whose depth - 1 is an odd multiple of 2^j is on top of a
    lower forest; its total is complete, as the forests below it were grafted
    in the rounds before.
    """
    paths = paths.select("conv_id", F.shiftright(F.col("p") - 1, CHUNK_BITS).alias("chunk"), "p", "name", "parent")
    known = own.select("name", "parent", "depth", "via", *sums)
    grafted: DataFrame | None = None
    added = lambda: (F.sum(c).alias(c) for c in sums)
    for j in range(rounds):
        tops = known.where(F.col("depth").bitwiseAND(F.lit((2 << j) - 1)) == (1 << j) + 1) if j else known.where("depth % 2 = 0")
        cut = tops.groupBy("parent").agg((F.min("depth") - 1).alias("cut"), F.min("via").alias("conv_id"), *added()).drop("parent")
        chunks = F.sequence(F.shiftright(F.col("cut") - (1 << j), CHUNK_BITS), F.shiftright(F.col("cut") - 1, CHUNK_BITS))
        spread = cut.withColumn("chunk", F.explode(chunks))
        above = spread.join(paths, ["conv_id", "chunk"]).where((F.col("p") <= F.col("cut")) & (F.col("p") > F.col("cut") - (1 << j)))
        more = above.groupBy("name").agg(F.first("parent").alias("parent"), F.first("p").alias("depth"), F.min("conv_id").alias("via"), *added())
        more = scratch.save(more, f"grafted-{j}")
        known = known.unionByName(more)
        grafted = more if grafted is None else grafted.unionByName(more)
    return grafted.groupBy("name").agg(*added())


def _hashed_lists(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the ascending conv_ids of each name, comma-joined.

    Lists are joined by runs of ids first; the hash, which needs them in order,
    reads the runs as a stream, so a list of any length takes no memory.
    """
    runs = members.groupBy("name", F.shiftright("conv_id", LIST_BITS).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("name", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("said"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, digests = [], []
            for own, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != name:
                    if state:
                        names.append(name)
                        digests.append(state.hexdigest())
                    name, state = own, hashlib.sha256(said.encode())
                else:
                    state.update(b"," + said.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    return runs.repartition("name").sortWithinPartitions("name", "run").select("name", "said").mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(scratch: Scratch, turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the trie.

    ``turns``: conv_id, p (from 1, without gaps), digest, chars, ends (whether
    it is the last). ``lengths``: conv_id and n, also of those without turns.
    Returned: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (of the subtree: members but one times
    the last text's code points), ends_sha256 (of the members that end here).
    """
    all_convs = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("n").alias("longest")).first()
    longest = all_convs.longest or 0
    blocks = block_digests(scratch, turns, longest)
    named = name_prefixes(scratch, blocks)
    before = named.select("conv_id", (F.col("p") + 1).alias("p"), F.col("name").alias("before"))
    paths = scratch.save(named.join(before, ["conv_id", "p"], "left").select("conv_id", "p", "name", F.coalesce("before", _root()).alias("parent"), "chars", "ends"), "paths")
    nodes = paths.groupBy("name").agg(F.first("parent").alias("parent"), F.first("p").alias("depth"), F.min("conv_id").alias("via"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    nodes = scratch.save(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    own = nodes.join(children, "name", "left").select("name", "parent", "depth", "via", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"), saved)
    own = scratch.save(own, "own")
    sums = ("n_leaves", "saved_tokens")
    below = graft(scratch, own, paths, len(blocks), sums).select("name", *(F.col(c).alias(f"{c}_below") for c in sums))
    whole = own.join(below, "name", "left").select(*(c for c in own.columns if c not in sums), *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums))
    whole = scratch.save(whole, "whole")
    first = whole.where("depth = 1")
    top = first.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = top.where(F.lit(all_convs.n > 0)).select(
        _root().alias("name"), F.lit(all_convs.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_convs.n).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
    )
    shown = lambda df, parent: df.select("name", F.col("via").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", *sums)
    parents = whole.select(F.col("name").alias("parent"), F.col("via").alias("parent_conv_id"))
    deep = shown(whole.where("depth > 1").join(parents, "parent"), F.col("parent_conv_id"))
    rows = root.unionByName(shown(first, F.lit(all_convs.least).cast("long"))).unionByName(deep)
    members = paths.where("ends").select("name", "conv_id").unionByName(lengths.where("n = 0").select(_root().alias("name"), "conv_id"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return rows.join(_hashed_lists(members), "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("name")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns (conv_id, turn, role, text)."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, lengths = shared_openings(scratch, *numbered_turns(scratch, conversations))
    return prefix_trie(scratch, turns, lengths)


#: Prefixes as lists of turns; a node's total is the sum over the nodes whose first member has the node's prefix.
OP11_SQL = r"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base, count(*) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 AS h
  FROM numbered GROUP BY conv_id
), rebuilt AS (
  SELECT c, p, role, text FROM convs JOIN numbered ON numbered.conv_id = base AND p <= h
  UNION ALL
  SELECT c, least(h, coalesce(b.n, 0)) + p - h, role, text FROM convs
    JOIN numbered ON numbered.conv_id = c AND p > h LEFT JOIN (SELECT c AS at, n FROM convs) b ON b.at = base
), whole AS (SELECT c, list({'r': role, 't': text} ORDER BY p) AS turns FROM rebuilt GROUP BY c
), members AS (
  SELECT c, 0 AS depth, [] AS path, NOT EXISTS (SELECT 1 FROM whole w WHERE w.c = convs.c) AS ends FROM convs
  UNION ALL SELECT c, d, turns[1:d], d = len(turns) FROM (SELECT c, turns, unnest(range(1, len(turns) + 1)) AS d FROM whole)
), named AS (SELECT c, depth, ends, sha256(to_json(path)::VARCHAR) AS name, CASE WHEN depth > 0 THEN sha256(to_json(path[1:depth - 1])::VARCHAR) END AS parent, length(path[depth].t) AS chars FROM members
), nodes AS (
  SELECT name, min(c) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM named GROUP BY name
), children AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent
), own AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON children.parent = nodes.name
), sums AS (
  SELECT a.name, sum((u.n_children = 0)::BIGINT) AS n_leaves, sum((u.n_convs - 1) * coalesce(u.chars, 0)) AS saved
  FROM own u JOIN named a ON a.c = u.conv_id AND a.depth <= u.depth GROUP BY a.name
)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(o.n_convs AS BIGINT) AS n_convs, CAST(o.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.name = o.name LEFT JOIN own p ON p.name = o.parent
"""
