"""Operator 7: near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label form one class first. Trees begin with a fit on a
sample of at most about ``SAMPLE`` classes; each node splits along a random
direction where few vectors lie near the cut, and vectors within ``spill`` of
the cut go to both sides. Leaves that are still too large for one label are
then split again and again by cuts from quantiles of all their own vectors,
until they are small or no cut takes them apart (a knot). Every class is
indexed in every tree. Classes of one label that share a leaf are compared
exactly (cosine in double precision); a pair is counted in the first leaf that
it shares, so counts need no list of pairs. Knots are compared tile by tile in
separate tasks, without dropping any. A task returns numbers of links and a
spanning forest, which are then united.

Vectors that are null, empty, zero, or hold a null or non-finite component, and
those with a null label, link with nothing. Vectors of different length differ.
Repeated rows are other vectors, linked with each other. A null vec_id stays
null; rows of one vec_id are separate vectors in counts and one node in
components. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.graph import components
from aeroframe.llm.storage import Scratch

#: Classes that the trees are fitted on, at most about.
SAMPLE = 1 << 15
#: Sampled classes that a leaf keeps at least.
LEAST = 32
#: Sampled classes from which a leaf is cut even if its labels are small, so that small tables have several leaves, too.
SMALLEST = 48
#: Members of one label that a leaf is cut down to, and members of a tile.
LEAF, TILE = 512, 2048
#: Directions that a large leaf may be split along in one round, and rounds without a cut after which it is a knot.
TRIES, PATIENCE = 3, 2
#: Share of a node's vectors near a cut from which the cut isn't made: more copies would cost more than fewer comparisons save.
KNOT = 0.4
_NULL = -(1 << 63)


@dataclass
class Tree:
    direction: np.ndarray  # a row for each inner node
    cut: np.ndarray
    below: np.ndarray  # children: inner node k >= 0, leaf ~k


def fit_tree(points: np.ndarray, least: int, spill: float, rng: np.random.Generator) -> Tree:
    """Split until a node has at most ``least`` points; points near a cut are in both children."""
    directions, cuts, below, leaves = [], [], [], 0
    stack = [(np.arange(len(points)), -1, 0, 0)]
    while stack:
        own, parent, side, depth = stack.pop()
        best = None
        if len(own) > least and depth < 40:
            for _ in range(3):
                d = rng.standard_normal(points.shape[1])
                d /= np.linalg.norm(d)
                value = np.sort(points[own] @ d)
                at = np.unique(np.linspace(0.1, 0.9, 33) * (len(value) - 1)).astype(int)
                spot = (value[at] + value[at + 1]) / 2
                near = (np.searchsorted(value, spot + spill, "right") - np.searchsorted(value, spot - spill)) / len(value)
                score = near + np.abs(at / len(value) - 0.5)
                k = int(score.argmin())
                if near[k] < KNOT and (best is None or score[k] < best[0]):
                    best = (score[k], d, spot[k])
        if best is None:  # small enough, or a knot that no cut takes apart
            name, leaves = ~leaves, leaves + 1
        else:
            name = len(cuts)
            _, d, cut = best
            directions.append(d)
            cuts.append(cut)
            below.append([0, 0])
            value = points[own] @ d
            stack += [(own[value <= cut + spill], name, 0, depth + 1), (own[value >= cut - spill], name, 1, depth + 1)]
        if parent >= 0:
            below[parent][side] = name
    return Tree(np.array(directions).reshape(-1, points.shape[1]), np.array(cuts), np.array(below, np.int64).reshape(-1, 2))


def leaves_of(tree: Tree, points: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf of every point, points near a cut in several leaves."""
    row = np.arange(len(points))
    node = np.zeros(len(points), np.int64) if len(tree.cut) else np.full(len(points), -1)
    rows, found = [], []
    while len(row):
        done = node < 0
        rows.append(row[done])
        found.append(~node[done])
        row, node = row[~done], node[~done]
        value = np.einsum("ij,ij->i", points[row], tree.direction[node]) - tree.cut[node]
        low, high = value <= spill, value >= -spill
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([tree.below[node[low], 0], tree.below[node[high], 1]])
    return np.concatenate(rows), np.concatenate(found)


def best_cut(quantiles: np.ndarray, chances: np.ndarray, spill: float) -> tuple[float, float] | None:
    """Score and place of the best cut by a leaf's quantiles along a direction; None if each cut leaves most on both sides."""
    inner = np.flatnonzero((chances >= 0.1) & (chances <= 0.9))
    spot = quantiles[inner]
    near = np.interp(spot + spill, quantiles, chances, right=1.0) - np.interp(spot - spill, quantiles, chances, left=0.0)
    score = near + np.abs(chances[inner] - 0.5)
    k = int(score.argmin())
    return (float(score[k]), float(spot[k])) if near[k] < KNOT else None


def split_large(scratch: Scratch, classes: DataFrame, members: DataFrame, trees: int, spill: float, seed: int) -> DataFrame:
    """``members`` (key, label, size, tree, leaf) with every leaf that is too large for a label split until it isn't, or is a knot.

    A round projects the vectors of large leaves on a few directions of each
    tree, takes the leaves' quantiles (mergeable, so a leaf isn't gathered), and
    puts each vector into the children. Children are named by a hash; equal names would
    only join two leaves.
    """
    chances = np.concatenate([[0.0], np.linspace(0.02, 0.98, 49), [1.0]])
    knots, turn = None, 0
    while True:
        turn += 1
        large = members.groupBy("label", "size", "leaf").count().where(F.col("count") > 2 * LEAF).select("size", "leaf").distinct()
        if knots is not None:
            large = large.join(knots, "leaf", "left").where(F.coalesce("failed", F.lit(0)) < PATIENCE)
        else:
            large = large.withColumn("failed", F.lit(0))
        large = scratch.save(large.select("size", "leaf", F.coalesce("failed", F.lit(0)).alias("failed")), f"large-{turn}")
        if large.isEmpty():
            return members
        rng_of = lambda size, turn=turn: np.random.default_rng([seed, size, turn])

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                values = np.zeros((batch.num_rows, TRIES * trees))
                for size in np.unique(sizes).tolist():
                    d = rng_of(size).standard_normal((size, TRIES * trees))
                    where = np.flatnonzero(sizes == size)
                    values[where] = _unit(batch.column("vector").take(pa.array(where))) @ (d / np.linalg.norm(d, axis=0))
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (TRIES * trees))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(edges, pa.array(values.ravel()))], ["key", "projections"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"leaf": [], "failed": [], "way": [], "cut": []}
                for row in batch.to_pylist():
                    found = [(*c, i) for i in range(TRIES) if (c := best_cut(np.array(row[f"q{i}"]), chances, spill))]
                    _, cut, way = min(found, default=(0.0, 0.0, -1))
                    for name, value in zip(out, (row["leaf"], row["failed"] + (way < 0), way, cut), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["leaf"], pa.int64()), pa.array(out["failed"], pa.int32()), pa.array(out["way"], pa.int32()), pa.array(out["cut"], pa.float64())], list(out))

        inside = members.join(large, ["size", "leaf"])
        projected = classes.join(inside.select("key").distinct(), "key", "left_semi").select("key", "size", "vector").mapInArrow(project, "key long, projections array<double>")
        own = [F.get("projections", F.col("tree") * TRIES + i).alias(f"p{i}") for i in range(TRIES)]
        inside = scratch.save(inside.join(projected, "key").select(*inside.columns, *own), f"inside-{turn}")
        quantiles = [F.percentile_approx(f"p{i}", chances.tolist(), 1000).alias(f"q{i}") for i in range(TRIES)]
        cuts = inside.groupBy("leaf", "failed").agg(*quantiles).mapInArrow(choose, "leaf long, failed int, way int, cut double")
        cuts = scratch.save(cuts, f"cuts-{turn}")
        value = F.get(F.array(*(F.col(f"p{i}") for i in range(TRIES))), F.col("way")) - F.col("cut")
        child = lambda side: F.xxhash64("leaf", F.lit(side), F.lit(turn))
        below = F.when((F.col("way") < 0), F.col("leaf")).when(F.col("value") <= spill, child(0))
        above = F.when((F.col("way") >= 0) & (F.col("value") >= -spill), child(1))
        moved = inside.join(cuts.select("leaf", "way", "cut"), "leaf").withColumn("value", value)
        moved = moved.select("key", "label", "size", "tree", F.explode(F.array_compact(F.array(below, above))).alias("leaf"))
        rest = members.join(large.select("size", "leaf"), ["size", "leaf"], "left_anti").select("key", "label", "size", "tree", "leaf")
        members = scratch.save(rest.unionByName(moved), f"members-{turn}")
        failed = cuts.where("way < 0").select("leaf", "failed")
        knots = scratch.save(failed if knots is None else knots.join(failed.select("leaf"), "leaf", "left_anti").unionByName(failed), f"knots-{turn}")


def _unit(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def compare(x: pa.Table, y: pa.Table | None, leaf: int, least: float) -> dict[str, np.ndarray]:
    """Links between x and y (or inside x): each node's count of links first met in this leaf, and the smallest node of its knot here."""
    first, second = _unit(x.column("vector").combine_chunks()), None
    second = first if y is None else _unit(y.column("vector").combine_chunks())
    linked = first @ second.T >= least
    if y is None:
        np.fill_diagonal(linked, False)
    other = x if y is None else y
    node, node2 = x.column("node").to_numpy(), other.column("node").to_numpy()
    weight, weight2 = x.column("weight").to_numpy(), other.column("weight").to_numpy()
    hit, hit2 = linked.any(axis=1), linked.any(axis=0)

    def earlier(table: pa.Table, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = table.column("leaves").combine_chunks().take(pa.array(np.flatnonzero(keep)))
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        return owner[flat < leaf], flat[flat < leaf]

    links = linked[hit][:, hit2]
    a, b = earlier(x, hit), earlier(other, hit2)
    known = np.unique(np.concatenate([a[1], b[1]]))
    fresh = links
    if len(known) and links.size:
        m, m2 = np.zeros((links.shape[0], len(known)), np.float32), np.zeros((links.shape[1], len(known)), np.float32)
        m[a[0], np.searchsorted(known, a[1])] = 1
        m2[b[0], np.searchsorted(known, b[1])] = 1
        fresh = links & ~((m @ m2.T) > 0)
    count = fresh.astype(np.float64) @ weight2[hit2]
    root, root2 = node[hit], node2[hit2]
    big = np.iinfo(np.int64).max
    while links.size:  # smallest label by neighbours until nothing moves
        low = np.minimum(root, np.where(links, root2[None, :], big).min(axis=1))
        low2 = np.minimum(root2, np.where(links, low[:, None], big).min(axis=0)) if y is not None else low
        if (low == root).all() and (low2 == root2).all():
            break
        root, root2 = low, low2
    out = [(node[hit], count, root)]
    if y is not None:
        out.append((node2[hit2], fresh.T.astype(np.float64) @ weight[hit], root2))
    return {"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]).astype(np.int64), "root": np.concatenate([o[2] for o in out])}


def near_duplicates(vectors: DataFrame, least: float = 0.93, trees: int = 6, spill: float = 0.03, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    kind = "float" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    good = F.col(label_col).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))
    classes = rows.where("good").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = scratch.save(classes.withColumns({"size": F.size("vector"), "key": F.monotonically_increasing_id()}), "classes")

    counts = classes.groupBy("label", "size").count().groupBy("size").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()  # a row for each length
    forest: dict[int, list[Tree]] = {}
    leaf_count = 0
    starts: dict[int, list[int]] = {}
    for c in sorted(counts):
        share = min(1.0, SAMPLE / c.n)
        sample = classes.where((F.col("size") == c["size"]) & (F.abs(F.xxhash64("h1", "h2", F.lit(seed)) % 1_000_000) < int(share * 1_000_000))).select("vector").toArrow()
        points = _unit(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((0, c["size"]))
        rng = np.random.default_rng([seed, c["size"]])
        small = min(max(LEAST, int(len(points) * LEAF / max(1, c.most))), max(SMALLEST, len(points) // 8))  # several leaves at any size
        forest[c["size"]], starts[c["size"]] = [], []
        for _ in range(trees if len(points) > small else 1):
            tree = fit_tree(points, small, spill, rng)
            forest[c["size"]].append(tree)
            starts[c["size"]].append(leaf_count)
            leaf_count += len(tree.cut) + 1
    shared = spark.sparkContext.broadcast((forest, starts))  # at most SAMPLE / LEAST nodes a tree

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, starts = shared.value
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            lists: list = [None] * batch.num_rows
            kinds: list = [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                where = np.flatnonzero(sizes == size)
                points = _unit(batch.column("vector").take(pa.array(where)))
                found = [leaves_of(t, points, spill) for t in forest[size]]
                row = np.concatenate([f[0] for f in found])
                leaf = np.concatenate([f[1] + s for f, s in zip(found, starts[size], strict=True)])
                tree = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                order = np.argsort(row, kind="stable")
                stops = np.cumsum(np.bincount(row, minlength=len(where)))[:-1]
                for k, own, of in zip(where.tolist(), np.split(leaf[order], stops), np.split(tree[order], stops), strict=True):
                    lists[k], kinds[k] = own, of
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), batch.column("size"), pa.array(kinds, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int64()))], ["key", "label", "size", "tree", "leaf"])

    first = classes.select("key", "label", "size", "vector").mapInArrow(index, "key long, label string, size int, tree array<int>, leaf array<long>")
    members = scratch.save(first.select("key", "label", "size", F.inline(F.arrays_zip("tree", "leaf"))), "members-0")
    members = split_large(scratch, classes, members, trees, spill, seed)
    lists = members.groupBy("key").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a few for each tree
    indexed = scratch.save(classes.select("key", "node", "label", "weight", "vector").join(lists, "key").drop("key"), "indexed")
    placed = indexed.withColumn("leaf", F.explode("leaves"))
    large = scratch.save(members.groupBy("label", "leaf").count().where(F.col("count") > TILE).select("label", "leaf", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "tiled")
    if large.isEmpty():
        tiled = placed.withColumn("tile", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        tiled = placed.join(large, ["label", "leaf"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        tiled = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("tile", "with")).withColumn("j", F.greatest("tile", "with")).drop("tiles", "with")

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        _, at, i, j = (k.as_py() for k in key)
        if i == j:
            found = compare(table, None, at, least)
        else:
            side = table.column("tile").to_numpy()
            x, y = table.filter(pa.array(side == i)), table.filter(pa.array(side == j))
            found = compare(x, y, at, least) if x.num_rows and y.num_rows else {"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
        return pa.table({k: pa.array(found[k], pa.int64()) for k in ("node", "links", "root")})

    met = scratch.save(tiled.groupBy("label", "leaf", "i", "j").applyInArrow(leaf, "node long, links long, root long"), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(scratch, met.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    members = rows.select("vec_id", "label", "h1", "h2", "good").join(classes.select("label", "h1", "h2", "node", "weight", F.lit(True).alias("good")), ["label", "h1", "h2", "good"], "left")
    members = members.join(links, "node", "left").join(joined, "node", "left")
    own = F.when(F.col("vec_id") != _NULL, F.col("vec_id"))
    component = F.coalesce("component", "node", "vec_id")
    shown = F.when(component != _NULL, component)
    return members.select(own.alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"), shown.alias("component_id"), F.coalesce(own == shown, F.lit(False)).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
), low AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, low.c AS component_id, e.vec_id = low.c AS kept
FROM embeddings e JOIN low ON low.node = e.vec_id
"""
