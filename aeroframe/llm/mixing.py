"""Operator 10: mixing sources to target weights by Pareto order sampling.

Targets: sources share ``share`` of all words by weight, none above ``most``
times its own words; what is cut off is shared again. Inside a source every
document first gets the whole copies that are certain. The fraction left is a
sample of fixed size in words with unequal inclusion: documents fall into
length classes (powers of two), longer ones being likelier by ``tilt``, and are
ranked by random odds divided by their inclusion odds. The ranking is cut where
its words reach the target, at the nearer end of the document on the border.

All figures of the sources stay tables: they are put in order by ranges, with
running sums over the ranges, and the rank at the border comes from sums over
buckets of the rank, of which only the border bucket of each source is sorted.
The driver gets the number of sources, all words, and one level. The decision is
then an expression of the row and its source, so documents aren't shuffled.

Draws are hashes of doc_id, text, a seed, and the row's number among rows that
agree in doc_id, source and text, so reruns agree, and rows without an id or
with one id are drawn apart. Rows that agree are numbered inside the parts of a
written table first, so that a crowd of them isn't sorted by one task.

Null text has size 0 and is never taken more than 0 words; a null source is a
source of its own, last in order. An empty table gives no rows. Other columns
are kept by ``resample`` and ignored by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a bucket of the rank, about.
BUCKET_DOCS = 2048
#: Sources up to which their table (about 0.6 kB a row) is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 4096


def _in_order(rows: DataFrame, scratch: Scratch, name: str, order: list[Column], before: tuple[str, ...] = (), left: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``__place`` in a global order, sums of the rows ``before`` and of those ``left`` (itself included).

    Rows are sorted by ranges; only a row for each range meets in one task.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = scratch.save(parts.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    sums = parts.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__sum_{c}") for c in {*before, *left}))
    none = lambda c: F.coalesce(c, F.lit(0))
    earlier, later = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("__part", F.desc("__part")))
    base = {"__base": none(F.sum("__n").over(earlier))} | {f"__base_{c}": none(F.sum(f"__sum_{c}").over(earlier)) for c in before} | {f"__rest_{c}": none(F.sum(f"__sum_{c}").over(later)) for c in left}
    joined = parts.join(F.broadcast(sums.select("__part", *(c.alias(n) for n, c in base.items()))), "__part")
    up, down = (Window.partitionBy("__part").orderBy(o) for o in ("__at", F.desc("__at")))
    shown = {f"__left_{c}": F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col(f"__rest_{c}") for c in left}
    shown |= {f"__before_{c}": none(F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, -1))) + F.col(f"__base_{c}") for c in before}
    return joined.withColumns(shown).withColumn("__place", F.row_number().over(up) - 1 + F.col("__base")).select(*rows.columns, "__place", *shown)


def capped_shares(rows: DataFrame, by: list[str], total: str, weight: str, cap: str, name: str, scratch: Scratch | None = None) -> DataFrame:
    """Shares of ``total`` by weight, none above its cap; the excess is shared again by weight.

    A row's level, were all rows that are capped before it full, is what is left
    for each unit of weight; the first row that stays below its cap sets it.
    Without ``by`` and with ``scratch``, rows are put in order by ranges.
    """
    ends = F.col(cap) / F.col(weight), F.xxhash64(*rows.columns)
    opened = F.when((F.col(total) - F.col(f"__before_{cap}")) / F.col(f"__left_{weight}") * F.col(weight) <= F.col(cap), F.struct(F.col("__place").alias("step"), ((F.col(total) - F.col(f"__before_{cap}")) / F.col(f"__left_{weight}")).alias("level")))
    if by or scratch is None:
        up, down = Window.partitionBy(*by).orderBy(*ends), Window.partitionBy(*by).orderBy(*(F.desc(e) for e in ends))
        steps = rows.withColumn(f"__left_{weight}", F.sum(weight).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        steps = steps.withColumns({f"__before_{cap}": F.coalesce(F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "__place": F.row_number().over(up)})
        level = F.min(opened).over(Window.partitionBy(*by))["level"]
    else:
        steps = _in_order(rows, scratch, f"{name}-steps", list(ends), (cap,), (weight,))
        first = steps.agg(F.min(opened).alias("first")).first()[0]
        level = F.lit(None if first is None else first.level).cast("double")
    return steps.withColumn(name, F.least(F.coalesce(level * F.col(weight), F.col(cap)), F.col(cap))).select(*rows.columns, name)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _class() -> Column:
    return F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(0).cast("int")


def plan(sized: DataFrame, scratch: Scratch, share: float, weights: tuple[float, ...], most: int, tilt: float) -> DataFrame:
    """A row for each source, in code-point order, null last: its words, target, whole copies, what is wanted beyond, and odds by length class."""
    classes = scratch.save(sized.groupBy("mix_key", _class().alias("class")).agg(F.sum("size").cast("double").alias("words"), F.count("*").alias("docs")), "classes")
    own = classes.groupBy("mix_key").agg(F.sum("words").alias("source_words"), F.sum("docs").alias("docs"))
    own = _in_order(own, scratch, "by-name", [F.col("mix_key").asc_nulls_last()])
    own = own.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__place") % len(weights)).cast("int"))).drop("__place")
    total = classes.agg(F.sum("words")).first()[0] or 0.0
    own = own.withColumn("all", F.lit(float(share) * total)).withColumn("cap", most * F.col("source_words"))
    own = capped_shares(own, [], "all", "weight", "cap", "target", scratch)
    copies = F.when(F.col("source_words") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_words")))).otherwise(0).cast("long")
    own = own.withColumn("copies", copies).withColumn("wanted", F.when((F.col("source_words") > 0) & (F.col("copies") < most), F.col("target") - F.col("copies") * F.col("source_words")).otherwise(0.0))
    own = own.select(F.col("mix_key").alias("mix_source"), F.col("source_words").cast("long").alias("source_size"), "target", "copies", "wanted", F.greatest(F.lit(1), F.floor(F.col("docs") / BUCKET_DOCS)).cast("long").alias("buckets"))
    sizes = classes.where("words > 0").join(own.where("wanted > 0").select("mix_source", "wanted"), F.col("mix_key").eqNullSafe(F.col("mix_source"))).drop("mix_key")
    sizes = sizes.withColumn("weight", F.col("words") * F.pow(F.lit(2.0), F.lit(float(tilt)) * F.col("class")))
    odds = capped_shares(sizes, ["mix_source"], "wanted", "weight", "words", "part").groupBy(F.col("mix_source").alias("named")).agg(F.map_from_entries(F.collect_list(F.struct("class", F.least(F.lit(1.0), F.col("part") / F.col("words"))))).alias("odds"))
    return own.join(odds, F.col("mix_source").eqNullSafe(F.col("named")), "left").drop("named")


def _ranked(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows with mix_id, mix_key (the source), mix_mark, mix_number and size, and the rank: random odds over inclusion odds, mapped to 0..1."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("mix_id").cast("string"), F.lit("null")), "mix_mark", F.lit(str(seed)), F.col("mix_number").cast("string")))
    some = lambda at: F.conv(F.substring("mix_draw", at, 12), 16, 10)
    ranked = sized.withColumns({"mix_class": _class(), "mix_draw": digest}).join(sources, F.col("mix_key").eqNullSafe(F.col("mix_source")))
    ranked = ranked.withColumns({"draw": some(1).cast("double") / float(1 << 48), "tie": some(13).cast("long"), "chance": F.coalesce(F.expr("odds[mix_class]"), F.lit(0.0))})
    high = F.col("draw") * (1 - F.col("chance"))
    low = (1 - F.col("draw")) * F.col("chance")
    return ranked.withColumn("rank", F.when(F.col("chance") > 0, high / (high + low)).otherwise(1.0)).withColumn("bucket", F.least(F.floor(F.col("rank") * F.col("buckets")), F.col("buckets") - 1))


def _decided(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """With taken_copies: the whole ones, and one more up to the source's cut."""
    ranked = _ranked(sized, sources, seed)
    within = F.expr("bucket < border or (bucket = border and (rank < cut.rank or (rank = cut.rank and (tie < cut.tie or (tie = cut.tie and size <= cut.size)))))")
    return ranked.withColumn("taken_copies", F.col("copies") + F.coalesce(within, F.lit(False)).cast("long"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, *kept: Column) -> DataFrame:
    return docs.select(*kept, F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_key"), words(text_col).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("mix_mark"))


_SAME = ("mix_id", "mix_key", "mix_mark")


def _numbered(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """With mix_number, the place of each row among those that agree: inside parts of a written table, then beyond the parts before."""
    rows = slim.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    rows = scratch.save(rows, "repeated")
    counts = rows.groupBy(*_SAME, "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*_SAME).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*(F.col(c).alias(f"__{c}") for c in _SAME), F.col("__part").alias("__of"), "__before")
    inside = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*_SAME, "__part").orderBy("__row")) - 1)
    same = F.col("__part") == F.col("__of")
    for c in _SAME:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return inside.join(before, same).withColumn("mix_number", F.col("__before") + F.col("__in")).select(*slim.columns, "mix_number")


def _apart(slim: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """All rows with their numbers: 0 for those that are alone."""
    if repeated.isEmpty():
        return slim.withColumn("mix_number", F.lit(0).cast("long"))
    other = repeated.select(*(F.col(c).alias(f"__{c}") for c in _SAME))
    same = F.col("mix_mark") == F.col("__mix_mark")
    for c in _SAME[:2]:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    alone = slim.join(other, same, "left_anti").withColumn("mix_number", F.lit(0).cast("long"))
    return alone.unionByName(_numbered(slim.join(other, same, "left_semi"), scratch))


def _sized(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Sizes and marks of all rows, and the keys that several rows agree in."""
    sized = scratch.save(_slim(docs, id_col, text_col, source_col), "sized")
    return sized, scratch.save(sized.groupBy(*_SAME).count().where("count > 1").select(*_SAME), "agreeing")


def _cut(sized: DataFrame, scratch: Scratch, share: float, weights: tuple[float, ...], most: int, tilt: float, seed: int) -> DataFrame:
    """The sources' table with the place where each source's ranking is cut."""
    sources = scratch.save(plan(sized, scratch, share, weights, most, tilt), "sources")
    shown = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda t: t
    sums = _ranked(sized, shown(sources), seed).where("wanted > 0").groupBy("mix_source", "bucket").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    run = sums.withColumn("until", F.sum("words").over(Window.partitionBy("mix_source").orderBy("bucket")))
    first = run.where("until >= wanted").groupBy(F.col("mix_source").alias("named")).agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"))).alias("at"))
    whole = F.when(F.col("wanted") > 0, F.col("buckets")).otherwise(-1)  # no border: all rows, or none
    bordered = sources.join(first, F.col("mix_source").eqNullSafe(F.col("named")), "left").select(*sources.columns, F.coalesce("at.bucket", whole).alias("border"), F.coalesce("at.before", F.lit(0)).alias("before"))
    bordered = scratch.save(bordered, "bordered")
    order = Window.partitionBy("mix_source").orderBy("rank", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = _ranked(sized, shown(bordered), seed).where("bucket = border").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = edge.where("ahead + size / 2 <= wanted").groupBy(F.col("mix_source").alias("named")).agg(F.max(F.struct("rank", "tie", "size")).alias("cut"))
    return shown(scratch.save(bordered.join(last, F.col("mix_source").eqNullSafe(F.col("named")), "left").drop("named"), "cut"))


def resample(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: int = 2, tilt: float = 0.25, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized, repeated = _sized(docs, scratch, id_col, text_col, source_col)
    sources = _cut(_apart(sized, repeated, scratch), scratch, share, weights, most, tilt, seed)
    # The document in a struct, so that its columns' names can't clash with ours.
    rows = _slim(docs, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"))
    taken = _decided(_apart(rows, repeated, Scratch(docs.sparkSession, "mixing-rows")), sources, seed).where("taken_copies > 0")
    return taken.select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken_copies")))).select("mix_row.*")


def mixture(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: int = 2, tilt: float = 0.25, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = _apart(*_sized(docs, scratch, id_col, text_col, source_col), scratch)
    done = _decided(sized, _cut(sized, scratch, share, weights, most, tilt, seed), seed)
    return done.select(F.col("mix_id").alias("doc_id"), F.col("mix_key").alias("source"), "size", "source_size", "target", (F.col("size") * F.col("taken_copies")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS mark,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS number FROM documents
), classed AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(size)) AS INT) ELSE 0 END AS class FROM sized
), own AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM classed GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM own
), steps AS (
  SELECT *, (total - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS step_no
  FROM ranked WINDOW o AS (ORDER BY 2 * source_size::DOUBLE / w, source NULLS LAST)
), level AS (SELECT arg_min(level, step_no) FILTER (level * w <= 2 * source_size) AS x FROM steps
), targets AS (
  SELECT source, source_size, CASE WHEN level.x IS NOT NULL AND level.x * w <= 2 * source_size THEN level.x * w ELSE 2.0::DOUBLE * source_size END AS target FROM steps, level
), wants AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target / source_size)) END AS copies,
    CASE WHEN source_size = 0 OR floor(target / source_size) >= 2 THEN 0.0::DOUBLE ELSE target - floor(target / source_size) * source_size END AS wanted FROM targets
), classes AS (
  SELECT c.source, c.class, sum(c.size)::DOUBLE AS words, sum(c.size)::DOUBLE * pow(2.0::DOUBLE, 0.25::DOUBLE * c.class) AS w, any_value(wants.wanted) AS wanted
  FROM classed c JOIN wants ON c.source IS NOT DISTINCT FROM wants.source WHERE c.size > 0 GROUP BY c.source, c.class
), class_steps AS (
  SELECT *, (wanted - coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS step_no
  FROM classes WINDOW o AS (PARTITION BY source ORDER BY words / w, class)
), class_level AS (SELECT source, arg_min(level, step_no) FILTER (level * w <= words) AS x FROM class_steps GROUP BY source
), odds AS (
  SELECT s.source, s.class, least(1.0::DOUBLE, CASE WHEN l.x IS NOT NULL AND l.x * s.w <= s.words THEN l.x * s.w ELSE s.words END / s.words) AS p
  FROM class_steps s JOIN class_level l ON s.source IS NOT DISTINCT FROM l.source
), drawn AS (
  SELECT c.*, wants.source_size, wants.target, wants.copies, wants.wanted, coalesce(odds.p, 0.0) AS p,
    md5(coalesce(c.doc_id::VARCHAR, 'null') || ':' || c.mark || ':17:' || c.number) AS draw, ('0x' || substr(draw, 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM classed c JOIN wants ON c.source IS NOT DISTINCT FROM wants.source LEFT JOIN odds ON c.source IS NOT DISTINCT FROM odds.source AND c.class = odds.class AND c.size > 0
), placed AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) ELSE 1.0 END AS rank FROM drawn
), summed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, substr(draw, 13, 12), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed)
SELECT doc_id, source, size, source_size, target, CAST(size * (copies + CASE WHEN wanted > 0 AND ahead + size / 2 <= wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM summed
"""
