"""Loading exports: preambles and rows are read on the executors.

Files are read as lines, in splits, once to learn what they say about
themselves: whether all of a file is UTF-8, its first lines, and the last ones
that tell the delimiter. Layouts are parsed from those in tasks and written as a
table with a row for each file; the driver gets one layout of each kind, not one
of each file. Then the rows are read; a line's place in its file follows from
the lines of the splits before. No file is held whole (but workbooks and UTF-16,
which can't be split).
"""

from __future__ import annotations

import hashlib
import pickle
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, time
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aeroframe.model import Moment
from aeroframe.operators.series import Series1D, first_by_time, present, union
from aeroframe.operators.sizes import Series2D
from aeroframe.session import file_system, qualified, shared_root
from aeroframe.sources import sniff
from aeroframe.sources.derive import sampled_volume
from aeroframe.sources.dialects import Head, Layout, layout
from aeroframe.sources.workbook import read_sheet

#: Bytes of a file's first lines that a layout is read from; last lines that tell the delimiter.
HEAD, LAST = 1 << 16, 10
SHEETS = (".xlsx", ".xlsm")
#: Files up to which the table of a layout's files is sent to every task.
MOST_SENT = 100_000


@dataclass
class Export:
    """A kind of files: those that agree in all that their rows are read by."""

    sep: str
    encoding: str
    layout: Layout


def list_files(spark: SparkSession, folder: str, search_word: str = "", max_subfolder: int = 0) -> list[str]:
    """Files below a folder of any store, down to a depth, whose names hold a word; sorted.

    Spark lists them; hidden files (a leading dot or underscore) are none.
    """
    root = qualified(spark, folder)
    files, path = file_system(spark, root)
    if not files.exists(path):
        raise FileNotFoundError(folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_literal(root)).select("path").toArrow().column("path").to_pylist()
    below = len(re.sub(_STORE, "", root).rstrip("/")) + 1
    depth = lambda p: re.sub(_STORE, "", p)[below:].count("/")
    return sorted(p for p in found if depth(p) <= max_subfolder and search_word in posixpath.basename(p))


def nested_files(spark: SparkSession, folder: str, search_word: str = "", max_subfolder: int = 0) -> list[list[str]]:
    """The same by folder."""
    groups: dict[str, list[str]] = {}
    for path in list_files(spark, folder, search_word, max_subfolder):
        groups.setdefault(posixpath.dirname(path), []).append(path)
    return [groups[k] for k in sorted(groups)]


def sheet_lines(content: bytes) -> list[str]:
    """Rows of a workbook's first sheet as lines with ';' between cells, dates and times as the text export has them."""

    def shown(cell: object) -> str:
        if isinstance(cell, datetime):
            return cell.strftime("%d-%m-%Y" if cell.time() == time() else "%d-%m-%Y %H:%M:%S")
        if isinstance(cell, (date, time)):
            return cell.strftime("%d-%m-%Y" if isinstance(cell, date) else "%H:%M:%S")
        text = "" if cell is None else str(cell)
        return '"' + text.replace('"', '\\"') + '"' if ";" in text else text

    return [";".join(map(shown, row)) for row in read_sheet(content)]


_STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _place(path: Column, escaped: bool) -> Column:
    """A file's path without its store, which Spark spells in several ways, and without escapes."""
    bare = F.regexp_replace(path, _STORE, "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))) if escaped else bare


def _literal(path: str) -> str:
    """A path whose signs mean themselves to readers that take patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _read(spark: SparkSession, kind: str, paths: Sequence[str]) -> DataFrame:
    """Files by one reader; the paths go over to the JVM as one text, not one by one."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.regex.Pattern.compile("\n").split("\n".join(map(_literal, paths)))
    return DataFrame(spark._jsparkSession.read().format(kind).load(given), spark)


def _unsplit(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """(place, lines) of workbooks (``sheet``) and UTF-16 files, each in one task."""
    content = _read(spark, "binaryFile", paths).select(_place(F.col("path"), False).alias("place"), "content")
    if encoding != "sheet":
        text = F.regexp_replace(F.decode("content", encoding), "^\ufeff", "")
        lines = content.select("place", F.split(text, "\r\n|\r|\n").alias("lines"))
        return lines.withColumn("lines", F.expr("if(element_at(lines, -1) = '', slice(lines, 1, size(lines) - 1), lines)"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, whole in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found = sheet_lines(whole.as_py())
                except ValueError:
                    found = None  # no workbook
                yield pa.RecordBatch.from_arrays([pa.array([place.as_py()]), pa.array([found], pa.list_(pa.string()))], ["place", "lines"])

    return content.mapInArrow(read, "place string, lines array<string>")


def _last(lines: Sequence[bytes]) -> list[bytes]:
    """The last lines that hold something and are no comment."""
    found: list[bytes] = []
    for line in reversed(lines):
        shown = line.strip()
        if shown and not shown.startswith(b"#"):
            found.append(line)
            if len(found) == LAST:
                break
    return found[::-1]


class _Split:
    """What the lines of one split say: whether they are UTF-8, the file's first ones, and the last ones."""

    def __init__(self, path: str, block: int):
        self.path, self.block, self.valid, self.head, self.held, self.last = path, block, True, [], 0, []

    def add(self, lines: pa.BinaryArray) -> None:
        if self.valid:
            try:
                lines.cast(pa.string())
            except pa.ArrowInvalid:
                self.valid = False
        at = 0
        while not self.block and self.held < HEAD and at < len(lines):
            line = lines[at].as_py()[:HEAD]
            self.head.append(line)
            self.held += len(line) + 1
            at += 1
        step = max(64, LAST)
        found: list[bytes] = []
        for stop in range(len(lines), 0, -step):  # a few lines from the end are enough
            found = _last(lines[max(0, stop - step) : stop].to_pylist()) + found
            if len(found) >= LAST:
                break
        self.last = (self.last + found)[-LAST:]


def _splits(read: DataFrame) -> DataFrame:
    """(path, block, valid, head, last) of every split of text files."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("valid", pa.bool_()), ("head", pa.binary()), ("last", pa.list_(pa.binary()))])

    def said(splits: list[_Split]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": s.path, "block": s.block, "valid": s.valid, "head": b"\n".join(s.head), "last": s.last} for s in splits], schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Split | None = None
        for batch in batches:
            path, block, lines = batch.columns
            name = path.dictionary_encode().indices
            fresh = pc.or_(pc.not_equal(name[1:], name[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            done = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                key = (path[i].as_py(), block[i].as_py())
                if now is None or (now.path, now.block) != key:
                    done += [] if now is None else [now]
                    now = _Split(*key)
                now.add(lines[i:j])
            yield said(done)
        if now is not None:
            yield said([now])

    return read.mapInArrow(look, "path string, block long, valid boolean, head binary, last array<binary>")


def _looks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(place, encoding, head, last): what tells a file's layout; files without a line aren't there.

    A line never ends inside a sign of UTF-8, so a file is UTF-8 if each of its
    lines is, whatever the splits.
    """
    sheets = [p for p in paths if p.lower().endswith(SHEETS)]
    texts = [p for p in paths if not p.lower().endswith(SHEETS)]
    parts = []

    def unsplit(paths: Sequence[str], encoding: str) -> DataFrame:
        lines = _unsplit(spark, paths, encoding).select("place", F.transform("lines", lambda x: x.cast("binary")).alias("lines"))
        shown = lines.select("place", F.lit(encoding).alias("encoding"), F.array_join(F.slice("lines", 1, 2000).cast("array<string>"), "\n").cast("binary").alias("head"), F.expr("if(size(lines) > 500, slice(lines, -500, 500), lines)").alias("last"))
        return shown.select("place", "encoding", F.coalesce("head", F.lit(b"")).alias("head"), F.coalesce("last", F.array().cast("array<binary>")).alias("last"))

    if texts:
        read = _read(spark, "text", texts).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
        last = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "last"))), lambda b: b["last"]))
        mark = F.hex(F.substring("head", 1, 2))
        files = _splits(read).groupBy(_place(F.col("path"), True).alias("place")).agg(F.bool_and("valid").alias("valid"), F.min_by("head", "block").alias("head"), last.alias("last"))
        files = files.withColumn("encoding", F.when(mark == "FFFE", "UTF-16LE").when(mark == "FEFF", "UTF-16BE").when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1")).select("place", "encoding", "head", "last")
        files = _written(spark, files, "looks")
        wide = files.where("encoding like 'UTF-16%'").select("place", "encoding").collect()  # files that can't be split
        parts.append(files.where("encoding not like 'UTF-16%'"))
        full = {re.sub(_STORE, "", p): p for p in texts} if wide else {}
        for encoding in sorted({r.encoding for r in wide}):
            parts.append(unsplit([full[r.place] for r in wide if r.encoding == encoding], encoding))
    if sheets:
        parts.append(unsplit(sheets, "sheet"))
    return reduce(DataFrame.unionByName, parts)


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A working table in the shared folder, until the driver's JVM ends."""
    uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    files, path = file_system(spark, uri)
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(uri)


_FILE = "place string, error string, kind string, export binary, first int, start timestamp_ntz, step double, known string"


def _inspect(spark: SparkSession, paths: Sequence[str], dialect: str | Callable[[Head], Layout], check: Sequence[str] = ()) -> DataFrame:
    """A row for each file: its layout or why it has none, numbered in the order of places (``file_seq``)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, encoding, head, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coded = encoding if encoding == "ISO-8859-1" else "UTF-8"
                try:
                    if encoding == "sheet" and not head:
                        raise ValueError("not a workbook, or an empty one")
                    sep = ";" if encoding == "sheet" else sniff.delimiter("\n".join(x.decode(coded) for x in _last(last)))
                    made = layout(dialect, head.decode(coded, "ignore").removeprefix("\ufeff"), sep)
                except ValueError as error:
                    rows.append({"place": place, "error": str(error)})
                    continue
                known = [getattr(made.meta, c) if hasattr(made.meta, c) else made.meta.extra.get(c) for c in check]
                kind = repr((sep, encoding, made.header, made.time, made.footer, made.bins, made.values, made.meta.bins, made.meta.data_type))
                rows.append({"place": place, "kind": hashlib.sha256(kind.encode()).hexdigest(), "export": pickle.dumps(Export(sep, encoding, made)), "first": made.first, "start": made.start, "step": made.step, "known": repr(known)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("place", pa.string()), ("error", pa.string()), ("kind", pa.string()), ("export", pa.binary()), ("first", pa.int32()), ("start", pa.timestamp("us")), ("step", pa.float64()), ("known", pa.string())])
    found = _looks(spark, paths).select("place", "encoding", "head", "last").mapInArrow(parse, _FILE)
    numbered = found.repartitionByRange("place").sortWithinPartitions("place").withColumn("file_seq", F.monotonically_increasing_id())
    return _written(spark, numbered, "layouts")


def _lines(spark: SparkSession, export: Export, files: DataFrame, paths: Sequence[str]) -> DataFrame:
    """file_seq, first, start, step, row_seq (a line's place in its file), n (lines of the file) and the line."""
    encoding = export.encoding
    if encoding == "sheet" or encoding.startswith("UTF-16"):
        lines = _unsplit(spark, paths, encoding).select("place", F.size("lines").cast("long").alias("n"), F.posexplode("lines").alias("row_seq", "line"))
    else:
        read = _read(spark, "text", paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value").withColumn("id", F.monotonically_increasing_id())
        blocks = read.groupBy("path", "block").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
        own = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("path", "block", "low", F.coalesce(F.sum("rows").over(own), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy("path")).alias("n"), _place(F.col("path"), True).alias("place"))
        line = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
        lines = read.join(blocks, ["path", "block"]).select("place", (F.col("id") - F.col("low") + F.col("base")).alias("row_seq"), "n", F.regexp_replace(line, "^\ufeff", "").alias("line"))
    known = files.select("place", "file_seq", "first", "start", "step")
    return lines.join(F.broadcast(known) if len(paths) <= MOST_SENT else known, "place").drop("place")


def _rows(spark: SparkSession, export: Export, files: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Lines of files of one kind as columns c0, c1, ..., with file_seq, row_seq, i, start and step."""
    one = export.layout
    rows = _lines(spark, export, files, paths)
    rows = rows.where((F.col("row_seq") >= F.col("first")) & (F.col("row_seq") < F.col("n") - one.footer) & (F.trim("line") != "")).withColumn("i", F.col("row_seq") - F.col("first"))
    schema = ", ".join(f"c{k} string" for k in range(len(one.header)))
    return rows.withColumn("cells", F.from_csv("line", schema, {"sep": export.sep, "mode": "PERMISSIVE"})).select("file_seq", "row_seq", "i", "start", "step", "cells.*")


def _series(rows: DataFrame, one: Layout, extra_data: bool) -> Series1D:
    time = F.expr(one.time).cast("timestamp_ntz").alias("ts")
    order = ["file_seq", "row_seq"]
    values = {**one.values, **{c: e for c, e in zip(one.meta.bins.columns if one.meta.bins else [], one.bins, strict=True)}}
    df = rows.select(time, *(F.expr(e).cast("double").alias(n) for n, e in values.items()), *order).where("ts is not null")
    if one.complete:
        df = present(df, values)
    extra = rows.select(time, *(F.expr(e).alias(n) for n, e in one.extra.items()), *order).where("ts is not null") if extra_data and one.extra else None
    if one.meta.bins is None:
        made = Series1D(df, one.meta, "ts", list(one.values))
        made.extra_data = extra
        return made
    made = Series2D.from_bins(df, one.meta.bins, meta=one.meta, extra=extra, by=order)
    made = made._with(made.df, by=()).convert(Moment.NUMBER).unnormalize()
    made.original_data = made.df.drop(*order)
    return made


def _finished(series: Series1D, keep_all: bool = False) -> Series1D:
    order = ("file_seq", "row_seq")
    extra = series.extra_data
    if extra is not None and not keep_all:
        extra = first_by_time(extra, [series.ts], order)
    return series._with(series.df.drop(*order), extra_data=extra and extra.drop(*order))


def _sampled(series: Series1D) -> Series1D:
    """With the summary of the rows with a sample, where the export has such a flag."""
    if "tem" not in series.values:
        return series
    found = sampled_volume(series.df, "ts", "tem", "flow").first()
    if found is None or (found.samples or 0) < 2:
        raise ValueError("fewer than two rows of a sample")
    return series._with(series.df, meta=replace(series.meta, extra={**series.meta.extra, "tem_samples": [found.asDict()]}))


def load(spark: SparkSession, path: str, dialect: str | Callable[[Head], Layout], extra_data: bool = False) -> Series1D:
    """One export as a series; size distributions as plain numbers in each bin.

    ``dialect`` is the name of one, or a function from the first lines to a layout.
    """
    full = qualified(spark, path)
    store, at = file_system(spark, full)
    if not store.exists(at):
        raise FileNotFoundError(path)
    files = _inspect(spark, [full], dialect)
    row = files.first()
    if row is None or row.error is not None:
        raise ValueError(f"{path}: {'the file has no line' if row is None else row.error}")
    export = pickle.loads(row.export)
    try:
        return _sampled(_finished(_series(_rows(spark, export, files, [full]), export.layout, extra_data)))
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from error


def load_folder(spark: SparkSession, folder: str, dialect: str | Callable[[Head], Layout], search_word: str = "", max_subfolder: int = 0, check: Sequence[str] = ("serial_number",), extra_data: bool = False, overlapping: bool = False, keep_all: bool = False) -> Series1D:
    """All exports of a folder as one series by time: rows of the earliest file win where times meet, or all stay (``keep_all``).

    Files that can't be read are left out, as are those whose checked metadata
    differ from the first one's. Files with one layout are read by one scan;
    bins of different sizes stay apart (see ``union``, also for ``overlapping``).
    Rows with a sample are summed up for each file, those of fewer than two
    rows of a sample left out.
    """
    paths = list_files(spark, folder, search_word, max_subfolder)
    name = dialect if isinstance(dialect, str) else dialect.__name__
    if not paths:
        raise ValueError(f"no file of {name} in {folder}")
    files = _inspect(spark, paths, dialect, check).where("error is null")
    known = files.agg(F.min_by("known", "file_seq")).first()[0]
    files = files.where(F.col("known") == known)
    kinds = files.groupBy("kind").agg(F.min("file_seq").alias("first"), F.min_by("export", "file_seq").alias("export")).orderBy("first").collect()  # a row for each kind of layout
    full = {re.sub(_STORE, "", p): p for p in paths}
    parts, samples = [], []
    for kind in kinds:
        own, export = files.where(F.col("kind") == kind.kind), pickle.loads(kind.export)
        places = own.select("place").toArrow().column("place").to_pylist()
        made = _series(_rows(spark, export, own, [full[p] for p in places]), export.layout, extra_data)
        if "tem" in made.values:
            sums = _written(spark, sampled_volume(made.df, "ts", "tem", "flow", by=("file_seq",)).where("samples >= 2"), "samples")
            found = [r.asDict() for r in sums.orderBy("file_seq").drop("file_seq").collect()]  # a row of metadata for each file
            samples += found
            if not found:
                continue
            made = made._with(made.df.join(sums.select("file_seq"), "file_seq", "left_semi").select(*made.df.columns))
        order = ["file_seq", "row_seq"]
        parts.append(_finished(made.ordered(order) if keep_all else made.deduplicated(order), keep_all))
    if not parts:
        raise ValueError(f"no file of {name} in {folder}")
    whole = parts[0] if len(parts) == 1 else union(parts, check=(), overlapping=overlapping, keep_all=keep_all)
    return whole._with(whole.df, meta=replace(whole.meta, extra={**whole.meta.extra, "tem_samples": samples})) if samples else whole
