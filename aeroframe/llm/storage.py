"""Working tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from aeroframe.session import file_system, shared_root


def small_batches(spark: SparkSession, rows: int = 2048, size: int = 1 << 22) -> None:
    """Send texts to Python in batches of at most so many rows, and of about so many bytes, for the rest of the session.

    Spark's defaults of 10,000 rows and 64 MB take hundreds of MB for the
    batches of a task's two sides where texts are long.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= size:
        spark.conf.set(key, str(size))


#: What this Python worker keeps from one task to the next.
KEPT: dict = {}


def _forget() -> None:
    KEPT.clear()  # here, as closures sent to workers take copies of what they name


def _give_back() -> None:
    """Free pages of Arrow and of malloc (where it is glibc's) go back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` for ``mapInArrow``, giving free memory back after each batch and at the task's end.

    Workers live on for further tasks, and beside the JVM's while idle; else
    each holds the most that any task took. Without ``keep``, what other
    operators keep in the worker goes first; they make it anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        if not keep:
            _forget()
        yield from function(fed())
        _give_back()

    return run


class Scratch:
    """Written tables that cut lineage; a lost executor only rereads them. They go when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        files, path = file_system(spark, self.uri)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.uri}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        files, path = file_system(self.spark, f"{self.uri}/{name}")
        files.delete(path, True)


class SharedFiles:
    """Binary files under a shared URI, usable inside tasks.

    A ``file:`` URI is opened (and memory-mapped) directly; any other scheme
    goes through ``pyarrow.fs``.
    """

    def __init__(self, uri: str):
        self.uri = uri
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        self.path = parsed.path if self.local else uri

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def write(self, name: str, chunks) -> str:
        """Write chunks of bytes under a name of this attempt's own, then rename.

        A repeated attempt of the task leaves one complete file.
        """
        attempt = f".{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.path, exist_ok=True)
            target = os.path.join(self.path, name)
            with open(os.path.join(self.path, attempt), "wb") as out:
                for chunk in chunks:
                    out.write(chunk)
            os.replace(os.path.join(self.path, attempt), target)
            return name
        files, base = self._fs()
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{attempt}") as out:
            for chunk in chunks:
                out.write(chunk)
        files.move(f"{base}/{attempt}", f"{base}/{name}")
        return name

    def map(self, name: str):
        """The file's bytes as a buffer: memory-mapped where it is local."""
        if self.local:
            path = os.path.join(self.path, name)
            return pa.memory_map(path).read_buffer() if os.path.getsize(path) else pa.py_buffer(b"")
        files, base = self._fs()
        with files.open_input_file(f"{base}/{name}") as source:
            return source.read_buffer()
