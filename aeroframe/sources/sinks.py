"""Writing results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from aeroframe.session import file_system, qualified
from aeroframe.sources.workbook import SHEET_ROWS, write_workbook


def save_table(df: DataFrame, path: str, mode: str = "error", sheet_rows: int = SHEET_ROWS) -> None:
    """By the path's ending: csv (with a header), json, a workbook, or parquet for anything else.

    A workbook is one file in any store Spark writes to: partitions are
    fetched one after the other and written on as they come, with a further
    sheet wherever one is full.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xls":
        raise ValueError("the old binary workbooks aren't written; use .xlsx")
    if kind == "xlsx":
        spark = df.sparkSession
        files, target = file_system(spark, qualified(spark, path))
        if files.exists(target) and mode != "overwrite":
            if mode == "ignore":
                return
            raise FileExistsError(path)
        with tempfile.NamedTemporaryFile(suffix=".xlsx") as local:  # the driver's own, then moved to the store
            write_workbook(local, df.columns, df.toLocalIterator(prefetchPartitions=True), sheet_rows)
            local.flush()
            files.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local.name}"), target)
        return
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)
