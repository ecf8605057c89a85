"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Wide size distributions need more fields in generated code than the default of 100.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.maxFields": "1000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}


def builder(name: str = "aeroframe") -> SparkSession.Builder:
    made = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made


def file_system(spark: SparkSession, uri: str):
    """Hadoop's file system of a URI, and its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def qualified(spark: SparkSession, uri: str) -> str:
    """With the scheme that Spark gives it, so that tables and plain files meet in one store."""
    files, path = file_system(spark, uri)
    return files.makeQualified(path).toString().rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """URI of the shared working folder: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set (tests, one machine) a folder of the driver's own is
    made and set as the session's checkpoint folder; on a cluster, whose
    executors don't see the driver's disk, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir: {master} has no folder that the driver and its executors share")
        root = "file://" + tempfile.mkdtemp(prefix="aeroframe-")
        spark.sparkContext.setCheckpointDir(root)
    return qualified(spark, root)
