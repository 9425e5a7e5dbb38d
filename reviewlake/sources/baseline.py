"""The baseline as a source and sink: JSON rows of (file, message) in a folder that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.operators.tables import written

ENTRIES = "file string, message string"


def _there(spark: SparkSession, path: str):
    """The file system of a path and the path, for existence and deletion."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save(entries: DataFrame, path: str) -> None:
    """Writes entries in place of what is there; they may come from a read of the same path. Duplicates stay."""
    written(entries.select("file", "message"), "baseline").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries; None if there is no baseline."""
    files, where = _there(spark, path)
    return spark.read.schema(ENTRIES).json(path) if files.exists(where) else None


def clear(spark: SparkSession, path: str) -> bool:
    """Deletes the baseline; whether there was one."""
    files, where = _there(spark, path)
    return files.delete(where, True)
