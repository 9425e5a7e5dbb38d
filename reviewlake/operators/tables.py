"""Intermediate tables in the shared folder, which cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, and only where driver and tasks share a machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = getattr(sc, "_reviewlake_tables", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="reviewlake-tables-")
            sc._reviewlake_tables = folder
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sequenced(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with a running number from 1 in the order of columns, without a window over all rows.

    Rows are ranged and sorted, numbered by partition, and moved by the counts of the partitions before.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "sequenced")
    ranged = ranged.withColumn("_part", F.shiftright("_place", 33))
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = ranged.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")  # one row a partition
    return moved.withColumn(out, F.col("_place") - F.shiftleft("_part", 33) + F.col("_before") + 1).select(*df.columns, out)
