"""Reading tables and writing intermediate ones in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Stands for a null doc_id where ids are compared: the largest number.
NULL_ID = (1 << 63) - 1


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, and only where driver and tasks share a machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = getattr(sc, "_reviewlake_folder", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="reviewlake-")
            sc._reviewlake_folder = folder
            sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, doc (never null), tie, text: rows of one id are told apart by a hash of their text, where ids repeat at all."""
    ids = F.coalesce("doc_id", F.lit(NULL_ID))
    repeat = not docs.groupBy(ids.alias("doc")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return docs.select("doc_id", ids.alias("doc"), (F.xxhash64("text") if repeat else F.lit(0).cast("long")).alias("tie"), "text")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    This cuts the lineage in a way that survives the loss of any executor, and makes a table that
    several branches read cost its computation once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: The most rows of two numbers that are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 500_000
SALTS = 8


def looked_up(rows: DataFrame, table: DataFrame, key: str, salt: Column) -> DataFrame:
    """rows left-joined with a stored table of one small row a key. A hot key meets one row, in several tasks."""
    if table.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), key, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")
