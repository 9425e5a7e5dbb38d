"""Continuous review: a stream of file versions, micro-batches of changed files, and events as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming.query import StreamingQuery

from reviewlake.operators import findings
from reviewlake.plans.review import line_findings
from reviewlake.sources.config import Config

DEBOUNCE = "300 milliseconds"
#: A version of a file: content is null where it was deleted.
CHANGES = t.StructType([t.StructField("ts", t.TimestampType()), t.StructField("path", t.StringType()), t.StructField("content", t.StringType())])


def changes(spark: SparkSession, folder: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(CHANGES).format(format).load(folder)


def latest_versions(batch: DataFrame) -> DataFrame:
    """The last version of each path in a batch, without deleted ones."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("content"), "ts").alias("v"))
    return last.select("path", "v.content").filter("content IS NOT NULL")


def events(found: DataFrame, batch_id: int) -> DataFrame:
    """seq, kind, payload: progress, then findings, then done."""
    spark = found.sparkSession
    head = spark.range(1).select(F.lit(0).alias("seq"), F.lit("progress").alias("kind"), F.lit(str(batch_id)).alias("payload"))
    tail = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("seq"), F.lit("done").alias("kind"), F.col("n").cast("string").alias("payload"))
    rows = found.select(F.lit(1).alias("seq"), F.lit("finding").alias("kind"), F.to_json(F.struct(*found.columns)).alias("payload"))
    return head.unionByName(rows).unionByName(tail)


def watch(stream: DataFrame, sink: Callable[[DataFrame, int], None], config: Config | None = None, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Reviews each batch of changed files by line rules and gives its events to sink; stop() of the query ends it.

    A trigger interval gathers changes as a debounce does. A failing batch is one error event.
    """
    config = config or Config()

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            found = findings.number(line_findings(latest_versions(batch), config), config.ignore_findings)
            sink(events(found, batch_id), batch_id)
        except ValueError as error:
            spark = batch.sparkSession
            sink(spark.createDataFrame([(1, "error", str(error))], "seq int, kind string, payload string"), batch_id)

    writer = stream.writeStream.foreachBatch(run).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def sessions(stream: DataFrame, gap: str = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """window, paths: changes of a path set that lie closer than the gap, as the debounce would flush them."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap)).agg(F.sort_array(F.collect_set("path")).alias("paths"))
