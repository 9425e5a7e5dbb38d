"""The snapshot store: nodes and edges as Parquet partitioned by snapshot. A missing snapshot reads as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.schemas import EDGES, NODES
from reviewlake.operators import graph


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        """A schema that lacks a column of today's reads as null there; a missing table is empty."""
        where = f"{self.path}/{name}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where)

    def flush(self, nodes: DataFrame, edges: DataFrame, snapshot: str) -> None:
        """Replaces the snapshot."""
        for name, df in (("nodes", nodes), ("edges", edges)):
            df.withColumn("snapshot", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{self.path}/{name}")

    def nodes(self, snapshot: str) -> DataFrame:
        return self._table("nodes", NODES).filter(F.col("snapshot") == snapshot)

    def edges(self, snapshot: str) -> DataFrame:
        return self._table("edges", EDGES).filter(F.col("snapshot") == snapshot)

    def snapshots(self) -> DataFrame:
        return snapshot_counts(self._table("nodes", NODES), self._table("edges", EDGES))

    def delete_snapshot(self, snapshot: str) -> None:
        for name in ("nodes", "edges"):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/snapshot={snapshot}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def node(self, node: int, snapshot: str) -> DataFrame:
        return self.nodes(snapshot).filter(F.col("id") == node)

    def find_nodes(self, path: str, snapshot: str, name: str | None = None) -> DataFrame:
        return graph.find_nodes(self.nodes(snapshot), path, name)

    def find_nodes_by_kind(self, kind: str, snapshot: str) -> DataFrame:
        return self.nodes(snapshot).filter(F.col("kind") == kind)

    def node_count(self, snapshot: str) -> int:
        return self.nodes(snapshot).count()

    def edges_from(self, node: int, snapshot: str) -> DataFrame:
        return graph.edges_from(self.edges(snapshot), node)

    def edges_to(self, node: int, snapshot: str) -> DataFrame:
        return graph.edges_to(self.edges(snapshot), node)

    def direct_dependents(self, node: int, snapshot: str) -> DataFrame:
        return graph.direct_dependents(self.edges(snapshot), node)

    def dependencies(self, node: int, snapshot: str) -> DataFrame:
        return graph.dependencies(self.edges(snapshot), node)

    def transitive_dependents(self, node: int, snapshot: str, max_depth: int | None = None) -> DataFrame:
        return graph.transitive_dependents(self.edges(snapshot), node, max_depth)

    def transitive_dependencies(self, node: int, snapshot: str, max_depth: int | None = None) -> DataFrame:
        return graph.transitive_dependencies(self.edges(snapshot), node, max_depth)

    def find_by_edge_kind(self, node: int, kind: str, snapshot: str) -> DataFrame:
        return graph.by_edge_kind(self.edges(snapshot), node, kind)

    def find_changed_nodes(self, old: str, new: str) -> DataFrame:
        from reviewlake.operators.impact import changed_nodes

        return changed_nodes(self.nodes(old), self.nodes(new))


def snapshot_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, node_count, edge_count of each snapshot that has nodes or edges."""
    n = nodes.groupBy(F.col("snapshot").alias("name")).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(F.col("snapshot").alias("name")).agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, "name", "full").select("name", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
