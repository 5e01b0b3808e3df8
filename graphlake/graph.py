"""The graph container: nodes and edges as DataFrames, with filters, lookups, adjacency, degrees and statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake import errors

NODE_CAPACITY, EDGE_CAPACITY, EMBEDDING_CAPACITY = 10_000, 50_000, 1_000


@dataclass(frozen=True)
class Graph:
    """``nodes(id, label, ...)``, ``edges(src, dst, label, ...)`` and, where there are any, ``embeddings(node_id, vector)``. Immutable: every change is a new graph.

    A boolean column ``active`` on either frame marks soft deletes; rows without it count as live. ``simple`` says that no two rows of
    edges are equal in all columns; else equal rows are parallel edges.
    """

    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None = None
    simple: bool = False

    @staticmethod
    def from_rows(spark: SparkSession, nodes: list[tuple], edges: list[tuple], node_schema: str = "id bigint, label string", edge_schema: str = "src bigint, dst bigint, label string") -> Graph:
        return Graph(spark.createDataFrame(nodes, node_schema), spark.createDataFrame(edges, edge_schema))

    @staticmethod
    def _live(df: DataFrame) -> DataFrame:
        return df.where("active") if "active" in df.columns else df

    @property
    def live_nodes(self) -> DataFrame:
        return self._live(self.nodes)

    @property
    def live_edges(self) -> DataFrame:
        return self._live(self.edges)

    def nodes_by_label(self, label: str | int, column: str = "label", limit: int | None = None) -> DataFrame:
        out = self.live_nodes.where(F.col(column) == F.lit(label))
        return out.orderBy("id").limit(limit) if limit else out

    def edges_by_label(self, *labels: str | int, limit: int | None = None) -> DataFrame:
        out = self.live_edges.where(F.col("label").isin(*labels))
        return out.orderBy("src", "dst").limit(limit) if limit else out

    def find_node(self, node_id: int) -> DataFrame:
        """The live node of that id: one row or none."""
        return self.live_nodes.where(F.col("id") == node_id).limit(1)

    def get_node(self, node_id: int) -> dict:
        rows = self.find_node(node_id).collect()
        if not rows:
            raise errors.NodeNotFound(node_id)
        return rows[0].asDict()

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The live nodes whose ids are in ``ids(id)``."""
        return self.live_nodes.join(ids.select("id"), "id", "left_semi")

    def nodes_by_property(self, label: str, name: str, value: object) -> DataFrame:
        if name not in self.nodes.columns:
            raise errors.PropertyNotFound(name)
        return self.nodes_by_label(label).where(F.col(name).eqNullSafe(F.lit(value)))

    def nodes_with(self, *components: str) -> DataFrame:
        """Nodes that have a value for all of these columns."""
        out = self.live_nodes
        for c in components:
            out = out.where(F.col(c).isNotNull())
        return out

    def outgoing(self, node_id: int, limit: int | None = None) -> DataFrame:
        out = self.live_edges.where(F.col("src") == node_id)
        return out.limit(limit) if limit else out

    def incoming(self, node_id: int, limit: int | None = None) -> DataFrame:
        out = self.live_edges.where(F.col("dst") == node_id)
        return out.limit(limit) if limit else out

    def expand(self, frontier: DataFrame, direction: str = "out", labels: tuple[str, ...] = ()) -> DataFrame:
        """Edges that leave (``out``), enter (``in``) or touch (``both``) the nodes of ``frontier(id)``, with the far end as ``other``."""
        e = self.edges_by_label(*labels) if labels else self.live_edges
        ends = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
        parts = [frontier.select("id").join(e.withColumn("other", F.col(far)), F.col("id") == F.col(near)) for near, far in ends]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def degrees(self, direction: str = "out") -> DataFrame:
        """``(id, degree)``; every parallel edge counts."""
        col = {"out": "src", "in": "dst"}.get(direction)
        if col:
            return self.live_edges.groupBy(F.col(col).alias("id")).agg(F.count("*").alias("degree"))
        ends = self.live_edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    def stats(self, node_capacity: int = NODE_CAPACITY, edge_capacity: int = EDGE_CAPACITY, embedding_capacity: int = EMBEDDING_CAPACITY) -> DataFrame:
        """One row: live counts, and utilization as a fraction of the nominal capacities (it may exceed 1)."""
        n = self.live_nodes.agg(F.count("*").alias("node_count"))
        e = self.live_edges.agg(F.count("*").alias("edge_count"))
        out = n.crossJoin(e)
        used, cap = F.col("node_count") + F.col("edge_count"), node_capacity + edge_capacity
        if self.embeddings is not None:
            out = out.crossJoin(self.embeddings.agg(F.count("*").alias("embedding_count")))
            used, cap = used + F.col("embedding_count"), cap + embedding_capacity
        return out.withColumn("utilization", F.round(used / F.lit(float(cap)), 6))

    def with_undirected(self) -> DataFrame:
        """The simple undirected edges ``(u, v)``, u < v: loops and parallel edges are dropped."""
        e = self.live_edges.where("src <> dst")
        return e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Soft delete: the nodes are no longer live; their edges stay."""
        gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
        live: Column = F.col("active") if "active" in self.nodes.columns else F.lit(True)
        nodes = self.nodes.join(gone, "id", "left").withColumn("active", live & F.col("_gone").isNull()).drop("_gone")
        return replace(self, nodes=nodes)

    def delete_edges(self, pairs: DataFrame, label: str | None = None) -> Graph:
        """Soft delete of all edges from ``src`` to ``dst`` of ``pairs(src, dst)``, of one label if it is given."""
        gone = pairs.select("src", "dst").distinct().withColumn("_gone", F.lit(True))
        live: Column = F.col("active") if "active" in self.edges.columns else F.lit(True)
        hit = F.col("_gone").isNotNull() if label is None else F.col("_gone").isNotNull() & (F.col("label") == label)
        edges = self.edges.join(gone, ["src", "dst"], "left").withColumn("active", live & ~F.coalesce(hit, F.lit(False))).select(*self.edges.columns, *([] if "active" in self.edges.columns else ["active"]))
        return replace(self, edges=edges)

    def add_embeddings(self, rows: DataFrame) -> Graph:
        """``rows(node_id, vector)`` appended; a node that has a vector already gets the new one."""
        new = rows.select("node_id", "vector")
        old = self.embeddings.join(new.select("node_id"), "node_id", "left_anti").select("node_id", "vector").unionByName(new) if self.embeddings is not None else new
        return replace(self, embeddings=old)

    def embedding(self, node_id: int) -> list[float] | None:
        """The vector of a node, or None."""
        if self.embeddings is None:
            return None
        row = self.embeddings.where(F.col("node_id") == node_id).select("vector").first()
        return list(row.vector) if row else None

    def apply(self, what: str, fn, schema: str) -> DataFrame:
        """``fn`` over Arrow batches of the live ``nodes`` or ``edges`` (an iterator in, an iterator out): the visitor hook."""
        frame = {"nodes": self.live_nodes, "edges": self.live_edges}[what]
        return frame.mapInPandas(fn, schema)

    def labels(self) -> DataFrame:
        """``(kind, label, n)``: the registries of node labels and relationship types."""
        n = self.live_nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
        return n.unionByName(self.live_edges.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))
