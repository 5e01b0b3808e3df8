"""JSON and matrix exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visualizer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``json``: ``{nodes, edges, metadata}`` in order of ids. It is one document by nature: for a graph that fits a page."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("nodes"), F.count("*").alias("node_count"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "label"))).alias("edges"), F.count("*").alias("edge_count"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges", F.struct("node_count", "edge_count").alias("metadata"))).alias("json"))


def node_documents(nodes: DataFrame) -> DataFrame:
    """One JSON document a node."""
    return nodes.select("id", F.to_json(F.struct(*nodes.columns)).alias("json"))


def coo(edges: DataFrame) -> DataFrame:
    """The adjacency matrix in coordinate form: parallel edges are summed up. ``(row, col, value)``."""
    return edges.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.count("*").cast("double").alias("value"))


def chain_documents(nodes: DataFrame, edges: DataFrame) -> dict:
    """``{nodes, relationships}`` for a small graph."""
    return {"nodes": [r.asDict() for r in nodes.collect()], "relationships": [{"source": r.src, "target": r.dst, "type": r.label} for r in edges.select("src", "dst", "label").collect()]}
