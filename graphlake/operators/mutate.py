"""Mutations as an append-only change log, its replay, and checked inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake import errors
from graphlake.graph import Graph


def split_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``error``: InvalidId for ids that are null or not positive, DuplicateNode for ids that exist or came earlier (by ``seq``, if there is one)."""
    order = "seq" if "seq" in new.columns else "id"
    have = existing.select("id").distinct().withColumn("_have", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order))
    bad_id = F.col("id").isNull() | (F.col("id") <= 0)
    out = new.withColumn("_rank", rank).join(have, "id", "left")
    return out.withColumn("error", F.when(bad_id, "InvalidId").when(F.col("_have").isNotNull() | (F.col("_rank") > 1), "DuplicateNode")).drop("_rank", "_have")


def split_edges(nodes: DataFrame, new: DataFrame, allow_loops: bool = False) -> DataFrame:
    """``new`` with ``error``: SelfLoop (unless allowed), NodeNotFound if an endpoint is not in ``nodes``. Parallel edges are fine."""
    ids = nodes.select("id").distinct()
    out = new.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    loop = (F.col("src") == F.col("dst")) & F.lit(not allow_loops)
    return out.withColumn("error", F.when(F.col("_s").isNull() | F.col("_d").isNull(), "NodeNotFound").when(loop, "SelfLoop")).drop("_s", "_d")


def insert_nodes(graph: Graph, new: DataFrame, strict: bool = True) -> Graph:
    """A graph with the valid new nodes; ``strict`` raises for the first that is not."""
    checked = split_nodes(graph.live_nodes, new)
    if strict:
        bad = checked.where("error IS NOT NULL").limit(1).collect()
        if bad:
            raise errors.DuplicateNode(bad[0].id) if bad[0].error == "DuplicateNode" else errors.GraphError(bad[0].error)
    return Graph(graph.nodes.unionByName(checked.where("error IS NULL").drop("error"), allowMissingColumns=True), graph.edges, graph.embeddings)


def insert_edges(graph: Graph, new: DataFrame, strict: bool = True, allow_loops: bool = False) -> Graph:
    checked = split_edges(graph.live_nodes, new, allow_loops)
    if strict:
        bad = checked.where("error IS NOT NULL").limit(1).collect()
        if bad:
            raise (errors.NodeNotFound if bad[0].error == "NodeNotFound" else errors.InvalidEdge)(f"{bad[0].src}->{bad[0].dst}")
    return Graph(graph.nodes, graph.edges.unionByName(checked.where("error IS NULL").drop("error"), allowMissingColumns=True), graph.embeddings)


def update_property(df: DataFrame, node_id: int, name: str, value: object) -> DataFrame:
    """``df`` with one property of one node replaced. The property must be there; an unknown id raises."""
    if name not in df.columns:
        raise errors.PropertyNotFound(name)
    if df.where(F.col("id") == node_id).isEmpty():
        raise errors.NodeNotFound(node_id)
    return df.withColumn(name, F.when(F.col("id") == node_id, F.lit(value).cast(df.schema[name].dataType)).otherwise(F.col(name)))


def update_where(df: DataFrame, ids: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with ``name`` replaced by column ``value`` of the row of ``ids(id, value)`` with the same id, where there is one."""
    return df.join(ids.select("id", F.col(value).alias("_new"), F.lit(True).alias("_hit")), "id", "left").withColumn(name, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(name))).drop("_new", "_hit")


def log_entry(df: DataFrame, entry: str, lsn: str, key: str) -> DataFrame:
    """Change-log rows ``(lsn, entry_type, key, payload, crc)`` of ``df``; the payload is the row as JSON and ``crc`` its CRC-32."""
    payload = F.to_json(F.struct(*[c for c in df.columns if c != lsn]))
    return df.select(F.col(lsn).alias("lsn"), F.lit(entry).alias("entry_type"), F.col(key).alias("key"), payload.alias("payload")).withColumn("crc", F.crc32("payload"))


def intact(log: DataFrame) -> DataFrame:
    """Rows whose checksum fits."""
    return log.where(F.crc32("payload") == F.col("crc"))


def replay(log: DataFrame, key: str = "key", lsn: str = "lsn", entry: str = "entry_type", tombstone: str = "delete") -> DataFrame:
    """The state after all changes: the latest row of every key (by lsn), unless it deletes. One partial aggregate, no sort."""
    rest = [c for c in log.columns if c not in (key, lsn)]
    last = log.groupBy(key).agg(F.max(F.struct(lsn, *rest)).alias("r"))
    return last.select(key, "r.*").where(F.col(entry) != tombstone)


def publish(df: DataFrame, path: str, version: int) -> str:
    """Write a snapshot as a new version beside the earlier ones: readers of those are not disturbed."""
    target = f"{path}/version={version:012d}"
    df.write.mode("errorifexists").parquet(target)
    return target
