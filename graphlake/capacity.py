"""Capacity planning and growth trends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_BYTES, EDGE_BYTES, PROPERTY_BYTES = 78, 87, 64
GROWTH = {"linear": 1.2, "exponential": 2.0, "cyclical": 1.5, "stable": 1.1, "unpredictable": 2.5}
#: For kinds of work: properties per node beyond one, in tenths, and the share of nodes that have an embedding.
WORKLOADS = {"social_network": (1, 0.1), "knowledge_graph": (8, 0.3), "recommendation": (3, 0.8), "ai_training": (2, 1.0), "real_time_analytics": (1, 0.2), "batch_processing": (5, 0.1)}
#: Nodes, edges, kind of work and dimension of usual sizes.
PRESETS = {
    f"{kind}_{size}": (nodes, edges, kind, dim)
    for kind, dim, small, large in (("social_network", 128, (100_000, 500_000), (1_000_000, 10_000_000)), ("knowledge_graph", 256, (50_000, 500_000), (500_000, 5_000_000)), ("ai_training", 768, (100_000, 1_000_000), (1_000_000, 10_000_000)), ("recommendation", 512, (200_000, 2_000_000), (2_000_000, 20_000_000)))
    for size, (nodes, edges) in (("small", small), ("large", large))
}


def pool_size(expected: int, headroom: float = 2.0, safety: float = 1.5) -> int:
    """The power of two that holds ``expected`` with headroom and safety."""
    need = math.ceil(expected * headroom * safety)
    return 1 << (need - 1).bit_length() if need > 1 else 1


def plan(expected_nodes: int, expected_edges: int, workload: str = "knowledge_graph", dim: int = 128) -> dict:
    """Pool sizes and bytes for numbers of nodes and edges and a kind of work."""
    properties, share = WORKLOADS[workload]
    pools = {"nodes": pool_size(expected_nodes), "edges": pool_size(expected_edges), "embeddings": pool_size(math.floor(round(expected_nodes * share, 6))), "properties": pool_size(expected_nodes * (1 + properties))}
    pools["bytes"] = pools["nodes"] * NODE_BYTES + pools["edges"] * EDGE_BYTES + pools["embeddings"] * (dim * 4 + 9) + pools["properties"] * PROPERTY_BYTES
    return pools


def plans(sizes: DataFrame) -> DataFrame:
    """``sizes(nodes, edges)`` with the pools of every kind of work: ``(nodes, edges, workload, node_pool, edge_pool, embedding_pool, property_pool)``."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("workload"), F.lit(p).alias("p"), F.lit(s).alias("s")) for k, (p, s) in WORKLOADS.items()]))
    d = sizes.select("nodes", "edges", kinds.alias("x"))

    def pool(n: Column) -> Column:
        need = (n * 3).cast("long")
        return F.when(need <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double"))))).cast("long")

    with_vector = F.floor(F.round(F.col("nodes") * F.col("x.s"), 6))
    return d.select("nodes", "edges", "x.workload", pool(F.col("nodes")).alias("node_pool"), pool(F.col("edges")).alias("edge_pool"), pool(with_vector).alias("embedding_pool"), pool(F.col("nodes") * (F.col("x.p") + 1)).alias("property_pool"))


def pool_sizes(counts: DataFrame, column: str = "n") -> DataFrame:
    """``counts`` with ``pool``: :func:`pool_size` of a count column."""
    need = F.ceil(F.col(column) * F.lit(3.0))
    return counts.withColumn("pool", F.when(need <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(need.cast("double"))))).cast("long"))


def trend(log: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Linear fit of ``y`` on ``x`` by group with its R², the coefficient of variation, and the pattern they suggest, with its growth factor."""
    fit = log.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        (F.stddev_pop(y) / F.avg(y)).alias("cv"),
        F.regr_r2(F.ln(F.when(F.col(y) > 0, F.col(y))), F.col(x)).alias("log_r2"),
    )
    pattern = F.when(F.col("cv") < 0.1, "stable").when(F.col("r2") >= 0.8, "linear").when(F.col("log_r2") >= 0.8, "exponential").otherwise("unpredictable")
    growth = F.create_map(*[F.lit(v) for kv in GROWTH.items() for v in kv])
    return fit.withColumn("pattern", pattern).withColumn("growth", growth[F.col("pattern")])


def autocorrelation(log: DataFrame, order: str, y: str, group: list[str], lag: int) -> DataFrame:
    """The correlation of ``y`` with itself ``lag`` steps before, by group: near 1 for cycles of that length."""
    w = Window.partitionBy(*group).orderBy(order)
    return log.withColumn("_before", F.lag(y, lag).over(w)).groupBy(*group).agg(F.corr(y, "_before").alias("autocorrelation"))
