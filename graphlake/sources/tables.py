"""The star-schema tables as a property graph. A node's id is ``key * 8 + kind``: positive, unique, and it tells the kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.graph import Graph
from graphlake.session import spread

KINDS = {"Customer": 1, "Part": 2, "Supplier": 3, "Nation": 4, "Region": 5, "Order": 6, "User": 7}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(key: str, label: str) -> Column:
    return F.col(key).cast("long") * 8 + KINDS[label]


def nodes(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """``(id, label, name, amount)`` of the labels asked for (all but User by default): only their tables are read."""
    spec = {
        "Customer": ("customer", "c_custkey", "c_name", "c_acctbal"),
        "Part": ("part", "p_partkey", "p_name", "p_retailprice"),
        "Supplier": ("supplier", "s_suppkey", "s_name", "s_acctbal"),
        "Nation": ("nation", "n_nationkey", "n_name", None),
        "Region": ("region", "r_regionkey", "r_name", None),
        "Order": ("orders", "o_orderkey", "o_orderpriority", "o_totalprice"),
    }
    out = None
    for label in labels or tuple(spec):
        t, key, name, amount = spec[label]
        one = table(spark, sf_dir, t).select(node_id(key, label).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), (F.col(amount) if amount else F.lit(None)).cast("double").alias("amount"))
        out = one if out is None else out.unionByName(one)
    return out


def _purchased(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The quantity of each part that each customer bought; tasks follow the size of ``lines`` in both shuffles."""
    by = lambda df, *keys: spread(df, *keys, like=lines, bytes_each=4 << 20)
    o = by(orders.select("o_orderkey", node_id("o_custkey", "Customer").alias("src")), "o_orderkey")
    x = by(lines.select("l_orderkey", node_id("l_partkey", "Part").alias("dst"), "l_quantity"), "l_orderkey")
    both = o.join(x, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst", "l_quantity")
    return by(both, "src", "dst").groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))


def edges(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """``(src, dst, label, weight)`` of the relationship types asked for (all by default)."""
    t = lambda name: table(spark, sf_dir, name)
    make = {
        "PURCHASED": lambda: _purchased(t("orders"), t("lineitem")),
        "PLACED": lambda: t("orders").select(node_id("o_custkey", "Customer").alias("src"), node_id("o_orderkey", "Order").alias("dst"), F.col("o_totalprice").alias("weight")),
        "CONTAINS": lambda: t("lineitem").select(node_id("l_orderkey", "Order").alias("src"), node_id("l_partkey", "Part").alias("dst"), F.col("l_quantity").alias("weight")),
        "SUPPLIED_BY": lambda: spread(t("lineitem").select(node_id("l_partkey", "Part").alias("src"), node_id("l_suppkey", "Supplier").alias("dst")), "src", "dst", like=t("lineitem"), bytes_each=4 << 20).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")),
        "LOCATED_IN": lambda: t("customer").select(node_id("c_custkey", "Customer").alias("src"), node_id("c_nationkey", "Nation").alias("dst"), F.lit(1.0).alias("weight")).unionByName(t("supplier").select(node_id("s_suppkey", "Supplier").alias("src"), node_id("s_nationkey", "Nation").alias("dst"), F.lit(1.0).alias("weight"))),
        "IN_REGION": lambda: t("nation").select(node_id("n_nationkey", "Nation").alias("src"), node_id("n_regionkey", "Region").alias("dst"), F.lit(1.0).alias("weight")),
    }
    out = None
    for label in labels or tuple(make):
        one = make[label]().withColumn("label", F.lit(label)).select("src", "dst", "label", "weight")
        out = one if out is None else out.unionByName(one)
    return out


def graph(spark: SparkSession, sf_dir: str, node_labels: tuple[str, ...] = (), edge_labels: tuple[str, ...] = ()) -> Graph:
    simple = bool(edge_labels) and "CONTAINS" not in edge_labels  # an order may hold equal lines
    return Graph(nodes(spark, sf_dir, *node_labels), edges(spark, sf_dir, *edge_labels), simple=simple)
