"""Graph neural network layers over ``features(id, vector)`` and ``edges(src, dst)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions import vectors as V


def _gather(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """Sum ``value`` by key and place; vectors come together again in order of place."""
    per = rows.groupBy(*key, "pos").agg(F.sum(value).alias("x"))
    return per.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def message_passing(features: DataFrame, edges: DataFrame) -> DataFrame:
    """The mean of the vectors of the in-neighbours (parallel edges count); vertices without any keep their own. ``(id, vector)``."""
    f = features.select("id", F.col("vector").cast("array<double>").alias("vector"))
    sent = edges.join(f.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.posexplode("vector").alias("pos", "v"))
    per = sent.groupBy("id", "pos").agg(F.avg("v").alias("x"))
    got = per.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("new"))
    return f.join(got, "id", "left").select("id", F.coalesce("new", "vector").alias("vector"))


def graph_convolution(features: DataFrame, edges: DataFrame, weights: list[list[float]] | None = None) -> DataFrame:
    """One layer ``D^-1/2 (A + I) D^-1/2 H W`` on simple undirected ``edges(u, v)``; without ``weights`` W is the identity."""
    f = features.select("id", F.col("vector").cast("array<double>").alias("vector"))
    both = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    both = both.unionByName(f.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    deg = both.groupBy("src").agg(F.count("*").alias("d"))
    a = both.join(deg.withColumnRenamed("d", "ds"), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    msgs = a.join(f.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("c"), F.posexplode("vector").alias("pos", "v"))
    out = _gather(msgs, ["id"], F.col("c") * F.col("v"))
    if weights is None:
        return out
    columns = [F.array(*[F.lit(float(x)) for x in col]) for col in zip(*weights, strict=True)]
    return out.select("id", F.array(*[V.dot("vector", c) for c in columns]).alias("vector"))


def attention(features: DataFrame, edges: DataFrame) -> DataFrame:
    """For every vertex with out-edges, ``softmax(q . k / sqrt(d)) V`` over the vertices it points to; q, k and v are the vectors themselves."""
    f = features.select("id", F.col("vector").cast("array<double>").alias("vector"))
    e = edges.select("src", "dst").distinct()
    e = e.join(f.select(F.col("id").alias("src"), F.col("vector").alias("q")), "src").join(f.select(F.col("id").alias("dst"), F.col("vector").alias("k")), "dst")
    e = e.withColumn("s", V.dot("q", "k") / F.sqrt(F.size("q").cast("double")))
    top = e.groupBy("src").agg(F.max("s").alias("top"))
    e = e.join(top, "src").withColumn("w", F.exp(F.col("s") - F.col("top")))
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    rows = e.join(total, "src").select(F.col("src").alias("id"), (F.col("w") / F.col("total")).alias("a"), F.posexplode("k").alias("pos", "v"))
    return _gather(rows, ["id"], F.col("a") * F.col("v"))
