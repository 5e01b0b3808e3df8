"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut, drop_scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges``; the component is its smallest id.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until the edge set is a forest
    of stars. Each round shuffles only the edges that are left, at most as many as came in, and
    hooks every vertex to a smaller one, so long chains need about log2 of their length in rounds; they go on until none changes an edge. Loops
    and null endpoints are dropped; an isolated vertex is the caller's to add (a left join).
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u <> v").distinct()
        nxt = cut(small)
        drop_scratch(e)
        e = nxt
        row = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
