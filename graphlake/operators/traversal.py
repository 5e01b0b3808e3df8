"""Breadth-first and weighted distances, k-hop expansion, walks and paths as frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake import errors
from graphlake.session import cut, drop_scratch, spread


def _check(nodes: DataFrame | None, source: int) -> None:
    if nodes is not None and not nodes.where(F.col("id") == source).limit(1).collect():
        raise errors.NodeNotFound(source)


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of every edge."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *cols).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def bfs(edges: DataFrame, sources: DataFrame | int, nodes: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``(id, distance, predecessor)`` of every vertex that can be reached from the sources along directed edges.

    Each round joins only the last level to the edges and writes the new one; of several discoverers the least
    id is the predecessor. ``sources`` is one id (checked against ``nodes`` if they are given) or ``(id)`` rows.
    """
    spark = edges.sparkSession
    if isinstance(sources, int):
        _check(nodes, sources)
        sources = spark.createDataFrame([(sources,)], "id bigint")
    e = edges.select("src", "dst")
    if nodes is not None:
        e = e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    raw = cut(e)
    e = cut(spread(raw, "src", "dst").distinct())
    drop_scratch(raw)
    level = cut(sources.select("id").distinct().select("id", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("predecessor")))
    levels, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = levels[0].select("id")
        for x in levels[1:]:
            seen = seen.unionByName(x.select("id"))
        found = level.select(F.col("id").alias("src")).join(spread(e, "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("predecessor"))
        level = cut(found.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("distance"), "predecessor"))
        if level.isEmpty():
            drop_scratch(level)
            break
        levels.append(level)
        if len(levels) > 12:  # long chains: fold the levels so far into one table
            out = levels[0]
            for x in levels[1:-1]:
                out = out.unionByName(x)
            folded = cut(out)
            drop_scratch(*levels[:-1])
            levels = [folded, level]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def bfs_from_each(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(start, id, distance)`` for every start of ``starts(id)`` at once: the frontier holds pairs of a start and a vertex."""
    e = cut(edges.select("src", "dst").distinct())
    level = seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = level.join(e, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        level = cut(found.join(seen, ["start", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def with_unreachable(distances: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes; those without a distance get infinity and a null predecessor."""
    out = nodes.select("id").join(distances.withColumn("distance", F.col("distance").cast("double")), "id", "left")
    return out.withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def sssp(edges: DataFrame, source: int, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, distance, predecessor)`` by least total ``weight`` from ``source``; negative or null weights are refused.

    Rounds relax the edges of the vertices that improved last, until none does; ties take the least predecessor.
    """
    _check(nodes, source)
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    raw = cut(e)
    e = cut(spread(raw, "src", "dst").groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(-1.0))).alias("weight")))
    drop_scratch(raw)
    if e.where("weight < 0 OR isnan(weight)").limit(1).collect():
        raise ValueError("negative or missing weight")
    start = e.sparkSession.createDataFrame([(source, 0.0, None)], "id bigint, distance double, predecessor bigint")
    state = front = cut(start)
    while True:
        cand = front.select(F.col("id").alias("src"), F.col("distance").alias("d")).join(spread(e, "src"), "src")
        cand = cand.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("d") + F.col("weight")).alias("distance"), F.col("src").alias("predecessor"))).alias("n"))
        old = state.select("id", F.col("distance").alias("od"), F.col("predecessor").alias("op"))
        both = cut(old.join(cand, "id", "full_outer").withColumn("better", F.coalesce(F.col("n.distance") < F.col("od"), F.col("od").isNull())))
        tie = F.coalesce((F.col("n.distance") == F.col("od")) & (F.col("n.predecessor") < F.col("op")), F.lit(False))
        state = both.select(
            "id",
            F.when(F.col("better"), F.col("n.distance")).otherwise(F.col("od")).alias("distance"),
            F.when(F.col("better") | tie, F.col("n.predecessor")).otherwise(F.col("op")).alias("predecessor"),
        )
        front = both.where("better").select("id", F.col("n.distance").alias("distance"))
        if front.isEmpty():
            return state


def shortest_path(tree: DataFrame, target: int) -> list[int] | None:
    """The ids from the source to ``target`` by predecessors in a result of :func:`bfs` or :func:`sssp`; None if it was not reached.

    One filtered lookup for each vertex of the path.
    """
    path, at = [], target
    while at is not None:
        row = tree.where(F.col("id") == at).select("predecessor").first()
        if row is None:
            return None
        path.append(at)
        at = row.predecessor
    return path[::-1]


def paths(edges: DataFrame, source: int, target: int, max_depth: int | None = None) -> DataFrame:
    """``(path, length)``: the shortest path by hops with least predecessors, as an array; no row if there is none, or none within ``max_depth``."""
    tree = bfs(edges, source, max_depth=max_depth)
    path = shortest_path(tree, target)
    return edges.sparkSession.createDataFrame([] if path is None else [(path, len(path) - 1)], "path array<bigint>, length int")


def khop(edges: DataFrame, sources: DataFrame | int, hops: int) -> DataFrame:
    """Vertices within ``hops`` steps and their least depth."""
    return bfs(edges, sources, max_depth=hops).select("id", F.col("distance").alias("depth"))


def walks(edges: DataFrame, sources: DataFrame, length: int) -> DataFrame:
    """All walks of exactly ``length`` edges from ``sources(id)``: start, end and how many there are. Vertices and edges may repeat.

    Walks that end in one vertex are counted together after every step, so the rows stay at most starts times vertices.
    """
    e = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    out = sources.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(1).cast("long").alias("n_walks"))
    for _ in range(length):
        out = out.join(e, F.col("end") == F.col("src")).groupBy("start", F.col("dst").alias("end")).agg(F.sum(F.col("n_walks") * F.col("m")).alias("n_walks"))
    return out
