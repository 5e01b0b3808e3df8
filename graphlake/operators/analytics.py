"""PageRank, communities, modularity, centrality and triangles."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut, drop_scratch, spread


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 20, tol: float = 1e-6) -> tuple[DataFrame, int, bool]:
    """``(id, rank)``, the iterations run, and whether the last change was under ``tol``.

    Ranks start at 1/N; the mass of vertices without out-edges is not spread. Out-degrees count all parallel edges, also those
    to unknown vertices; only edges between known vertices carry rank. Edges are joined to their share once and kept by source.
    """
    v = cut(nodes.select("id").distinct())
    n = v.count()
    if not n:
        return v.withColumn("rank", F.lit(0.0)), 0, True
    edges = cut(edges.select("src", "dst"))
    share = edges.groupBy("src").agg(F.count("*").alias("deg"))
    known = spread(edges, "dst").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("m"))
    w = cut(spread(known, "src", like=edges).join(share, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")))
    drop_scratch(edges)
    ranks = cut(v.withColumn("rank", F.lit(1.0 / n)))
    for i in range(1, max_iter + 1):
        got = ranks.join(spread(w, "src"), F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        nxt = ranks.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", F.col("rank").alias("old"), ((1 - damping) / n + damping * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        nxt = cut(nxt)
        drop_scratch(ranks)
        ranks = nxt
        if ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] < tol:
            return ranks.select("id", "rank"), i, True
    return ranks.select("id", "rank"), max_iter, False


def label_propagation(edges: DataFrame, max_iter: int = 10) -> DataFrame:
    """``(id, community)`` by synchronous label propagation over the simple undirected edges ``(u, v)``.

    A vertex takes the most frequent label among its neighbours and itself, ties the least; it ends when nothing changes or after ``max_iter`` rounds.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut(both.select(F.col("u").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(max_iter):
        heard = spread(both, "v").join(labels.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("id"), "community").unionByName(labels.select("id", "community"))
        votes = spread(heard, "id", like=both).groupBy("id", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct(-F.col("n"), "community")).alias("b")).select("id", F.col("b.community").alias("new"))
        nxt = cut(labels.select("id", F.col("community").alias("old")).join(best, "id").select("id", F.col("new").alias("community"), "old"))
        drop_scratch(labels)
        labels = nxt
        if labels.where("community <> old").isEmpty():
            break
    return labels.select("id", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row ``modularity`` of ``communities(id, community)`` over simple undirected ``edges(u, v)`` (Newman, 2006)."""
    c = communities.select("id", "community")
    e = edges.join(c.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(c.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    ends = e.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), (F.col("cu") == F.col("cv")).alias("same")), F.struct(F.col("cv").alias("c"), F.lit(False).alias("same")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.count("*").alias("deg"), F.count_if("x.same").alias("inner"))
    m = per.agg((F.sum("deg") / 2).alias("m"))
    q = per.crossJoin(F.broadcast(m)).agg(F.coalesce(F.sum(F.col("inner") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("modularity"))
    return q


def degree_centrality(edges: DataFrame, at_least: int = 0, top: int | None = None) -> DataFrame:
    """``(id, degree)`` over both directions, those above ``at_least``, the ``top`` greatest if asked (ties by id)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    out = ends.groupBy("id").agg(F.count("*").alias("degree")).where(F.col("degree") > at_least)
    return out.orderBy(F.desc("degree"), "id").limit(top) if top else out


def triangles(edges: DataFrame) -> DataFrame:
    """One row ``triangles``: how many the simple undirected ``edges(u, v)`` hold. Edges point from the end of lower degree to the other, so a hub has few out-edges."""
    deg = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    e = edges.join(deg.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    e = cut(e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b")))
    wedge = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c").select(F.col("b"), F.col("c"))
    close = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return wedge.join(close, ["b", "c"]).agg(F.count("*").alias("triangles"))


#: Vertices of one colour: the bits of a task's rows take at most three times COLOUR ** 2 / 8 bytes.
COLOUR = 8192


def _common(rows: list[np.ndarray], cols: list[np.ndarray], at: np.ndarray, words: int, groups: int) -> np.ndarray:
    """One row of bits for each of ``rows`` (group numbers): those columns, at bit ``at``, that share a group with it."""
    out = np.zeros((len(rows), words), np.uint64)
    lens = np.array([len(r) for r in rows])
    g_row, g_col, col = np.concatenate(rows), np.concatenate(cols), np.repeat(at, [len(c) for c in cols])
    x_row = np.repeat(np.arange(len(rows)), lens)
    for low in range(0, groups, 1 << 15):
        n = min(groups - low, 1 << 15)
        bits = np.zeros(n * words, np.uint64)
        ok = (g_col >= low) & (g_col < low + n)
        np.bitwise_or.at(bits, (g_col[ok] - low) * words + (col[ok] >> 6), np.uint64(1) << (col[ok] & 63).astype(np.uint64))
        bits = bits.reshape(n, words)
        ok = (g_row >= low) & (g_row < low + n)
        g, x = g_row[ok] - low, x_row[ok]
        for i in range(0, len(g), 1 << 14):
            starts = np.flatnonzero(np.r_[True, np.diff(x[i : i + (1 << 14)]) > 0])
            out[x[i : i + (1 << 14)][starts]] |= np.bitwise_or.reduceat(bits[g[i : i + (1 << 14)]], starts, axis=0)
    return out


def _count_colours(table: pa.Table) -> pa.Table:
    """The triangles of three vertices, and for ``j = k`` of two, whose classes have the colours ``i <= j <= k``."""
    i, j, k = (table.column(c)[0].as_py() for c in "ijk")
    table = table.sort_by([("n", "ascending"), ("class", "ascending")])
    colour, n = table.column("colour").to_numpy(), table.column("n").to_numpy()
    flat = table.column("s").combine_chunks()
    numbers, sets = np.unique(flat.flatten().to_numpy(), return_inverse=True)
    sets = np.array_split(sets, np.cumsum(flat.value_lengths().to_numpy())[:-1])
    of = {c: np.flatnonzero(colour == c) for c in {i, j, k}}
    total = 0
    if all(len(v) for v in of.values()):
        have = {c: [sets[v] for v in of[c]] for c in of}
        # equal weights stand side by side, each run of them from a new word
        starts = np.flatnonzero(np.r_[True, np.diff(n[of[k]]) > 0])
        runs = np.diff(np.r_[starts, len(of[k])])
        first = np.r_[0, np.cumsum(-(-runs // 64))]
        at = np.concatenate([f * 64 + np.arange(r) for f, r in zip(first, runs, strict=False)])
        weight = np.repeat(n[of[k]][starts], -(-runs // 64))
        bits = {c: _common(have[c], have[k], at, first[-1], len(numbers)) for c in {i, j}}
        plain = np.arange(len(of[j]))
        edges = bits[i] if j == k else _common(have[i], have[j], plain, -(-len(plain) // 64), len(numbers))
        where = at if j == k else plain
        for c in {i, j} & {k}:
            bits[c][np.arange(len(at)), at >> 6] &= ~(np.uint64(1) << (at & 63).astype(np.uint64))
        nj = n[of[j]]
        for x in range(len(of[i])):
            near = np.unpackbits(edges[x].view(np.uint8), bitorder="little")[where].astype(bool)
            if i == j:
                near[: x + 1] = False
            near = np.flatnonzero(near)
            if not len(near):
                continue
            nx, ny = int(n[of[i][x]]), nj[near]
            if j == k:
                total += 6 * sum(nx * int(w) * (nx + int(w) - 2) // 2 * int(m) for w, m in zip(*np.unique(ny, return_counts=True), strict=True))
            runs_y = np.flatnonzero(np.r_[True, np.diff(ny) > 0])
            both = np.bitwise_count(bits[j][near] & bits[i][x])
            found = np.add.reduceat(both, runs_y, axis=0, dtype=np.uint32).astype(np.int64) @ weight
            total += nx * int(found @ ny[runs_y]) * (2 if i == j == k else 3 if j == k else 6)
    return pa.table({"six": pa.array([Decimal(total)], pa.decimal128(38, 0))})


def clique_triangles(members: DataFrame) -> DataFrame:
    """One row ``triangles`` of the graph in which two ids are linked if ``members(id, group)`` has them in a common group.

    No edge is written. Ids with the same groups are one class with a count. Classes have colours of about COLOUR classes; each
    three colours are a task, which gets the groups of their classes and counts by rows of bits, in bounded memory.
    """
    m = members.dropna().distinct()
    groups = cut(m.select("group").distinct().withColumn("g", F.monotonically_increasing_id()))
    sets = m.join(groups, "group").groupBy("id").agg(F.sort_array(F.collect_list("g")).alias("s"))
    classes = cut(sets.groupBy("s").agg(F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()))
    p = max(1, -(-classes.count() // COLOUR))
    own = classes.agg(F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)") * (F.col("n") - 2).cast("decimal(18,0)")).cast("decimal(38,0)").alias("six"))
    some = classes.withColumn("colour", F.pmod(F.xxhash64("class"), F.lit(p)).cast("int"))
    some = some.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("y", F.explode(F.sequence("x", F.lit(p - 1))))
    some = some.withColumn("t", F.array_sort(F.array("colour", "x", "y"))).select("class", "n", "s", "colour", *[F.col("t")[q].alias(c) for q, c in enumerate("ijk")])
    tasks = p * (p + 1) * (p + 2) // 6
    found = some.repartition(tasks, "i", "j", "k").groupBy("i", "j", "k").applyInArrow(_count_colours, "six decimal(38,0)")
    return found.unionByName(own).agg((F.coalesce(F.sum("six"), F.lit(0)) / 6).cast("long").alias("triangles"))


def communities_by_size(labels: DataFrame) -> DataFrame:
    """``(community, size, rank)``, the largest first, ties by label."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community")))
