"""Approximate nearest neighbours by robust-pruned directed graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.session import cut

K, DEGREE, BEAM, SEARCH_BEAM, ALPHA = 10, 32, 48, 48, 1.2
SHARD_ROWS, QUERY_ROWS, BLOCK, WIDE = 8192, 8192, 512, 4


class Graph:
    """A directed graph over the vectors ``x``: row i of ``out`` has the neighbours of i, -1 where there are fewer than DEGREE."""

    def __init__(self, x: np.ndarray, out: np.ndarray, start: int):
        self.x, self.out, self.start = x, out, start
        self.norm = (x * x).sum(axis=1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy beam search of all queries in step: ids and squared distances of the beam, nearest first, and what was seen (query, vertex).

        Every step expands the WIDE nearest vertices of each beam that are not expanded yet.
        """
        n, m = len(self.x), len(q)
        rows = np.arange(m)[:, None]
        qn = (q * q).sum(axis=1)
        ids, dist = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32)
        done = np.zeros((m, beam), bool)
        seen = np.zeros((m, n + 1), bool)
        ids[:, 0] = self.start
        dist[:, 0] = ((q - self.x[self.start]) ** 2).sum(axis=1)
        seen[:, self.start] = seen[:, n] = True
        while True:
            open_ = np.where(done | (ids < 0), np.inf, dist)
            wide = min(WIDE, beam)
            at = np.argpartition(open_, wide - 1, axis=1)[:, :wide] if beam > wide else np.argsort(open_, axis=1)
            live = np.isfinite(np.take_along_axis(open_, at, axis=1))
            act = np.flatnonzero(live.any(axis=1))
            if not len(act):
                break
            at, live = at[act], live[act]
            done[act[:, None], at] |= live
            nb = np.where(live[:, :, None], self.out[np.where(live, ids[act[:, None], at], 0)], -1).reshape(len(act), -1)
            nb = np.where(nb < 0, n, nb)
            nb = np.sort(nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = n
            nb = np.where(seen[act[:, None], nb], n, nb)
            seen[act[:, None], nb] = True
            real = nb < n
            safe = np.where(real, nb, 0)
            d = np.full(nb.shape, np.inf, np.float32)
            d = np.where(real, np.maximum(self.norm[safe] + qn[act][:, None] - 2 * np.matmul(self.x[safe], q[act][:, :, None])[:, :, 0], 0), np.inf).astype(np.float32)
            all_d = np.concatenate((dist[act], d), axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[act] = np.take_along_axis(np.concatenate((ids[act], np.where(real, nb, -1)), axis=1), best, axis=1)
            dist[act] = np.take_along_axis(all_d, best, axis=1)
            done[act] = np.take_along_axis(np.concatenate((done[act], ~real), axis=1), best, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[rows, order], dist[rows, order], seen[:, :n]


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours for the vertices ``p`` out of ``cand`` (row of ids, -1 for none): the nearest candidate stays and
    drops all that are ``alpha`` times nearer to it than to the vertex, and so on."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand = np.where(cand == p[:, None], -1, cand)
    y = x[np.maximum(cand, 0)]
    d = ((y - x[p][:, None]) ** 2).sum(axis=2)
    d[cand < 0] = np.inf
    norm = (y * y).sum(axis=2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1))
    out = np.full((len(p), degree), -1, np.int64)
    rows = np.arange(len(p))
    for k in range(degree):
        at = np.argmin(d, axis=1)
        some = np.isfinite(d[rows, at])
        if not some.any():
            break
        out[some, k] = cand[rows, at][some]
        drop = alpha * alpha * between[rows, at] <= d
        d[drop & some[:, None]] = np.inf
        d[rows, at] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 1) -> Graph:
    """A graph from a random one by two passes: greedy searches propose neighbours, pruning keeps diverse ones, edges go both ways; the second pass relaxes by ALPHA."""
    n, rng = len(x), np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    out = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    g = Graph(x, out, start)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for i in range(0, n if n > 1 else 0, BLOCK):
            p = order[i : i + BLOCK]
            ids, _, _ = g.search(x[p], beam)
            new = robust_prune(x, p, np.concatenate((ids, g.out[p]), axis=1), degree, alpha)
            g.out[p] = new
            src, dst = np.repeat(p, degree), new.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            first = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
            rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
            for lo in range(0, int(rank.max()) + 1 if len(rank) else 0, 64):
                part = (rank >= lo) & (rank < lo + 64)
                to = np.unique(dst[part])
                back = np.full((len(to), 64), -1, np.int64)
                back[np.searchsorted(to, dst[part]), rank[part] - lo] = src[part]
                for j in range(0, len(to), 4 * BLOCK):
                    t = to[j : j + 4 * BLOCK]
                    g.out[t] = robust_prune(x, t, np.concatenate((g.out[t], back[j : j + 4 * BLOCK]), axis=1), degree, alpha)
    return g


_GRAPH_SQL = "shard int, part int, ids array<bigint>, x binary, out binary, start int"


def _vectors(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _build(dim: int, degree: int, beam: int):
    def run(batches):
        shard, ids, x = [], [], []
        for b in batches:
            if b.num_rows:
                shard.append(b.column("shard").to_numpy())
                ids.append(b.column("vec_id").to_numpy())
                x.append(_vectors(b.column("embedding"), dim))
        if not ids:
            return
        shard, ids, x = np.concatenate(shard), np.concatenate(ids), np.concatenate(x)
        for s in np.unique(shard):
            own, v = ids[shard == s], x[shard == s]
            order = np.lexsort((*v.T[::-1], own))
            own, v = own[order], v[order]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            own, v = own[first], np.ascontiguousarray(v[first])
            g = build(v, degree, beam, int(s) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([0], pa.int32()), pa.array([own], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([g.out.astype(np.int32).tobytes()], pa.binary()), pa.array([g.start], pa.int32())],
                names=["shard", "part", "ids", "x", "out", "start"],
            )

    return run


_FOUND = pa.schema([("vec_id", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))])


def _search(dim: int, k: int, beam: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        g = right.to_batches()[0]
        own = g.column("ids")[0].values.to_numpy()
        x = np.frombuffer(g.column("x")[0].as_py(), np.float32).reshape(-1, dim)
        graph = Graph(x, np.frombuffer(g.column("out")[0].as_py(), np.int32).reshape(len(own), -1).astype(np.int64), g.column("start")[0].as_py())
        ids, q = left.column("vec_id").to_numpy(), _vectors(left.column("embedding"), dim)
        width = min(max(beam, k + 1), len(own))
        near_id, near_d = [], []
        for i in range(0, len(q), BLOCK):
            at, d, _ = graph.search(q[i : i + BLOCK], width)
            names = own[np.maximum(at, 0)]
            bad = (at < 0) | (names == ids[i : i + BLOCK, None])
            order = np.argsort(bad, axis=1, kind="stable")[:, :k]
            exact = np.sqrt(((q[i : i + BLOCK, None].astype(np.float64) - x[np.take_along_axis(np.maximum(at, 0), order, axis=1)]) ** 2).sum(axis=2))
            near_id.append(np.where(np.take_along_axis(bad, order, axis=1), -(2**63), np.take_along_axis(names, order, axis=1)))
            near_d.append(exact)
        near_id, near_d = np.concatenate(near_id), np.concatenate(near_d)
        good = near_id != -(2**63)
        flat = pa.StructArray.from_arrays([pa.array(near_d[good]), pa.array(near_id[good])], names=["d", "id"])
        offs = np.concatenate(([0], np.cumsum(good.sum(axis=1)))).astype(np.int32)
        return pa.table([pa.array(ids), pa.ListArray.from_arrays(pa.array(offs), flat)], schema=_FOUND)

    return run


def shard_count(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of ``shard_rows`` vectors on average at most: the size up to which recall is measured."""
    return -(-n // shard_rows)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` as 64-bit ids and 32-bit floats, without null ids, null or empty vectors and vectors with an element that is null or not finite as a float."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    inf = F.lit(float("inf")).cast("float")
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == inf))
    return v.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(~bad)


def neighbours(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = K,
    degree: int = DEGREE,
    beam: int = BEAM,
    search_beam: int = SEARCH_BEAM,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` nearest other vectors of ``vectors(vec_id, embedding)`` for every row of ``queries`` (by default: for every vector):
    ``(vec_id, rank, neighbour_id, distance)``, Euclidean.

    All vectors are indexed. They are spread by hash over shards of ``shard_rows`` on average at most, whatever the table's size and the cluster: degree
    and beams are fixed, and the recall they give falls in larger graphs. Each shard's graph (Vamana, Subramanya et al., 2019) is built in one
    task. Every query visits every shard: tasks are pairs of a shard and a part of the queries, a beam search of width ``search_beam`` finds a
    shard's best, and the best of all shards are merged by distance, ties by id. Building is linear in the vectors; searching takes
    queries times shards.

    Null ids, null or empty vectors, vectors with elements that are null, NaN or infinite (also doubles beyond the range of a float) and those of another
    length than the most frequent one (ties: the longer) are left out, as queries too. Rows of one vec_id count as one (the least vector by elements), and so do
    rows of one query; a query's own vec_id is not among its neighbours. Equal vectors under different ids are neighbours at distance 0.
    With fewer than ``k`` others there are fewer rows. Very long vectors are like others: a task holds one shard. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id bigint, rank int, neighbour_id bigint, distance double"
    v = usable(vectors)
    sizes = sorted(((r["count"], r.n) for r in v.groupBy(F.size("embedding").alias("n")).count().collect()), reverse=True)
    if not sizes:
        return spark.createDataFrame([], schema)
    n, dim = sizes[0]
    shards = shard_count(n, shard_rows)
    q = v if queries is None else usable(queries)
    q = q.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    v = v.where(F.size("embedding") == dim).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = cut(v.repartitionById(shards, v["shard"]).select("shard", "vec_id", "embedding").mapInArrow(_build(dim, degree, beam), _GRAPH_SQL))
    q = cut(q)
    parts = max(1, -(-q.count() // query_rows))
    q = q.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    g = graphs.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = shards * parts
    found = (
        q.repartition(pairs, "shard", "part").groupBy("shard", "part").cogroup(g.repartition(pairs, "shard", "part").groupBy("shard", "part")).applyInArrow(_search(dim, k, search_beam), "vec_id bigint, near array<struct<d: double, id: bigint>>")
    )
    near = found.select("vec_id", F.explode("near").alias("x")).select("vec_id", "x.d", "x.id")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "id"))  # limited to k before the shuffle, too
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", F.col("id").alias("neighbour_id"), F.round("d", 6).alias("distance"))


def op7_nearest_neighbours(spark, sf_dir):
    """Ten nearest neighbours, among all vectors of the embeddings table, of every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.where("vec_id % 50 = 0"))
