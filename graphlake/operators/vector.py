"""Exact and bucketed vector search."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake import errors
from graphlake.functions import vectors as V
from graphlake.session import cut


def topk(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``(id, similarity, distance)`` of the ``k`` most similar vectors, ties by id. Vectors of another length than the query are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where(F.size(vec_col) == len(query))
    out = v.select(F.col(id_col).alias("id"), V.similarity(metric, vec_col, q).alias("similarity"), V.distance(metric, vec_col, q).alias("distance"))
    return out.orderBy(F.desc("similarity"), "id").limit(k)


#: Vectors and bytes of one block at most, about: a task holds two blocks and a strip of their products, whatever the table.
RANGE, BLOCK_BYTES = 16384, 16 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0), in double precision."""
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n == 0, 1, n)[:, None]


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, least: int) -> DataFrame:
    """``(block, ids, x)``: vectors packed row by row, written once to the shared folder; at least ``least`` blocks, for as many tasks."""
    kind = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    some = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    size = some.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    rows = max(1, min(RANGE, BLOCK_BYTES // (8 * max(1, size.width))))

    def run(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if batches:
            t = pa.Table.from_batches(batches)
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids = pa.array([t.column("i").to_numpy()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), ids, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "x"])

    return cut(some.repartition(max(least, -(-size.n // rows))).mapInArrow(run, "block bigint, ids array<bigint>, x binary")), np.float32 if kind == "float" else np.float64


def _pairs(left: DataFrame, right: DataFrame | None, id_col: str, vec_col: str, score, schema: str, fold=None) -> DataFrame:
    """``score(ids, x, ids, y, same)`` of every block of ``left`` against every one of ``right``; without ``right``, each two blocks of ``left`` meet once.

    Blocks are written once and each task reads the files of those that it compares, so no copies of them are shuffled. ``fold`` makes one
    table of what a task has found for a block of ``left``.
    """
    half = right is None
    (a, kind_a) = (b, kind_b) = _blocks(left, id_col, vec_col, 4 if half else 1)
    if not half:
        b, kind_b = _blocks(right, id_col, vec_col, 4)
    a, b = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, df in (("a", a), ("b", b)))

    def run(batches):
        at, x, held = None, None, []
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r]
                blocks, ids = [get(f"{s}_block").as_py() for s in "ab"], [get(f"{s}_ids").values.to_numpy() for s in "ab"]
                unpacked = lambda s, i, kind: _unit(np.frombuffer(get(f"{s}_x").as_buffer(), kind).reshape(len(i), -1))  # noqa: B023, E731
                if blocks[0] != at:
                    yield from held
                    at, x, held = blocks[0], unpacked("a", ids[0], kind_a), []
                same = half and blocks[0] == blocks[1]
                out = score(ids[0], x, ids[1], x if same else unpacked("b", ids[1], kind_b), same)
                if fold is None:
                    yield from out.to_batches()
                else:
                    held = fold(pa.concat_tables([pa.Table.from_batches(held), out]) if held else out).combine_chunks().to_batches()
        yield from held

    meet = F.col("a_block") <= F.col("b_block") if half else F.lit(True)
    return a.hint("shuffle_replicate_nl").join(b, meet).mapInArrow(run, schema)


def knn_join(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """For every vector of ``queries`` (all by default) its ``k`` most similar others by cosine: ``(id, rank, other, similarity)``, exact, ties by id.

    Blocks of vectors meet in matrix products; each task sends on at most ``k`` rows a query, which are merged per query.
    """

    def best(t: pa.Table) -> pa.Table:
        i, o, s = (t.column(c).to_numpy() for c in ("id", "other", "similarity"))
        by = np.lexsort((o, -s, i))
        i = i[by]
        return t.take(by[np.arange(len(i)) - np.searchsorted(i, i) < k])

    def score(ia, x, ib, y, _):
        order = np.argsort(ib, kind="stable")
        ib, y = ib[order], y[order]
        found = []
        for i in range(0, len(ia), 256):
            s = np.round(x[i : i + 256] @ y.T, 12)
            s[ia[i : i + 256, None] == ib[None, :]] = -np.inf
            n = min(k, len(ib))
            least = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            p, q = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            by = np.lexsort((q, -s[p, q], p))
            p, q = p[by], q[by]
            rank = np.arange(len(p)) - np.searchsorted(p, p)
            p, q = p[rank < k], q[rank < k]
            found.append((ia[i + p], ib[q], s[p, q]))
        return pa.table(dict(zip(("id", "other", "similarity"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    near = _pairs(vectors if queries is None else queries, vectors, id_col, vec_col, score, "id bigint, other bigint, similarity double", best)
    best_of = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col("other")))), 1, k).alias("n"))
    out = best_of.select("id", F.posexplode("n").alias("pos", "x"))
    return out.select("id", (F.col("pos") + 1).alias("rank"), F.col("x.other").alias("other"), F.round(-F.col("x.d"), 6).alias("similarity"))


def similarity_join(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """All pairs ``(a, b, similarity)``, a < b, with a cosine of at least ``threshold``.

    Products in single precision find the candidates, with room for their greatest rounding error; double precision decides.
    """

    def score(ia, x, ib, y, same):
        found, low, other = [], x.astype(np.float32), y.astype(np.float32)
        least = np.float32(threshold - (x.shape[1] + 8) * np.finfo(np.float32).eps)
        for i in range(0, len(ia), 512):
            p, q = np.divmod(np.flatnonzero(low[i : i + 512] @ other.T >= least), len(ib))
            p += i
            ok = ia[p] < ib[q] if same else ia[p] != ib[q]
            p, q = p[ok], q[ok]
            c = np.einsum("ij,ij->i", x[p], y[q])
            ok = c >= threshold
            u, v = ia[p[ok]], ib[q[ok]]
            found.append((np.minimum(u, v), np.maximum(u, v), np.round(c[ok], 6)))
        return pa.table(dict(zip(("a", "b", "similarity"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    return _pairs(vectors, None, id_col, vec_col, score, "a bigint, b bigint, similarity double")


def lsh_search(vectors: DataFrame, query: list[float], k: int, tables: int = 12, bits: int = 8, id_col: str = "id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """Approximate ``topk`` by cosine: only vectors that share a sign pattern of random projections with the query, in one of ``tables``, are scored exactly."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits, len(query)))
    want = (planes @ np.array(query, float) > 0).astype(int)
    hit = F.lit(False)
    for t in range(tables):
        same = F.lit(True)
        for b in range(bits):
            side = V.dot(vec_col, F.array(*[F.lit(float(x)) for x in planes[t, b]])) > 0
            same = same & (side == F.lit(bool(want[t, b])))
        hit = hit | same
    return topk(vectors.where(F.size(vec_col) == len(query)).where(hit), query, k, "cosine", id_col, vec_col)


@dataclass
class VectorIndexes:
    """Named pools of vectors of one dimension and metric; ids run from 1. A new index of a name replaces the old one."""

    indexes: dict[str, dict] = field(default_factory=dict)

    def create(self, name: str, dim: int, metric: str = "cosine", kind: str = "float32") -> None:
        if kind not in ("float32", "float64"):
            raise errors.UnsupportedVectorType(kind)
        if metric not in V.METRICS:
            raise errors.UnsupportedVectorType(metric)
        self.indexes[name] = {"dim": dim, "metric": metric, "kind": kind, "frames": [], "count": 0}

    def _get(self, name: str) -> dict:
        if name not in self.indexes:
            raise errors.IndexNotFound(name)
        return self.indexes[name]

    def insert(self, spark, name: str, rows: list[list[float]]) -> list[int]:
        i = self._get(name)
        if any(len(r) != i["dim"] for r in rows):
            raise ValueError(f"vectors of {name} have {i['dim']} elements")
        ids = list(range(i["count"] + 1, i["count"] + 1 + len(rows)))
        i["frames"].append(spark.createDataFrame(list(zip(ids, rows, strict=True)), f"id bigint, embedding array<{'float' if i['kind'] == 'float32' else 'double'}>"))
        i["count"] += len(rows)
        return ids

    def frame(self, name: str) -> DataFrame:
        frames = self._get(name)["frames"]
        if not frames:
            raise errors.EmptyColumn(name)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def search(self, name: str, query: list[float], k: int) -> DataFrame:
        i = self._get(name)
        if len(query) != i["dim"]:
            raise ValueError(f"queries of {name} have {i['dim']} elements")
        return topk(self.frame(name), query, k, i["metric"])

    def get(self, name: str, vector_id: int) -> list[float]:
        row = self.frame(name).where(F.col("id") == vector_id).first()
        if row is None:
            raise errors.IndexOutOfBounds(vector_id)
        return list(row.embedding)

    def stats(self) -> dict:
        each = self.indexes.values()
        return {"indexes": len(self.indexes), "vectors": sum(i["count"] for i in each), "dimensions": sum(i["dim"] for i in each), "bytes": sum(i["count"] * i["dim"] * (4 if i["kind"] == "float32" else 8) for i in each)}
