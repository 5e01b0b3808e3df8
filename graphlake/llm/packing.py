"""Packing along a space-filling curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphlake.llm import textops as T
from graphlake.session import cut, fan_out

CAPACITY, WIDTH, DIMS, BITS = 2048, 256, 3, 16
_rng = np.random.Generator(np.random.PCG64(77))
PROJECTION = _rng.standard_normal((WIDTH, DIMS))
PROJECTION /= np.linalg.norm(PROJECTION, axis=0)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer points ``x`` (n, dims) with coordinates under 2**bits on the Hilbert curve (Skilling, 2004)."""
    x = x.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert key and token count of every document: signed hashed counts of its lower-cased tokens, damped and scaled to
    length 1, projected to DIMS directions and put on a grid that is about evenly filled."""
    n = len(offs) - 1
    start, end, doc = T.token_spans(data, offs)
    h = T.token_hashes(data, start, end, lower=True)
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
    keys, tokens = np.zeros(n, np.int64), np.bincount(doc, minlength=n)
    for i in range(0, n, 2048):
        a, b = np.searchsorted(doc, [i, i + 2048])
        m = min(2048, n - i)
        v = np.bincount((doc[a:b] - i) * WIDTH + (h[a:b] % np.uint64(WIDTH)).astype(np.int64), sign[a:b], minlength=m * WIDTH).reshape(m, WIDTH)
        v = np.sign(v) * np.sqrt(np.abs(v))
        x = v @ PROJECTION / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
        u = 0.5 + 0.5 * np.tanh(x * (0.8 * np.sqrt(WIDTH)))
        keys[i : i + m] = hilbert(np.minimum((np.round(u, 9) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
    return keys, tokens


def _keyed(batches):
    for batch in batches:
        k, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offs in T.chunks(batch):
            a, b = curve_keys(data, offs)
            k.append(a)
            n.append(b)
        names = [f"c{i}" for i in range(batch.num_columns)] + ["_key", "_n"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(k)), pa.array(np.concatenate(n).astype(np.int64))], names=names)


def _running(batches):
    """Adds each row's offset in its partition's token stream."""
    at = 0
    for batch in batches:
        n = batch.column("_n").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=[*batch.schema.names, "_in"])
        at = int(ends[-1]) if len(n) else at


def _with(schema: ST.StructType, *names: str) -> ST.StructType:
    return ST.StructType([*schema.fields, *[ST.StructField(x, ST.LongType()) for x in names]])


def _renamed(schema: ST.StructType) -> ST.StructType:
    return ST.StructType([ST.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])


def _ordered(keyed: DataFrame, id_col: str, parts: int) -> DataFrame:
    """Rows with ``_offset``, their place in the token stream along the curve."""
    order = ["_key", id_col, "_n"]
    s = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    s = s.mapInArrow(_running, _with(s.schema, "_in")).withColumn("_pid", F.spark_partition_id())
    s = cut(s)
    sums = s.groupBy("_pid").agg(F.sum("_n").alias("_sum"))
    base = sums.select("_pid", F.coalesce(F.sum("_sum").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return s.join(F.broadcast(base), "_pid").withColumn("_offset", F.col("_in") + F.col("_base")).drop("_pid", "_in", "_base")


def packs(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs of neighbouring documents: ``(pack_id, position, doc_id, start_token, end_token)``, one row per piece of a document in a pack.

    Every document's hashed token vector is projected to three dimensions; documents are range-sorted by the
    Hilbert key of that point (ties by doc_id, then token count), and the stream of their tokens is cut every ``capacity`` tokens: all packs but
    the last are full, and a document that does not fit goes on in the next pack. The order is one
    range shuffle of ids and keys; offsets come from running sums inside the sorted partitions and one row per partition.

    Null, empty and blank texts have no tokens and no piece. Repeated rows are packed as often as they come.
    A null doc_id sorts first and stays null. Other columns are ignored. An empty table gives no rows.
    """
    some = docs.select("doc_id", "text")
    schema = ST.StructType([ST.StructField("doc_id", ST.LongType()), ST.StructField("_key", ST.LongType()), ST.StructField("_n", ST.LongType())])
    keyed = cut(some.mapInArrow(_light, schema).where("_n > 0"))
    s = _ordered(keyed, "doc_id", fan_out(docs, 64 << 20))
    first, last = F.floor(F.col("_offset") / capacity), F.floor((F.col("_offset") + F.col("_n") - 1) / capacity)
    p = s.withColumn("pack_id", F.explode(F.sequence(first, last))).withColumn("start_token", F.greatest(F.lit(0), F.col("pack_id") * capacity - F.col("_offset")))
    return p.select(
        "pack_id",
        (F.col("_offset") + F.col("start_token") - F.col("pack_id") * capacity).alias("position"),
        "doc_id",
        "start_token",
        F.least(F.col("_n"), (F.col("pack_id") + 1) * capacity - F.col("_offset")).alias("end_token"),
    )


def _light(batches):
    for batch in batches:
        doc_ids = batch.column("doc_id").cast(pa.int64())
        for i, j, data, offs in T.chunks(batch):
            k, n = curve_keys(data, offs)
            yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), pa.array(k), pa.array(n.astype(np.int64))], names=["doc_id", "_key", "_n"])


def _pieces(names: list[str], capacity: int):
    def run(batches):
        text_at = names.index("text")
        for batch in batches:
            offset = batch.column("_offset").to_numpy()
            whole = pa.RecordBatch.from_arrays([batch.column(f"c{text_at}")], names=["text"])
            for i, j, data, offs in T.chunks(whole):
                start, end, doc = T.token_spans(data, offs)
                if not len(start):
                    continue
                at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=j - i))))
                place = offset[i:j][doc] + np.arange(len(doc)) - at[doc]
                pack = place // capacity
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pack[1:] != pack[:-1]))))
                stop = np.append(new[1:], len(doc))
                raw = data.tobytes()
                rows = pa.array(i + doc[new])
                kept = [batch.column(f"c{k}").take(rows) for k in range(len(names)) if k != text_at]
                pieces = pa.array([raw[a:b] for a, b in zip(start[new], end[stop - 1], strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(pack[new]), pa.array(place[new] % capacity), pa.array(stop - new), pieces, *kept], names=["pack_id", "position", "n_tokens", "text", *[x for x in names if x != "text"]])

    return run


def packed_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packs of :func:`packs` with the text of every piece: ``(pack_id, position, n_tokens, text)`` and the other columns of ``docs``.

    ``position`` is the piece's first token in its pack. A piece's text runs from its first token to its last one. Columns of
    ``docs`` named like the first three are replaced.
    """
    own = ("pack_id", "position", "n_tokens")
    docs = docs.drop(*own)
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = _renamed(docs.schema)
    text_at = f"c{names.index('text')}"

    def keyed(batches):
        for batch in batches:
            with_text = pa.RecordBatch.from_arrays([*batch.columns, batch.column(text_at)], names=[*batch.schema.names, "text"])
            for out in _keyed([with_text]):
                yield pa.RecordBatch.from_arrays([*batch.columns, out.column("_key"), out.column("_n")], names=[*batch.schema.names, "_key", "_n"])

    k = flat.mapInArrow(keyed, _with(schema, "_key", "_n")).where("_n > 0")
    s = _ordered(k, f"c{names.index('doc_id')}", fan_out(docs, 16 << 20))
    rest = [f for f in docs.schema.fields if f.name != "text"]
    out = ST.StructType([ST.StructField(x, ST.LongType()) for x in own] + [ST.StructField("text", ST.StringType()), *rest])
    return s.mapInArrow(_pieces(names, capacity), out)


def op8_packing(spark, sf_dir):
    """Packs of the whole documents table."""
    return packs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
