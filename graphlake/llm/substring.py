"""Substring dedup: repeated token windows merged into maximal removal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from graphlake.llm import textops as T
from graphlake.session import fan_out

WIDTH = 45
FLUSH = 4_000_000


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(a, prepend=a.dtype.type(0)).tobytes())


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype), dtype=dtype)


_SENT = pa.schema([("part", pa.int32()), ("uid", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_BACK = pa.schema([("uid", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_tokens", pa.int64())])


def _send(parts: int, width: int):
    def run(batches):
        from pyspark import TaskContext

        uid, held, size = TaskContext.get().partitionId() << 32, [], 0

        def emit(uid):
            doc_ids, counts, h = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((h >> np.uint64(16)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
            order = np.argsort(part, kind="stable").astype(np.int32)
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(uid % parts, uid, -1, _pack(doc_ids), _pack(counts))]
            for p in range(parts):
                at = order[ends[p] : ends[p + 1]]
                if len(at):
                    rows.append((p, uid, len(at), h[at].tobytes(), _pack(at)))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

        for batch in batches:
            all_ids = T.ids(batch.column("doc_id"))
            for i, j, data, offs in T.chunks(batch):
                start, end, doc = T.token_spans(data, offs)
                h, at = T.window_hashes(T.token_hashes(data, start, end), doc, width)
                if not len(h):
                    continue
                counts = np.bincount(doc[at], minlength=j - i)
                has = counts > 0
                held.append((all_ids[i:j][has], counts[has].astype(np.int32), h))
                size += len(h)
                if size >= FLUSH:
                    yield emit(uid)
                    uid, held, size = uid + 1, [], 0
        if held:
            yield emit(uid)

    return run


def _count(batches):
    """All windows of one hash range: answers every sender with the places of its windows that occur more than once."""
    own, h, at, passed = [], [], [], []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in ("uid", "n", "a", "b")), strict=True):
            if r[1] < 0:
                passed.append(r)
            else:
                own.append(r[0])
                h.append(np.frombuffer(r[2], np.uint64))
                at.append(r[3])
    if h:
        s = np.sort(np.concatenate(h))
        twice = s[1:][s[1:] == s[:-1]]
        twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))] if len(twice) else twice
        for uid, x, places in zip(own, h, at, strict=True):
            if len(twice):
                k = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
                hit = twice[k] == x
                if hit.any():
                    passed.append((uid, int(hit.sum()), _pack(_unpack(places, np.int32)[hit]), b""))
    for i in range(0, len(passed), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*passed[i : i + 1000], strict=True), _BACK, strict=True)], schema=_BACK)


def _merge(width: int):
    def run(batches):
        index, hits = {}, {}
        for batch in batches:
            for uid, n, a, b in zip(*(batch.column(k).to_pylist() for k in ("uid", "n", "a", "b")), strict=True):
                if n < 0:
                    index[uid] = (a, b)
                else:
                    hits.setdefault(uid, []).append(a)
        for uid, blobs in hits.items():
            doc_ids, counts = _unpack(index[uid][0], np.int64), _unpack(index[uid][1], np.int32)
            starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            at = np.sort(np.concatenate([_unpack(x, np.int32) for x in blobs])).astype(np.int64)
            doc = np.searchsorted(starts, at, "right") - 1
            pos = at - starts[doc]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > width)
            last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))
            begin, stop = pos[new], pos[last] + width
            yield pa.RecordBatch.from_arrays([T.id_array(doc_ids[doc[new]]), pa.array(begin), pa.array(stop), pa.array(stop - begin)], schema=_OUT)

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Maximal token intervals ``[start_token, end_token)`` of ``docs(doc_id, text)`` covered by windows of
    ``width`` tokens that occur more than once in the corpus, in another document or elsewhere in the same one.

    Tokens are runs of bytes other than ASCII white space, taken exactly. Every window's Rabin-Karp hash
    (64 bits) is sent once, packed with others of its hash range into binary rows (about 9 bytes a window);
    the task that owns a range counts its hashes and answers each sender with the places that repeat, again
    packed. So no row per window crosses the shuffle, nothing is broadcast or collected, and the number of
    ranges follows the input. Overlapping or touching windows merge. All occurrences are reported.

    Null or empty texts and documents of fewer than ``width`` tokens have no windows. Repeated rows are
    occurrences of their own (each is reported); texts of any length are read whole; a null doc_id stays null. Other columns are
    ignored. An empty table gives no rows. The default of 45 finds every repeated passage of 50 words even if its
    first and last words are glued to their surroundings.
    """
    parts = fan_out(docs, 12 << 20)
    back = max(8, parts // 4)
    sent = docs.select("doc_id", "text").mapInArrow(_send(parts, width), "part int, uid bigint, n int, a binary, b binary")
    counted = sent.repartitionById(parts, sent["part"]).select("uid", "n", "a", "b").mapInArrow(_count, "uid bigint, n int, a binary, b binary")
    return counted.repartition(back, "uid").mapInArrow(_merge(width), "doc_id bigint, start_token bigint, end_token bigint, n_tokens bigint")


def op4_substring_dedup(spark, sf_dir):
    """Removal intervals of the whole documents table."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') AS g
  FROM t, LATERAL (SELECT unnest(range(1, len(w) - {WIDTH - 2})) AS i)
), rep AS (
  SELECT doc_id, pos FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)
), marked AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM rep
), isl AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM marked
)
SELECT doc_id, min(pos) AS start_token, max(pos) + {WIDTH} AS end_token, max(pos) + {WIDTH} - min(pos) AS n_tokens
FROM isl GROUP BY doc_id, island
"""
