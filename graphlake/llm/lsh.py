"""Grouping documents by the agreement of their min-hash signatures: banding, exact check inside buckets, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm import textops as T
from graphlake.operators.components import connected_components
from graphlake.session import cut, drop_scratch

_rng = np.random.Generator(np.random.PCG64(20240229))
MULTIPLIERS = _rng.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fold(m: np.ndarray, kind: type = np.uint16) -> np.ndarray:
    """The upper bits of each mixed 64-bit extreme, 16 or 8: unequal extremes agree with probability 2**-16 or 2**-8."""
    return (T.mix(m) >> np.uint64(64 - 8 * np.dtype(kind).itemsize)).astype(kind)


def raw_extremes(h: np.ndarray, doc: np.ndarray, n: int, permutations: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have hashes, and their extremes.

    Under every permutation of 64-bit hashes the least value is kept and, with ``both``, the greatest too,
    side by side.
    """
    has = np.bincount(doc, minlength=n) > 0
    at = np.searchsorted(doc, np.flatnonzero(has))
    out = np.empty((len(at), permutations * (1 + both)), np.uint64)
    for k in range(permutations if len(at) else 0):
        v = h * MULTIPLIERS[k]
        out[:, k * (1 + both)] = np.minimum.reduceat(v, at)
        if both:
            out[:, 2 * k + 1] = np.maximum.reduceat(v, at)
    return np.flatnonzero(has), out


def joined(parts: list[np.ndarray], both: bool) -> np.ndarray:
    """The extremes of a document from those of its pieces."""
    out = np.min(parts, axis=0)
    if both:
        out[:, 1::2] = np.max([p[:, 1::2] for p in parts], axis=0)
    return out


def extremes(h: np.ndarray, doc: np.ndarray, n: int, permutations: int, both: bool, kind: type = np.uint16) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have hashes, and their signatures: :func:`raw_extremes`, folded."""
    has, raw = raw_extremes(h, doc, n, permutations, both)
    return has, fold(raw, kind)


def signature_id(sig: np.ndarray) -> np.ndarray:
    """A 64-bit id for each signature, equal for equal ones."""
    words = np.ascontiguousarray(sig).view(np.uint64)
    p, _ = T.powers(T.GRAM_BASE, words.shape[1] + 1)
    return T.mix((T.mix(words + np.uint64(1)) * p[: words.shape[1]]).sum(axis=1, dtype=np.uint64)).view(np.int64)


_KEYS = pa.schema([("key", pa.int64()), ("sid", pa.int64())])
_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _bands(rows: int, kind: type):
    def run(batches):
        for batch in batches:
            sid = batch.column("sid").to_numpy()
            if not len(sid):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), kind).reshape(len(sid), -1)
            if "low" in batch.schema.names:
                sig = sig.astype(np.uint16) << 8 | np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(sig.shape)
            bands = sig.shape[1] // rows
            g = sig[:, : bands * rows].reshape(len(sid) * bands, rows).astype(np.uint64)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), len(sid)) * T.WORD_BASE
            for k in range(rows):
                key = T.mix(key + g[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(sid, bands))], schema=_KEYS)

    return run


def link(sig: np.ndarray, threshold: float) -> np.ndarray:
    """The first member of each row's single-linkage cluster: rows agree if at least ``threshold`` of their values are equal.

    Every row is compared with all rows that no cluster holds yet, so a bucket of copies takes one comparison a row.
    """
    head, left = np.empty(len(sig), np.int64), np.arange(len(sig))
    while left.size:
        seed, left = left[0], left[1:]
        head[seed] = seed
        queue = [seed]
        while queue and left.size:
            hit = np.count_nonzero(sig[left] == sig[queue.pop()], axis=1) >= threshold * sig.shape[1]
            new, left = left[hit], left[~hit]
            head[new] = seed
            queue.extend(new)
    return head


def _verify(threshold: float, kind: type):
    def run(batches):
        held = []

        def edges(group, sid, sig):
            begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(begin, len(group)))
            two = begin[size == 2]
            ok = np.count_nonzero(sig[two] == sig[two + 1], axis=1) >= threshold * sig.shape[1]
            a, b = [sid[two[ok]]], [sid[two[ok] + 1]]
            for s, n in zip(begin[size > 2], size[size > 2], strict=True):
                head = link(sig[s : s + n], threshold)
                far = np.flatnonzero(head != np.arange(n))
                a.append(sid[s + head[far]])
                b.append(sid[s + far])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_EDGES)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, sid = batch.column("grp").to_numpy(), batch.column("sid").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), kind).reshape(len(sid), -1)
            held.append((group, sid, sig))
            other = np.flatnonzero(group != group[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:  # the bucket at the end may go on in the next batch
                g, s, x = (np.concatenate(c) for c in zip(*held, strict=True))
                cut_at = len(g) - (len(group) - last)
                yield edges(g[:cut_at], s[:cut_at], x[:cut_at])
                held = [(g[cut_at:], s[cut_at:], x[cut_at:])]
        if held:
            yield edges(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def signature_groups(sigs: DataFrame, rows: int, threshold: float, kind: type = np.uint16) -> DataFrame:
    """Groups of near-equal signatures: ``(sid, component)`` for every signature that agrees with another one.

    ``sigs(sid, sig)`` has one row per distinct signature. Signatures that share a band of ``rows`` values meet in
    a bucket (values are of ``kind``); buckets with the same members are kept once; inside a bucket all pairs that no link joins yet
    are compared over the whole signature, with no limit on the bucket's size; links are closed to components.
    Only keys and ids cross the shuffle for all signatures; signatures themselves follow only into shared buckets. Where 8 bits of each value
    suffice there, a column ``low`` has 8 more bits for the keys, so that chance brings few unequal bands together.
    """
    keys = sigs.mapInArrow(_bands(rows, kind), "key bigint, sid bigint")
    w = Window.partitionBy("key")
    shared = keys.select(
        "sid",
        F.count("*").over(w).alias("n"),
        F.min("sid").over(w).alias("lo"),
        F.max("sid").over(w).alias("hi"),
        F.sum(F.xxhash64("sid").bitwiseAND((1 << 40) - 1)).over(w).alias("members"),
    )
    shared = shared.where("n > 1").select(F.xxhash64("n", "lo", "hi", "members").alias("grp"), "sid").distinct()
    full = shared.join(sigs.select("sid", "sig"), "sid").repartition("grp").sortWithinPartitions("grp", "sid").select("grp", "sid", "sig")
    edges = full.mapInArrow(_verify(threshold, kind), "src bigint, dst bigint")
    return connected_components(edges)


def document_groups(marked: DataFrame, rows: int, threshold: float, kind: type = np.uint16) -> DataFrame:
    """``marked(doc_id, sid, sig, ...)`` with ``group_id``, the least doc_id of the document's group, and ``group_size``.

    Documents of one signature are a group before anything else, so thousands of copies count as one below.
    Null doc_ids take no part. Both columns come from aggregates by group, not from windows over
    documents, and repeated rows of a doc_id count once.
    """
    some = marked.where("doc_id IS NOT NULL")
    sigs = some.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("sig", "low") if c in some.columns])
    sigs = cut(sigs.withColumn("num", F.monotonically_increasing_id()))  # small numbers stand for the ids below: they take fewer bytes in a shuffle
    comp = signature_groups(sigs.drop("sid").withColumnRenamed("num", "sid"), rows, threshold, kind)
    comp = cut(comp.join(sigs.select(F.col("num").alias("id"), "sid"), "id").select("sid", "component"))
    drop_scratch(sigs)
    flat = some.drop("sig", "low").join(comp, "sid", "left")
    flat = flat.withColumn("component", F.coalesce(F.col("component") * 2, F.col("sid").bitwiseOR(1)))
    heads = flat.select("component", "doc_id").distinct().groupBy("component").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return flat.join(heads, "component").drop("component")
