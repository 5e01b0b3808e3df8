"""Vectorised kernels over Arrow text columns: whole batches of documents as one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NULL_ID = np.int64(-(2**63))
CHUNK_BYTES = 1 << 20
WORD_BASE, GRAM_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\f\v")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def ids(col: pa.Array) -> np.ndarray:
    """A BIGINT column as int64; null is NULL_ID."""
    return pc.fill_null(col.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    """The inverse of :func:`ids`."""
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64, len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents ``(first, end, bytes, offsets)`` of about ``size`` bytes; a longer document is a run of its own."""
    data, offs = utf8(batch.column("text"))
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(m - 1, b, np.uint64)))) for b in (base, inv))
        if m <= 2 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def token_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every token: a maximal run of bytes other than ASCII white space within a document."""
    n = data.size
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    tok = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = tok[:-1]
    start = np.flatnonzero(tok & (edge[:-1] | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = tok[1:]
    end = np.flatnonzero(tok & (edge[1:] | ~after)) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of every token, equal for equal tokens anywhere."""
    if lower:
        data = _LOWER[data]
    p, inv = powers(WORD_BASE, data.size + 1)
    s = np.empty(data.size + 1, np.uint64)
    s[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: data.size], out=s[1:])
    return mix((s[end] - s[start]) * inv[start])


def window_hashes(tokens: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every ``width`` consecutive tokens of one document, and the index of its first token."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, inv = powers(GRAM_BASE, n + 1)
    s = np.empty(n + 1, np.uint64)
    s[0] = 0
    np.cumsum(tokens * p[:n], out=s[1:])
    at = np.flatnonzero(doc[width - 1 :] == doc[: n - width + 1])
    return mix((s[at + width] - s[at]) * inv[at]), at


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased ``width``-token shingles and the document of each, in document order.

    A document of fewer tokens has the one shingle of all its tokens; one without tokens has none.
    """
    start, end, doc = token_spans(data, offs)
    h = token_hashes(data, start, end, lower=True)
    g, at = window_hashes(h, doc, width)
    gd = doc[at]
    count = np.bincount(doc, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.concatenate(([0], np.cumsum(count)))[short]
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            here = count[short] > k
            own[here] = mix(own[here] + h[first[here] + k] + np.uint64(k + 1))
        g, gd = np.concatenate((g, own)), np.concatenate((gd, short))
        order = np.argsort(gd, kind="stable")
        g, gd = g[order], gd[order]
    return g, gd


def long_shingles(data: np.ndarray, width: int, size: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """The shingle hashes of one very long text, as :func:`shingles` has them, by pieces of about ``size`` bytes that overlap by ``width - 1`` tokens.

    A piece holds whole tokens, so a longer token makes a longer piece. A text with fewer tokens than ``width`` is one piece.
    """
    begin, stop = 0, data.size
    while True:
        cut = min(stop, begin + size)
        while cut < stop:  # on to the end of the token
            blank = np.flatnonzero(SPACE[data[cut : cut + size]])
            if len(blank):
                cut += int(blank[0])
                break
            cut = min(stop, cut + size)
        part = data[begin:cut]
        g, _ = shingles(part, np.array([0, len(part)]), width)
        start = token_spans(part, np.array([0, len(part)]))[0]
        if cut < stop and len(start) < width:  # too few tokens yet: a piece twice as long
            size *= 2
            continue
        if begin == 0 or len(start) >= width:
            yield g
        if cut >= stop:
            return
        begin += int(start[len(start) - width + 1]) if width > 1 else cut - begin
