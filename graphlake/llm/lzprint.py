"""Document fingerprints from Lempel-Ziv phrases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import lsh
from graphlake.llm import textops as T
from graphlake.session import cut

PERMUTATIONS, ROWS, THRESHOLD = 168, 3, 0.3
WINDOW, _KEY, _DOCS = 1 << 20, 7, 256
_SIGS = pa.schema([("doc_id", pa.int64()), ("n_phrases", pa.int64()), ("sid", pa.int64()), ("sig", pa.binary()), ("low", pa.binary())])


def phrase_ends(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For every byte of up to 256 texts the end of the Lempel-Ziv phrase that begins there: the shortest run of bytes that does not begin
    anywhere earlier in its text.

    That is exact up to seven bytes. Where seven bytes have come before, the run goes on as long as their first occurrences go on in step, and one byte
    more. A phrase ends with its text at the latest.
    """
    n = data.size
    size = np.diff(offs)
    stop = np.repeat(offs[1:], size)
    padded = np.concatenate((data, np.zeros(_KEY, np.uint8)))
    key = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    for k in range(_KEY):
        key <<= np.uint64(8)
        key |= padded[k : k + n]
    left = stop - np.arange(n)
    for k in np.flatnonzero(left < _KEY):  # a few bytes at the end of each text
        key[k] &= np.uint64(2**64 - (1 << 8 * (_KEY - int(left[k]))))
    order = np.argsort(key)
    key = key[order]
    differ = key[1:] ^ key[:-1]
    length = np.zeros(n, np.int64)
    for k in range(_KEY, 0, -1):  # texts and the first k bytes are equal within a group: its first position is where they are new
        begin = np.concatenate(([0], np.flatnonzero(differ >> np.uint64(8 * (_KEY - k))) + 1))
        first = np.minimum.reduceat(order, begin)
        if k == _KEY:
            source = np.empty(n, np.int64)
            source[order] = np.repeat(first, np.diff(np.append(begin, n)))
        length[first] = k
    breaks = np.flatnonzero(np.append(source[1:] != source[:-1] + 1, True))
    run = breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n) if (length == 0).any() else 0
    return np.minimum(np.arange(n) + np.where(length > 0, length, _KEY + 1 + run), stop)


def phrases(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every phrase, in order: each begins where the one before it ends. Of a text longer than WINDOW every stretch of that length has a dictionary of its own."""
    cuts, owner = [], []
    for d in np.flatnonzero(np.diff(offs)):
        at = np.arange(offs[d], offs[d + 1], WINDOW)
        cuts.append(at)
        owner.append(np.full(len(at), d))
    if not cuts:
        z = np.zeros(0, np.int64)
        return z, z, z
    cuts, owner = np.append(np.concatenate(cuts), offs[-1]), np.concatenate(owner)
    starts, ends, docs = [], [], []
    i = 0
    while i < len(owner):
        j = max(i + 1, min(i + _DOCS, int(np.searchsorted(cuts, cuts[i] + WINDOW, "right")) - 1))
        j = min(j, len(owner))
        base = int(cuts[i])
        end = phrase_ends(data[base : cuts[j]], cuts[i : j + 1] - base)
        step, at, n, begun = end.tolist(), 0, len(end), []
        while at < n:
            begun.append(at)
            at = step[at]
        begun = np.array(begun)
        starts.append(begun + base)
        ends.append(end[begun] + base)
        docs.append(owner[i + np.searchsorted(cuts[i : j + 1] - base, begun, "right") - 1])
        i = j
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(docs)


def elements(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes that stand for each text, the text of each, and how many phrases every text has.

    An element is a phrase with the one after it; a text of one phrase has that as its only element.
    """
    start, end, doc = phrases(data, offs)
    count = np.bincount(doc, minlength=len(offs) - 1)
    if not len(start):
        return np.zeros(0, np.uint64), doc, count
    h = T.token_hashes(data, start, end)
    two = T.mix(h[:-1] * T.GRAM_BASE + h[1:])
    last = np.append(doc[1:] != doc[:-1], True)
    alone = last & (count[doc] == 1)
    out = np.append(two, np.uint64(0))
    out[alone] = h[alone]
    use = ~last | alone
    return out[use], doc[use], count


def _sign(permutations: int):
    def run(batches):
        for batch in batches:
            doc_ids = T.ids(batch.column("doc_id"))
            for i, j, data, offs in T.chunks(batch, WINDOW):
                h, doc, count = elements(data, offs)
                has, sig = lsh.extremes(h, doc, j - i, permutations, both=False)
                some = np.concatenate(([0], np.cumsum(~T.SPACE[data])))[offs]
                some = some[1:] > some[:-1]
                has, sig = has[some[has]], sig[some[has]]
                if len(has):
                    high, low = ([x[k].tobytes() for k in range(len(x))] for x in ((sig >> 8).astype(np.uint8), sig.astype(np.uint8)))
                    yield pa.RecordBatch.from_arrays([T.id_array(doc_ids[i:j][has]), pa.array(count[has].astype(np.int64)), pa.array(lsh.signature_id(sig)), pa.array(high, pa.binary()), pa.array(low, pa.binary())], schema=_SIGS)

    return run


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The Lempel-Ziv fingerprint of every document: ``(doc_id, n_phrases, fingerprint, group_id, group_size)``.

    A document's bytes are parsed into dictionary phrases (Lempel and Ziv, 1977; :func:`phrases`): each is the shortest run of bytes that the document does not hold
    earlier. After an edit such a parse soon falls into step again. The set of the hashes of phrases, each with its successor, is summed up by the
    least hash under each of ``permutations`` functions, 16 bits of it (as in LZJD, Raff & Nicholas 2017, but for the pairs). ``fingerprint`` is a 64-bit id of
    that signature. Documents whose signatures share a band of ``rows`` values and agree in at least ``threshold`` of all (by 8 bits) are linked; ``group_id`` is
    the least doc_id of the connected component. The threshold lies below the agreement of documents that share half of their
    three-word shingles, and far above that of unrelated texts (0.01) and of a text with its own words shuffled (0.02).

    A null, empty or blank text has no row. Very long texts are read whole; the dictionary starts anew every
    2**20 bytes. Repeated rows give a row each and one group; null doc_ids have no row. Other columns are ignored. An empty table gives no rows.
    """
    marked = cut(docs.select("doc_id", "text").mapInArrow(_sign(permutations), "doc_id bigint, n_phrases bigint, sid bigint, sig binary, low binary"))
    return lsh.document_groups(marked, rows, threshold, np.uint8).select("doc_id", "n_phrases", F.col("sid").alias("fingerprint"), "group_id", "group_size")


def op5_document_fingerprints(spark, sf_dir):
    """Fingerprints of the whole documents table."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
