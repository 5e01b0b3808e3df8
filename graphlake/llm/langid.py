"""Language ID: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import textops as T

HIDDEN, SEGMENT = 8, 64
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 640
OTHER = "und"
REJECT = 0.75
_ROWS = 2048


class Network:
    """Two gated recurrent layers read a segment of bytes, one from each end; a softmax over both states labels every position.

    Arrays have the direction first. With gates z, r and candidate c: ``h' = c + z * (h - c)``,
    ``c = tanh(x_c + r * (h U_c))``; a byte's input is a row of the table ``x`` (an embedding already multiplied by the input weights).
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        k = len(classes)
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 0.8 / np.sqrt(hidden), (2, hidden, 3 * hidden)).astype(np.float32),
            "v": rng.normal(0, 0.3, (2, hidden, k)).astype(np.float32),
            "b": np.zeros(k, np.float32),
        }

    def loss_and_gradient(self, seg: np.ndarray, label: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the live positions of ``seg`` (n, length) and its gradient, by backpropagation through time."""
        p, hd = self.p, self.hidden
        n, length = seg.shape
        at = [np.stack((seg[:, t], seg[:, length - 1 - t])) for t in range(length)]
        h = np.zeros((2, n, hd), np.float32)
        kept = []
        for t in range(length):
            x = np.stack((p["x"][0][at[t][0]], p["x"][1][at[t][1]]))
            g = h @ p["u"]
            zr = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :, : 2 * hd] + g[:, :, : 2 * hd]))
            z, r = zr[:, :, :hd], zr[:, :, hd:]
            c = np.tanh(x[:, :, 2 * hd :] + r * g[:, :, 2 * hd :])
            new = c + z * (h - c)
            kept.append((h, z, r, c, g[:, :, 2 * hd :]))
            h = new
            kept[-1] += (new,)
        f = np.stack([k[5][0] for k in kept], axis=1)
        b = np.stack([k[5][1] for k in kept][::-1], axis=1)
        logit = f @ p["v"][0] + b @ p["v"][1] + p["b"]
        logit -= logit.max(axis=2, keepdims=True)
        q = np.exp(logit)
        q /= q.sum(axis=2, keepdims=True)
        total = live.sum()
        loss = -np.log(np.maximum(q[np.arange(n)[:, None], np.arange(length), label[:, None]], 1e-12))[live].sum() / total
        d = q
        d[np.arange(n)[:, None], np.arange(length), label[:, None]] -= 1
        d *= (live / total)[:, :, None].astype(np.float32)
        k = d.shape[2]
        grad = {name: np.zeros_like(a) for name, a in p.items()}
        grad["v"] = np.stack((f.reshape(-1, hd).T @ d.reshape(-1, k), b.reshape(-1, hd).T @ d.reshape(-1, k)))
        grad["b"] = d.reshape(-1, k).sum(axis=0)
        df, db = d @ p["v"][0].T, d @ p["v"][1].T
        dh = np.zeros((2, n, hd), np.float32)
        for t in range(length - 1, -1, -1):
            dh[0] += df[:, t]
            dh[1] += db[:, length - 1 - t]
            h, z, r, c, gc, _ = kept[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dx = np.concatenate((dz, dr, dc), axis=2)
            dg = np.concatenate((dz, dr, dc * r), axis=2)
            grad["u"] += h.transpose(0, 2, 1) @ dg
            for way in (0, 1):
                one = np.zeros((n, 256), np.float32)
                one[np.arange(n), at[t][way]] = 1
                grad["x"][way] += one.T @ dx[way]
            dh = dh * z + dg @ p["u"].transpose(0, 2, 1)
        return float(loss), grad

    def fit(self, seg: np.ndarray, label: np.ndarray, live: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.03, seed: int = 9) -> float:
        """Adam with a falling rate and clipped gradients; returns the mean loss of the last tenth of the steps."""
        rng, m, s, tail = np.random.default_rng(seed), {}, {}, []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(seg), batch)
            loss, grad = self.loss_and_gradient(seg[pick], label[pick], live[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                s[name] = 0.99 * s.get(name, 0) + 0.01 * g * g
                now = rate * min(1, step / 20) * (1 - 0.9 * step / steps)
                self.p[name] = (self.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step > 0.9 * steps:
                tail.append(loss)
        return float(np.mean(tail))

    def _ready(self):
        """Weights laid out for long rows of segments, with the halves of the logistic gates and of the reset folded in."""
        if not hasattr(self, "_w"):
            hd = self.hidden
            fold_x = np.concatenate((np.full(2 * hd, 0.5, np.float32), np.ones(hd, np.float32)))
            x, u = self.p["x"] * fold_x, self.p["u"] * np.float32(0.5)
            self._w = tuple(np.ascontiguousarray(a.transpose(0, 2, 1)) for a in (x, u, self.p["v"]))
        return self._w

    def positions(self, seg: np.ndarray) -> np.ndarray:
        """Class probabilities (class, position, segment) of ``seg`` (n, length)."""
        x, u, v = self._ready()
        hd, (n, length) = self.hidden, seg.shape
        cols = np.ascontiguousarray(seg.T).astype(np.intp)
        states = np.empty((2, length, hd, n), np.float32)
        h, d = np.zeros((2, hd, n), np.float32), np.empty((2, hd, n), np.float32)
        g, xt = np.empty((2, 3 * hd, n), np.float32), np.empty((2, 3 * hd, n), np.float32)
        gates, c, xc = g[:, : 2 * hd], g[:, 2 * hd :], xt[:, 2 * hd :]
        update, reset = g[:, :hd], g[:, hd : 2 * hd]
        for t in range(length):
            np.take(x[0], cols[t], axis=1, out=xt[0], mode="clip")
            np.take(x[1], cols[length - 1 - t], axis=1, out=xt[1], mode="clip")
            np.matmul(u, h, out=g)
            gates += xt[:, : 2 * hd]
            np.tanh(gates, out=gates)  # a logistic gate is (1 + this) / 2
            reset += 1
            c *= reset
            c += xc
            np.tanh(c, out=c)
            np.subtract(h, c, out=d)
            d *= update
            h += c
            h += d
            h *= 0.5
            states[0, t], states[1, length - 1 - t] = h
        q = v[0] @ states[0]
        q += v[1] @ states[1]
        q += self.p["b"][:, None]
        q = np.ascontiguousarray(q.transpose(1, 0, 2))
        q -= q.max(axis=0)
        np.exp(q, out=q)
        q /= q.sum(axis=0)
        return q

    def documents(self, data: np.ndarray, offs: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
        """Pooled probabilities (document, class), means over all positions, and how many positions each class labels. Empty documents: zeros."""
        k, seg, live, doc = len(self.classes), *segments(data, offs, segment)
        n = len(offs) - 1
        prob, votes = np.zeros((n, k)), np.zeros((n, k), np.int64)
        for i in range(0, len(seg), _ROWS):
            q = self.positions(seg[i : i + _ROWS])
            on = np.arange(segment)[:, None] < live[i : i + _ROWS]
            q *= on
            best, free = q.max(axis=0), on
            here = doc[i : i + _ROWS]
            at = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
            prob[here[at]] += np.add.reduceat(q.sum(axis=1, dtype=np.float32), at, axis=1, dtype=np.float64).T
            for c in range(k):
                own = q[c] == best
                own &= free
                free = free & ~own
                votes[here[at], c] += np.add.reduceat(np.count_nonzero(own, axis=0), at)
        return prob / np.maximum(np.diff(offs), 1)[:, None], votes


def segments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into rows of ``length`` bytes, each document from its first byte to its last; the last row is filled up with zeros.

    Returns rows, live bytes of each row, and its document.
    """
    size = np.diff(offs)
    count = -(-size // length)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin, live = offs[doc] + nth * length, np.minimum(length, size[doc] - nth * length)
    place = np.arange(length)
    padded = np.concatenate((data, np.zeros(length, np.uint8)))
    seg = padded[begin[:, None] + place]
    seg[place >= live[:, None]] = 0
    return seg, live, doc


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, steps: int = 260, hidden: int = HIDDEN) -> Network | None:
    """A network fitted to the ``lang`` column on a bounded sample; None if no row has both a text and a language.

    The sample is the ``sample_docs`` labelled rows of the least hashed doc_ids, of each a stretch of ``sample_chars``
    characters at a hashed place. Languages weigh equally. The class ``und`` (no language) is learnt from random bytes and from the same stretches with their bytes shuffled.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    n = docs.where("lang IS NOT NULL").count()
    share = min(1.0, 2 * sample_docs / max(1, n))
    low = min(2**63 - 1, -(2**63) + int(share * 2**64))  # hashes up to here hold twice the sample, so that no task sends more to the driver than that
    rows = (
        docs.where(F.col("lang").isNotNull() & (h <= F.lit(low)) & (F.length("text") > 0))
        .select("lang", h.alias("h"), F.substring("text", (F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - sample_chars)) + 1).cast("int"), F.lit(sample_chars)).alias("text"))
        .orderBy("h", "lang", "text")
        .limit(sample_docs)
        .collect()
    )
    if not rows:
        return None
    classes = sorted({r.lang for r in rows} - {OTHER}) + [OTHER]
    rng = np.random.default_rng(3)
    segs, labels, lives = [], [], []
    for c, lang in enumerate(classes[:-1]):
        texts = [r.text.encode() for r in rows if r.lang == lang]
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        seg, live, _ = segments(np.frombuffer(b"".join(texts), np.uint8), offs, SEGMENT)
        pick = rng.integers(0, len(seg), 3000)
        own = seg[pick]
        own[:600] -= 32 * ((own[:600] >= 97) & (own[:600] <= 122)).astype(np.uint8)  # a fifth in capitals
        segs.append(own)
        lives.append(live[pick])
        labels.append(np.full(3000, c))
    shuffled = rng.permuted(np.concatenate(segs), axis=1)
    noise = np.concatenate((rng.integers(0, 256, (1500, SEGMENT)), rng.integers(33, 127, (1500, SEGMENT)))).astype(np.uint8)
    shuffled = shuffled[rng.integers(0, len(shuffled), 3000)]
    segs += [noise, shuffled]
    lives.append(np.full(6000, SEGMENT))
    labels.append(np.full(6000, len(classes) - 1))
    seg, live, label = np.concatenate(segs), np.concatenate(lives), np.concatenate(labels)
    net = Network(classes, hidden)
    net.fit(seg, label, np.arange(SEGMENT) < live[:, None], steps)
    return net


def known(prob: np.ndarray) -> np.ndarray:
    """Documents that are in some language: all but those with more than three quarters of their mass on ``und``, whose bytes are mostly numbers, keys or noise. Capitals, lists or some numbers in a text do not suffice."""
    return prob[:, -1] <= REJECT


def _identify(net: Network | None):
    def run(batches):
        for batch in batches:
            doc_ids = T.ids(batch.column("doc_id"))
            for i, j, data, offs in T.chunks(batch, 1 << 20):
                size = np.diff(offs)
                if net is None:
                    prob, votes = np.zeros((j - i, 1)), np.zeros((j - i, 1), np.int64)
                else:
                    prob, votes = net.documents(data, offs)
                some = (size > 0) & (net is not None)
                keep = some & known(prob)
                best = np.where(keep, prob[:, :-1].argmax(axis=1), prob.shape[1] - 1) if net else np.zeros(j - i, int)
                names = pa.array(net.classes if net else [OTHER])
                lang = pa.array(np.where(some, best, -1)).cast(pa.int32())
                lang = names.take(pc.if_else(pc.less(lang, 0), None, lang))
                agree = votes[np.arange(j - i), best]
                yield pa.RecordBatch.from_arrays([T.id_array(doc_ids[i:j]), lang, pa.array(np.round(prob[np.arange(j - i), best], 6)), pa.array(size), pa.array(agree), pa.array(keep)], names=["doc_id", "language", "probability", "n_bytes", "n_agree", "keep"])

    return run


def identify(docs: DataFrame, net: Network | None = None, **training) -> DataFrame:
    """The language of every document: ``(doc_id, language, probability, n_bytes, n_agree, keep)``.

    The network (fitted here by :func:`train` unless given) labels every byte of the whole text, read in segments of 64
    bytes from both ends of each; ``probability`` is the mean over all positions for the ``language`` whose mean is greatest (ties: the
    first by name), ``n_agree`` counts the positions that it labels. A text whose mean for ``und`` is over REJECT (three quarters of its
    bytes) is in no language: ``language`` is ``und`` and ``keep`` false.

    Null and empty texts have a null language, probability 0 and are not kept; texts of any length are read whole; where nothing is labelled,
    nothing can be fitted, and that holds for all rows. Repeated rows and null doc_ids are rows like others; other columns are ignored. An empty
    table gives no rows.
    """
    if net is None:
        net = train(docs, **training)
    return docs.select("doc_id", "text").mapInArrow(_identify(net), "doc_id bigint, language string, probability double, n_bytes bigint, n_agree bigint, keep boolean")


def keep_known(docs: DataFrame, net: Network | None = None, **training) -> DataFrame:
    """The rows of ``docs`` that :func:`identify` keeps, as they are, also with names that clash with its columns.

    Rows with a null or empty text go, and so do those mostly in no language; repeated rows go or stay together. Where no row is labelled nothing is kept.
    """
    if net is None:
        net = train(docs, **training)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for i, j, data, offs in T.chunks(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"]), 1 << 20):
                prob = net.documents(data, offs)[0] if net else np.zeros((j - i, 1))
                keep.append((np.diff(offs) > 0) & known(prob) & (net is not None))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark, sf_dir):
    """Languages of the whole documents table."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
