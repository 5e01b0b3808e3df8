"""PII by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a span classifier decides."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphlake.llm import textops as T
from graphlake.session import cut, drop_scratch

_NUMBERS = re.compile(
    r"""(?<![\w.+-])(?:
      (?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)
    | (?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    | (?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)
    | (?P<card>\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{13,19})(?!\w)
    | (?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
    | (?P<number>\d[\d.,/:-]{5,}\d)(?!\w)
    )""",
    re.X | re.ASCII,
)
_LONG = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
_AT = re.compile(r"(?<![A-Za-z0-9._%+'-])[A-Za-z0-9._%+'-]*@[A-Za-z0-9.-]*")  # tried once a run, so long runs take linear time
_DIGIT = re.compile(r"[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$|\d{1,2}:\d{2}(:\d{2})?$")
_HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
_KEYED = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk[_-]|xox[abp]-|AIza|eyJ)")
_WORDS = re.compile(r"[a-z_]+")

#: Gazetteers: top-level domains, calling codes, card issuer prefixes and names of secrets.
TLDS = frozenset("com org net edu gov io de fr es it uk eu info biz co us ca ch at nl be se no dk fi pl pt ru cn jp in br au nz mx ar example test".split())
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "38", "60", "62", "64", "65", "22", "23", "24", "25", "26", "27")
SECRETS = frozenset("token key apikey api_key secret password passwd pwd auth bearer access_key private_key credential".split())
NEAR = {
    "email": frozenset("mail email contact write reach an at".split()),
    "phone": frozenset("phone call tel telephone mobile fax cell number dial whatsapp".split()),
    "ip": frozenset("ip address host server from login client addr".split()),
    "card": frozenset("card visa mastercard credit debit payment amex".split()),
    "ssn": frozenset("ssn social security".split()),
    "iban": frozenset("iban bank account transfer".split()),
    "secret": SECRETS,
    "number": frozenset(),
}
AGAINST = frozenset("version v page chapter section isbn doi rfc line figure table no nr".split())


def entropy(s: str) -> float:
    """Bits per character."""
    counts = [s.count(c) for c in set(s)]
    return -sum(c / len(s) * math.log2(c / len(s)) for c in counts)


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((2 * int(c)) // 10 + (2 * int(c)) % 10 for c in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every span that might be personal or secret, in order, none within another."""
    found = []
    if "@" in text:
        for m in _AT.finditer(text):
            s, e = m.span()
            e -= len(m[0]) - len(m[0].rstrip(".-"))
            s += len(m[0]) - len(m[0].lstrip(".'%+-"))
            if e - s > 2:
                found.append((s, e, "email"))
    if _DIGIT.search(text):
        found += [(*m.span(), m.lastgroup) for m in _NUMBERS.finditer(text)]
        found += [(*m.span(), "secret") for m in _LONG.finditer(text) if _DIGIT.search(m[0])]
    found.sort(key=lambda c: (c[0], -c[1]))
    out, end = [], -1
    for c in found:
        if c[0] >= end:
            out.append(c)
            end = c[1]
    return out


def _shape(kind: str, s: str, before: str) -> int:
    """Regex labeler: is the span written the way its kind is?"""
    if kind == "email":
        return 1 if _EMAIL.match(s) else -1
    if kind == "ip":
        return 1 if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split(".")) else -1
    if kind == "phone":
        return 1 if 8 <= len(_digits(s)) <= 15 else -1
    if kind == "card":
        return 1 if 13 <= len(_digits(s)) <= 19 else -1
    if kind == "ssn":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    if kind == "secret":
        return 1 if _HEX.match(s) or _KEYED.match(s) else 0
    return 1 if kind == "iban" else -1


def _gazetteer(kind: str, s: str, before: str) -> int:
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in TLDS else -1
    if kind == "phone":
        d = _digits(s)
        return 1 if s[0] != "+" or any(d[:n] in CODES for n in (1, 2, 3)) else -1
    if kind == "card":
        return 1 if s.startswith(ISSUERS) else 0
    if kind == "secret":
        return 1 if SECRETS & set(_WORDS.findall(before)) else 0
    return 0


def _context(kind: str, s: str, before: str) -> int:
    words = set(_WORDS.findall(before)[-3:])
    return 1 if words & NEAR[kind] else -1 if words & AGAINST else 0


def _check(kind: str, s: str, before: str) -> int:
    """Check digits and randomness."""
    if kind == "card":
        return 1 if luhn(_digits(s)) else 0
    if kind == "secret":
        return 1 if entropy(s) > 3.2 else -1
    return 0


def _dull(kind: str, s: str, before: str) -> int:
    """Dates, decimals and filler are not personal."""
    d = _digits(s)
    if kind in ("number", "ip") and (_DATE.match(s) or before.endswith(("v", "version ", "$", "€"))):
        return -1
    return -1 if kind != "email" and kind != "secret" and len(set(d)) <= 2 else 0


def _separators(kind: str, s: str, before: str) -> int:
    if kind == "phone":
        return 1 if s[0] in "+(" else 0
    if kind == "number":
        return -1 if set(s) & set(".,/:") else 0
    if kind == "email":
        return 1 if s.count("@") == 1 and s[0] != "@" and s[-1] != "@" else -1
    return 0


LABELERS: tuple[Callable[[str, str, str], int], ...] = (_shape, _gazetteer, _context, _check, _dull, _separators)
KINDS = tuple(NEAR)


def _scan(batches):
    for batch in batches:
        doc_ids = T.ids(batch.column("doc_id"))
        rows = []
        for i, text in enumerate(pc.fill_null(batch.column("text"), "").to_pylist()):
            for s, e, kind in candidates(text):
                rows.append((i, s, e, kind, vote_pattern(kind, text[s:e], text[max(0, s - 32) : s].lower())))
        if rows:
            at, s, e, kind, votes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([T.id_array(doc_ids[list(at)]), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(kind), pa.array(votes)], names=["doc_id", "start_char", "end_char", "kind", "votes"])


def vote_pattern(kind: str, span: str, before: str) -> str:
    """One character per labeler (``+``, ``-`` or ``0``), then the classifier's other features: length class and share of digits."""
    votes = "".join("-0+"[f(kind, span, before) + 1] for f in LABELERS)
    return votes + "sml"[(len(span) > 12) + (len(span) > 24)] + str(min(4, 5 * len(_digits(span)) // len(span)))


class SpanModel:
    """Reliabilities of the labelers by expectation maximisation, and the classifier trained on the posteriors.

    Input is the number of candidates for every kind and vote pattern, over the whole corpus.
    """

    def __init__(self, patterns: list[tuple[str, str, int]], rounds: int = 60):
        patterns = sorted(patterns)
        n = np.array([float(c) for _, _, c in patterns])
        v = np.array([["-0+".index(c) - 1 for c in p[: len(LABELERS)]] for _, p, _ in patterns]).reshape(len(patterns), len(LABELERS))
        kind = np.array([KINDS.index(k) for k, _, _ in patterns], int)
        q = 1 / (1 + np.exp(-2.0 * v.sum(axis=1)))
        for _ in range(rounds):
            # a labeler's chance of voting + if the span is PII (right) and if it is not (wrong); an abstention says nothing
            self.right, self.wrong = (np.array([(4 * a + (n * w)[v[:, j] == 1].sum()) / (4 + (n * w)[v[:, j] != 0].sum()) for j in range(len(LABELERS))]) for w, a in ((q, 0.8), (1 - q, 0.2)))
            self.prior = np.array([(1 + (n * q)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
            up = (v == 1) @ np.log(self.right / self.wrong) + (v == -1) @ np.log((1 - self.right) / (1 - self.wrong))
            q = 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior))[kind] + up)))
        self.posterior = q
        x = np.array([self.features(k, p) for k, p, _ in patterns]).reshape(len(patterns), len(self.features(KINDS[0], "0" * len(LABELERS) + "s0")))
        self.w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps on the soft labels, with a small ridge
            p = 1 / (1 + np.exp(-x @ self.w))
            h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(self.w))
            self.w = self.w + np.linalg.solve(h, x.T @ (n * (q - p)) - self.w)

    @staticmethod
    def features(kind: str, pattern: str) -> list[float]:
        votes = [f for c in pattern[: len(LABELERS)] for f in (c == "+", c == "-")]
        return [1.0, *map(float, votes), *(float(kind == k) for k in KINDS), *(float(pattern[-2] == c) for c in "sml"), float(pattern[-1]) / 4]

    def probability(self, kind: str, pattern: str) -> float:
        return float(1 / (1 + np.exp(-np.dot(self.features(kind, pattern), self.w))))


def fit(found: DataFrame) -> SpanModel:
    """The model for candidates ``found``: their patterns are counted in Spark, and only these counts (a few hundred at most: the votes
    of six labelers, eight kinds, fifteen feature cells) come to the driver."""
    return SpanModel([(r.kind, r.votes, r["count"]) for r in found.groupBy("kind", "votes").count().collect()])


def _decide(model: SpanModel):
    known: dict[tuple[str, str], float] = {}

    def probability(kind: str, votes: str) -> float:
        p = known.get((kind, votes))
        if p is None:
            p = known[kind, votes] = round(model.probability(kind, votes), 6)
        return p

    return probability


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Personal and secret spans: ``(doc_id, start_char, end_char, kind, probability)``, offsets in characters, the end exclusive.

    Candidates come from broad patterns over the whole text. Six labelers (regex, gazetteer, context, check
    digits and entropy, dull numbers, separators) vote for, against or not at all; EM over the counts of all vote patterns of the corpus
    estimates how reliable each is; a logistic classifier over votes, kind and shape is trained on the resulting posteriors
    and keeps spans with a probability of at least ``threshold``. Of overlapping candidates the first and longest counts.

    Null and empty texts have no span; texts of any length are scanned whole, in time that grows with their length; repeated rows give their spans
    again; a null doc_id stays null; other columns are ignored. An empty table gives no rows.
    """
    found = cut(docs.select("doc_id", "text").mapInArrow(_scan, "doc_id bigint, start_char int, end_char int, kind string, votes string"))
    probability = _decide(fit(found))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            p = np.array([probability(k, v) for k, v in zip(b.column("kind").to_pylist(), b.column("votes").to_pylist(), strict=True)])
            keep = pa.array(p >= threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start_char", "end_char", "kind")), pa.array(p, pa.float64())], names=["doc_id", "start_char", "end_char", "kind", "probability"]).filter(keep)

    return found.mapInArrow(run, "doc_id bigint, start_char int, end_char int, kind string, probability double")


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of :func:`find` replaced by its kind in angle brackets, and ``n_chars``, if there is one, counted anew in the rows that change.

    All rows stay, in any batch alike; other columns stay as they are, and rows without a span wholly so: those with a null or empty text, too.
    Texts of any length are scanned whole, in time that grows with their length, twice: once to fit and once to redact. Repeated rows are redacted alike; an
    empty table stays empty; columns may have any other names.
    """
    found = cut(docs.select("doc_id", "text").mapInArrow(_scan, "doc_id bigint, start_char int, end_char int, kind string, votes string").select("kind", "votes"))
    probability = _decide(fit(found))
    drop_scratch(found)
    names, schema = docs.columns, docs.schema
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, changed = b.column(text_at).to_pylist(), np.zeros(b.num_rows, bool)
            for i, text in enumerate(texts):
                spans = [(s, e, k) for s, e, k in candidates(text or "") if probability(k, vote_pattern(k, text[s:e], text[max(0, s - 32) : s].lower())) >= threshold]
                if spans:
                    changed[i], parts, at = True, [], 0
                    for s, e, k in spans:
                        parts += [text[at:s], f"<{k.upper()}>"]
                        at = e
                    texts[i] = "".join(parts) + text[at:]
            columns = list(b.columns)
            if changed.any():
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if size_at is not None:
                    old = columns[size_at]
                    columns[size_at] = pc.if_else(pa.array(changed), pc.utf8_length(columns[text_at]).cast(old.type), old)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def op10_pii(spark, sf_dir):
    """Personal and secret spans of the whole documents table."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
