"""Every operator and stage on messy and on empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from graphlake.llm import ann, hpylm, langid, lzprint, minhash, mixing, packing, pii, substring, toxicity

EXTRA = ("key", "n", "sid", "sig", "part", "uid", "kind", "votes", "slot", "block", "epoch", "n_tokens", "pack_id", "position", "_start", "_source", "_key", "_n", "_cell", "language", "keep", "group_id", "component", "count", "c0", "error", "toxic")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in EXTRA)
LONG = " ".join(f"word{i % 977} of the {i}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the green wood where it sleeps "


def _row(i, text, lang="en", source="s0", n=None):
    return (i, text, lang, source, len(text) if text and n is None else n, *("x" for _ in EXTRA))


MESSY = [
    _row(1, PROSE * 8),
    _row(1, PROSE * 8),  # a repeated row
    _row(2, PROSE * 8, source="s1"),  # a copy under another id
    _row(3, None),
    _row(4, ""),
    _row(5, " \n\t "),
    _row(None, "a text without an id, mail me at jo.doe@example.com please"),
    _row(None, None, None, None),
    _row(6, LONG, source=None),
    _row(7, "x", None, ""),
    _row(8, "y" * 300_000, "de"),  # one very long word
    _row(9, "Größe und Äpfel, der Hund und die Katze schlafen. " * 20, "de", None),
    _row(-9, "card 4111111111111111 or call +1 (212) 555-0100", "en", "s1"),
    _row(2**62, "é \U0001f600 \x00 zero byte", "fr"),
]
VECTOR_SCHEMA = "vec_id bigint, embedding array<float>, label int, shard int, part int, ids int, x string"


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(MESSY, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (-9, 0, 1), (6, 1, None), (None, 1, 1), (404, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_language(messy, empty):
    rows = langid.identify(messy, steps=40).collect()
    assert len(rows) == len(MESSY)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (3, 4):
        assert (by[i].language, by[i].probability, by[i].keep) == (None, 0.0, False)
    assert by[8].n_bytes == 300_000 and 0 <= by[8].n_agree <= 300_000
    kept = langid.keep_known(messy, steps=40)
    assert kept.columns == messy.columns and kept.where("text IS NULL OR text = ''").count() == 0 and kept.where("doc_id = 1").count() == 2
    assert langid.identify(empty).count() == 0 and langid.keep_known(empty).columns == empty.columns
    assert langid.keep_known(empty).count() == 0
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled).where("keep OR language IS NOT NULL").count() == 0


def test_mixing(messy, empty):
    m = mixing.mixture(messy, block=64)
    assert m.columns == ["slot", "source", "block", "epoch", "doc_id", "start_token", "end_token"]
    got = {r.doc_id for r in m.select("doc_id").distinct().collect()}
    assert got == {None, 1, 2, 6, 7, 8, 9, -9, 2**62}
    assert m.where("end_token <= start_token OR end_token - start_token > 64").count() == 0
    out = mixing.mixed_documents(messy, block=64)
    assert out.columns == messy.columns and out.where("n_tokens <> 'x'").count() == 0
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in MESSY}
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_lm(messy, empty):
    rows = hpylm.score(messy, burn_in=1, samples=1).collect()
    assert len(rows) == len(MESSY)
    for r in rows:
        assert (r.perplexity is None and r.log2_prob == 0) if r.n_bytes == 0 else (1 <= r.perplexity < 300 and r.log2_prob < 0)
    assert len({(r.n_bytes, r.log2_prob) for r in rows if r.doc_id == 1}) == 1
    assert hpylm.score(empty, burn_in=1, samples=1).count() == 0


def test_substring(messy, empty):
    rows = sorted(tuple(r) for r in substring.repeated_spans(messy).where("doc_id in (1, 2)").collect())
    n = len(PROSE.split()) * 8
    assert rows == [(1, 0, n, n), (1, 0, n, n), (2, 0, n, n)]
    assert substring.repeated_spans(messy).where("doc_id in (3, 4, 5, 7, 8)").count() == 0
    assert substring.repeated_spans(empty).count() == 0


def test_fingerprints(messy, empty):
    rows = lzprint.fingerprints(messy).collect()
    by = {r.doc_id: r for r in rows}
    assert None not in by and not {3, 4, 5} & set(by) and len([r for r in rows if r.doc_id == 1]) == 2
    assert by[1].group_id == by[2].group_id == 1 and by[1].group_size == 2 and by[6].group_size == 1
    assert lzprint.fingerprints(empty).count() == 0


def test_toxicity(spark, messy, empty, labels):
    out = toxicity.toxic_documents(messy, labels)
    assert out.columns == ["doc_id", "score", "n_windows", "n_toxic_windows", "max_gain"]
    assert out.where("doc_id in (3, 4, 5)").count() == 0
    assert toxicity.toxic_documents(empty, labels).count() == 0
    assert toxicity.toxic_documents(messy, labels.limit(0)).count() == 0


def test_neighbours(spark):
    rows = [(i, [float(i), 0.0, 1.0], 0, 0, 0, 0, "x") for i in range(30)]
    rows += [(3, [3.0, 0.0, 1.0], 0, 0, 0, 0, "x"), (None, [1.0, 1.0, 1.0], 0, 0, 0, 0, "x"), (40, None, 0, 0, 0, 0, "x"), (41, [1.0], 0, 0, 0, 0, "x"), (42, [1.0, None, 2.0], 0, 0, 0, 0, "x"), (43, [1.0, math.nan, 2.0], 0, 0, 0, 0, "x"), (44, [5.0, 0.0, 1.0], None, 0, 0, 0, "x"), (45, [], 0, 0, 0, 0, "x"), (46, [1.0, math.inf, 2.0], 0, 0, 0, 0, "x"), (47, [-math.inf, 0.0, 2.0], 0, 0, 0, 0, "x")]
    v = spark.createDataFrame(rows, VECTOR_SCHEMA)
    out = ann.neighbours(v, k=3, shard_rows=10).collect()
    by = {}
    for r in out:
        by.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    assert set(by) == {*range(30), 44}
    assert sorted(by[5])[0] == (1, 44, 0.0) and len(by[3]) == 3
    assert [x[1] for x in sorted(by[10])][:2] == [9, 11]
    assert ann.neighbours(v.limit(0)).count() == 0 and ann.neighbours(v, v.limit(0)).count() == 0
    some = ann.neighbours(v, v.where("vec_id IN (3, 5, 43, 46) OR vec_id IS NULL"), k=3, shard_rows=10).collect()
    assert sorted(tuple(r) for r in some) == sorted(tuple(r) for r in out if r.vec_id in (3, 5))
    one = ann.neighbours(v.where("vec_id in (1, 2)"), k=5).collect()
    assert sorted((r.vec_id, r.neighbour_id) for r in one) == [(1, 2), (2, 1)]


def test_packing(messy, empty):
    p = packing.packs(messy, capacity=100)
    assert {r.doc_id for r in p.select("doc_id").distinct().collect()} == {None, 1, 2, 6, 7, 8, 9, -9, 2**62}
    full = packing.packed_documents(messy, capacity=100)
    assert full.columns[:4] == ["pack_id", "position", "n_tokens", "text"] and "lang" in full.columns and "component" in full.columns
    assert full.agg(F.sum("n_tokens")).first()[0] == p.agg(F.sum(F.col("end_token") - F.col("start_token"))).first()[0]
    assert packing.packs(empty).count() == 0 and packing.packed_documents(empty).count() == 0


def test_minhash(messy, empty):
    rows = sorted(tuple(r) for r in minhash.near_duplicates(messy).collect())
    assert rows == [(1, 1, 2, True), (2, 1, 2, False)]
    left = minhash.drop_near_duplicates(messy)
    assert left.columns == messy.columns
    assert left.where("doc_id = 1").count() == 1 and left.where("doc_id = 2").count() == 0 and left.where("doc_id IS NULL").count() == 2
    assert left.count() == len(MESSY) - 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_pii(messy, empty):
    rows = pii.find(messy).collect()
    assert {(r.doc_id, r.kind) for r in rows} >= {(None, "email"), (-9, "card"), (-9, "phone")}
    out = pii.redact(messy)
    assert out.columns == messy.columns and out.count() == len(MESSY)
    got = {r.doc_id: r for r in out.where("doc_id in (-9, 3, 4, 6)").collect()}
    assert got[-9].text == "card <CARD> or call <PHONE>" and got[-9].n_chars == len(got[-9].text)
    assert got[3].text is None and got[4].text == "" and got[6].text == LONG and got[6].votes == "x"
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
