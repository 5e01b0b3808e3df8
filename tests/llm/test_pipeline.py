"""The pipeline stage by stage against brute force."""

import itertools
from collections import Counter

import numpy as np
from test_methods import _buffer, _components, _jaccard_sets

import corpus_pipeline
from graphlake.llm import langid, minhash, mixing, packing, pii
from graphlake.session import cut


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, states = dict(corpus_pipeline.STAGES), [docs]
    assert list(stages) == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    for f in stages.values():
        states.append(cut(f(spark, states[-1], sf)))
    assert all(s.columns == docs.columns for s in states[:-1])
    raw, known, single, clean, mixed, packed = states

    net = langid.train(raw)
    rows = raw.collect()
    data, offs = _buffer([r.text for r in rows])
    keep = langid.known(net.documents(data, offs)[0]) & (np.diff(offs) > 0)
    assert _rows(known) == Counter(tuple(r) for r, k in zip(rows, keep, strict=True) if k)

    by = {r.doc_id: r for r in known.collect()}
    sets = _jaccard_sets(by)
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]]
    tight, loose = (_components(sets, [(a, b) for a, b, j in pairs if j >= t]) for t in (0.6, 0.4))
    left = {r.doc_id for r in single.collect()}
    assert set(loose.values()) <= left <= set(tight.values())  # every group keeps its least id, all else is kept
    assert _rows(single) == Counter(tuple(by[i]) for i in left)

    found = {}
    for r in pii.find(single).collect():
        found.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.kind))
    want = Counter()
    for r in single.collect():
        text = r.text
        for s, e, k in sorted(found.get(r.doc_id, []), reverse=True):
            text = text[:s] + f"<{k.upper()}>" + text[e:]
        want[(r.doc_id, text, r.lang, r.source, len(text) if r.doc_id in found else r.n_chars)] += 1
    assert _rows(clean) == want and len(found) > 3

    slots = mixing.mixture(clean).where("start_token = 0").toPandas()
    times = slots.groupby("doc_id").slot.nunique().to_dict()
    assert _rows(mixed) == Counter({tuple(r): times[r.doc_id] for r in clean.collect()})

    m = mixed.collect()
    data, offs = _buffer([r.text for r in m])
    key, n = packing.curve_keys(data, offs)
    at, pieces = 0, Counter()
    for _, doc, size in sorted((k, r.doc_id, s) for k, r, s in zip(key.tolist(), m, n.tolist(), strict=True) if s):
        for p in range(at // packing.CAPACITY, (at + size - 1) // packing.CAPACITY + 1):
            lo, hi = max(at, p * packing.CAPACITY), min(at + size, (p + 1) * packing.CAPACITY)
            pieces[p, lo - p * packing.CAPACITY, doc, hi - lo] += 1
        at += size
    assert Counter((r.pack_id, r.position, r.doc_id, r.n_tokens) for r in packed.collect()) == pieces


def test_dedup_keeps_clean_documents(spark):
    docs = spark.createDataFrame([(i, f"document {i} " + " ".join(f"w{i}x{k}" for k in range(50)), "en", "s", 1) for i in range(100)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert minhash.drop_near_duplicates(docs).count() == 100
