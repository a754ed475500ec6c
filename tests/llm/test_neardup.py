import random
import re
from collections import Counter

import numpy as np
import pytest

from gridlens.llm import dart, neardup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs):
    """Least id of each document's component."""
    sets = [shingles(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum((a & sets[j]).values())
            if both and both >= 0.8 * (sum(a.values()) + sum(sets[j].values()) - both):
                top[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: least[find(k)] for k, (d, _) in enumerate(docs)}


def variants(seed, n, edits, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


def test_groups_of_variants(spark):
    texts = [t for s, n, e in [(1, 60, 8), (2, 40, 3), (3, 5, 2), (4, 2, 1), (5, 30, 14)] for t in variants(s, n, e)]
    texts += [f"short {k} text" for k in range(5)] + ["same words here", "same  words\nhere", "", " ", None, "same words here"]
    random.Random(9).shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, node string")
    want = brute(docs)
    for chunk in (7, 512):
        assert {r.id: r.class_id for r in N.classes(df, chunk=chunk).collect()} == want
    assert {r.id: r.class_id for r in N.classes(df, chunk=7, slack=None).collect()} == want
    kept = N.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert kept[0].node == "clash"


def test_steps_stay_in_proportion(spark, monkeypatch):
    """No step is dealt out in pieces of few rows, and what blocks find goes through components by component, not by document."""
    files, asked = {}, []

    def stored(df, name, **how):
        out = kept(df, name, **how)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    def components(links):
        asked.append(links.count())
        return joined(links)

    kept, joined = N.stored, N.components
    monkeypatch.setattr(N, "stored", stored)
    monkeypatch.setattr(N, "components", components)
    texts = [t for s in range(20, 24) for t in variants(s, 120, 20, 240)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        got = {r.id: r.class_id for r in N.classes(df, chunk=16).collect()}
    finally:
        for key in small:
            spark.conf.unset(key)
    assert got == brute(docs)
    assert len(asked) == 2 and asked[1] < asked[0] / 2
    most = max(4, df.rdd.getNumPartitions())
    assert {name: n for name, n in files.items() if name != "links" and n > most} == {}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for weights in ([1.0], [1.0, 2.0, 3.0, 7.0], [0.3, 0.5, 2.5]):
        a = {k: rng.choice(weights) for k in range(300)}
        b = {k: rng.choice(weights) for k in range(100, 420)}
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        values = np.array([*a, *b], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sig = dart.signatures(values, np.array([*a.values(), *b.values()]), np.array([0, len(a), len(a) + len(b)]), 4000)
        assert np.mean(sig[0] == sig[1]) == pytest.approx(want, abs=0.035)
    assert (dart.signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0]), 8) == 0).all()


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(2)
    values, weights = rng.integers(1, 2**63, 900).astype(np.uint64), rng.integers(1, 4, 900).astype(float)
    first = np.array([0, 3, 3, 400, 401, 900])
    together = dart.signatures(values, weights, first, 32)
    for d in range(5):
        a, b = first[d], first[d + 1]
        assert (dart.signatures(values[a:b], weights[a:b], np.array([0, b - a]), 32)[0] == together[d]).all()


def test_odd_rows(odd, odd_rows, empty):
    rows = N.classes(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {(r.id, r.class_id) for r in rows}
    assert (None, None) in by and (3, None) in by  # "one" without an id is the least of its class
    assert (0, 0) in by and (1, 1) in by and (2, 2) in by
    assert len(N.keep_one(odd).collect()) == len(odd_rows) - 3
    assert N.classes(empty).collect() == [] and N.keep_one(empty).collect() == []


def test_components(spark):
    chain = [(bytes([k]), bytes([k + 1])) for k in range(0, 60)] + [(bytes([200]), bytes([201])), (bytes([100]), bytes([100]))]
    rows = N.components(spark.createDataFrame(chain, "a binary, b binary")).collect()
    assert {(r.node[0], r.comp[0]) for r in rows} == {(k, 0) for k in range(61)} | {(200, 200), (201, 200), (100, 100)}


def test_query(spark, sf, documents):
    docs = [(d.doc_id, d.text) for d in documents.collect()]
    assert {r.doc_id: r.class_id for r in N.op2_near_duplicates(spark, sf).collect()} == brute(docs)
