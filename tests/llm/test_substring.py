import hashlib
import random
import re
from collections import Counter

import pytest

from gridlens.llm import substring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8])
def test_random_texts(spark, length):
    rng = random.Random(length)
    texts = [" ".join(rng.choice("ab é c\n日\t x".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts += [texts[0], None, "", " "] + ["q w e r t y u i o p " * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.repeats(df, min_words=length, block_bytes=300).orderBy("doc_id").collect()
    for (n, gone, kept), r in zip(brute(texts, length), rows, strict=True):
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept)
        assert sum(b - a for a, b in r.spans) == gone
        assert (r.longest > 0) == (gone > 0)


def test_longest(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(base[200:2200])), (2, " ".join(f"v{k}" for k in range(500))), (3, "x y " + " ".join(base[:40]))], "doc_id long, text string")
    got = {r.doc_id: r for r in S.repeats(df).collect()}
    assert got[1].longest == 35 * 32  # the longest doubling of 35 in 2000 words
    assert got[0].longest == got[1].longest
    assert (got[2].longest, got[2].n_removed) == (0, 0)
    assert (got[3].longest, got[3].n_removed, got[3].kept_text) == (35, 40, "x y")


def test_odd_rows(odd, odd_rows, empty):
    rows = S.repeats(odd).collect()
    want = sorted(((r[0] is not None, r[0] or 0), *b) for r, b in zip(odd_rows, brute([r[1] for r in odd_rows], 35), strict=True))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_text) for r in rows) == want
    assert S.repeats(empty).collect() == []


def test_query(spark, sf, documents):
    docs = documents.collect()
    want = {d.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, brute([d.text for d in docs], 35), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in S.op1_substring_dedup(spark, sf).collect()} == want


def test_longest_just_over_a_level(spark):
    rows, want = [], {}
    for k, (r, longest) in enumerate([(34, 0), (35, 35), (69, 35), (70, 70), (71, 70), (139, 70), (140, 140), (279, 140), (280, 280)] * 3):
        shared = " ".join(f"s{k}w{j}" for j in range(r))
        rows += [(2 * k, f"{shared} " + " ".join(f"a{k}w{j}" for j in range(300))), (2 * k + 1, " ".join(f"b{k}w{j}" for j in range(200)) + f" {shared}")]
        want |= {2 * k: longest, 2 * k + 1: longest}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.longest for r in S.repeats(df, block_bytes=4000).collect()} == want


def test_blocks_added_up_in_a_tree(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(S.B, "FAN", 3)
    rows = S.repeats(df, min_words=6, block_bytes=300).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in rows] == brute(texts, 6)


def test_plan_does_not_grow_with_the_longest_text(spark):
    def exchanges(words):
        rows = [(0, " ".join(f"w{k}" for k in range(words))), (1, "a " * 40)]
        plan = S.repeats(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange")

    assert exchanges(100) == exchanges(30_000) < 40


def test_copies_and_parts_of_them(spark):
    """Copies go on as one document: their length counts for all, and what others share with them too."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(k, " ".join(base)) for k in range(30)] + [(30, " ".join([*base[100:400], "x", "y"])), (31, " ".join(base[:20])), (32, "q " + " ".join(base[5:75]))]
    rows += [(33 + k, " ".join(f"v{j}" for j in range(60))) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for levels, want in ((None, {0: 560, 29: 560, 30: 280, 31: 0, 32: 70, 33: 35}), (1, {0: 70, 29: 70, 30: 70, 31: 0, 32: 70, 33: 35}), (0, {0: 35, 29: 35, 30: 35, 31: 0, 32: 35, 33: 35})):
        got = {r.doc_id: r for r in S.repeats(df, block_bytes=9000, levels=levels).collect()}
        assert {k: got[k].longest for k in want} == want
        assert all(got[k].n_removed == got[k].n_words for k in range(30)) and got[30].kept_text == "x y"
