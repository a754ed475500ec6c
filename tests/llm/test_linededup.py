import random
from collections import defaultdict

import pytest

import corpus_pipeline as C
from gridlens.llm import blocks as B, linededup as L


def brute(rows, min_docs, keep_first=False):
    """Rows of (order, text) to texts without lines of recurring templates, in plain Python."""
    lines = [[] if t is None else [(line, [None if any(c.isdigit() and c.isascii() for c in w) else w for w in line.split()]) for line in t.split("\n")] for _, t in rows]
    leaf = lambda m: (len(m), *m[:3])
    leaves, places, templates = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, doc in enumerate(lines):
        for _, m in doc:
            if m:
                leaves[leaf(m)].add(d)
    big = {k for k, v in leaves.items() if len(v) >= min_docs}
    for d, doc in enumerate(lines):
        for _, m in doc:
            if m and leaf(m) in big:
                for p, w in enumerate(m[3:]):
                    places[leaf(m), p, w].add(d)

    def all_templates(m):
        """From the most special to the most general."""
        out, least = [], min_docs
        while m and leaf(m) in big and least <= 2 * min_docs * len(rows):
            rest = [w if w is not None and len(places[leaf(m), p, w]) >= least else None for p, w in enumerate(m[3:])]
            if sum(w is not None for w in [*m[:3], *rest]) >= 0.5 * len(m):
                out.append((leaf(m), tuple(rest)))
            least *= 2
        return out

    for d, doc in enumerate(lines):
        for _, m in doc:
            for t in all_templates(m):
                templates[t].add(d)
    rank = [float("inf") if o is None else o for o, _ in rows]
    first = {t: min(rank[d] for d in v) for t, v in templates.items() if len(v) >= min_docs}

    def stays(d, m):
        known = [t for t in all_templates(m) if t in first]
        return not known or (keep_first and first[known[-1]] == rank[d])

    return [None if rows[d][1] is None else "\n".join(line for line, m in doc if stays(d, m)) for d, doc in enumerate(lines)]


def test_templates(spark):
    rows = [(k, f"own line number {'abcdefghij'[k % 10] * (k + 1)} here\nPosted by user{k} on site {k}\nsee the full {['red', 'green', 'blue', 'grey', 'pink'][k % 5]} list of our terms\nMenu\nend of it") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.drop_recurring(df, min_docs=5, keep_first=True).collect()}
    assert [got[k] for k in range(12)] == brute(rows, 5, True)
    for start in ("Posted by", "see the full", "Menu"):  # fields with digits, a varying word, a line of one word
        assert start in got[0] and start not in got[3]
    none = [r.text for r in L.drop_recurring(df, min_docs=5).orderBy("doc_id").collect()]
    assert none == brute(rows, 5) and not any("Posted by" in t for t in none)
    short = L.drop_recurring(df, min_docs=5, min_tokens=2).collect()
    assert all("Menu" in r.text for r in short)


def test_random_texts(spark):
    rng = random.Random(7)
    words = ["a", "b", "c1", "d", "é", "77"]
    rows = [(rng.choice([None, *range(60)]), "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 12)))) for _ in range(150)]
    rows = [*rows, (3, None), (4, ""), rows[5], rows[5]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id long, text string")
    for min_docs, keep_first in ((2, True), (2, False), (6, True), (15, False)):
        got = {r.k: r.text for r in L.drop_recurring(df, min_docs=min_docs, block_bytes=400, keep_first=keep_first).collect()}
        assert [got[k] for k in range(len(rows))] == brute(rows, min_docs, keep_first)


def test_blocks_added_up_in_a_tree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(6))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(B, "FAN", 3)
    got = [r.text for r in L.drop_recurring(df, min_docs=4, block_bytes=300, keep_first=True).orderBy("doc_id").collect()]
    assert got == brute(rows, 4, True)


def test_order_of_text_is_refused(spark):
    with pytest.raises(ValueError, match="integers"):
        L.drop_recurring(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_odd_rows(odd, odd_rows, empty):
    rows = L.drop_recurring(odd).collect()
    assert len(rows) == len(odd_rows)
    assert sorted((r.text is not None, r.text or "") for r in rows) == sorted((t is not None, t or "") for t in brute([(r[0], r[1]) for r in odd_rows], L.MIN_DOCS))
    assert rows[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "block", "row", "kept_text", "text", "n_lines", "n_dropped", "dropped"}
    assert L.drop_recurring(empty).collect() == []


@pytest.mark.parametrize("n", [12, 500, 20_000])
def test_general_templates_of_any_leaf_size(spark, n):
    rng = random.Random(n)
    rows = [(k, f"order shipped from the shop of {'name'}{_letters(rng.randrange(200))} in city{_letters(rng.randrange(100))} today") for k in range(n)]
    # a template of few documents in the same leaf, and one line of prose
    rows += [(n + k, f"order shipped from a depot at gate of{_letters(k)} harbour road") for k in range(15)] + [(n + 15, "order shipped from one that nobody else has ever seen")]
    got = {r.doc_id: r.n_dropped for r in L.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).collect()}
    assert [k for k in range(n) if not got[k]] == [0]
    assert [k for k in range(n, n + 16) if not got[k]] == [n, n + 15]


def _letters(k):
    return chr(97 + k // 26) + chr(97 + k % 26)


def test_repeated_long_lines(spark, tmp_path):
    passage = " ".join(f"w{_letters(k)}" for k in range(60))
    own = lambda k: " ".join(f"own{_letters(k)}{_letters(j)}" for j in range(300))
    rows = [(k, f"{own(k)}\n{passage if k % 2 else passage.replace(' ', '  ')}\nin short\n{passage[:120]}") for k in range(3)]
    rows += [(3, f"{own(3)}\n{passage} more"), (None, passage), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.dropped, r.text) for r in L.drop_repeated(df, block_bytes=300).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: [], 1: [1], 2: [1], 3: [], None: [0], 4: [], 5: []}
    assert got[1][1] == rows[1][1].replace(passage + "\n", "") and got[4][1] is None
    staged = {r.doc_id: r.text for r in C.near_dedup(spark, C.line_dedup(spark, df.where("doc_id < 4"), ""), "").collect()}
    assert [passage in staged[k].replace("  ", " ") for k in range(4)] == [True, False, False, True]
