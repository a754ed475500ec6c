import re
import struct
from collections import defaultdict
from fractions import Fraction

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from gridlens.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_seats_match_highest_quotients(votes, seats):
    want = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        k = max(range(len(votes)), key=lambda k: (Fraction(votes[k], 2 * want[k] + 1), -k))
        want[k] += 1
    assert M.sainte_lague(votes, seats) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    goals = M.targets(sizes, weights)
    assert sum(goals) == sum(sizes)
    assert all(g <= 3 * s for g, s in zip(goals, sizes, strict=True))
    free = {g / w for g, w, s in zip(goals, weights, sizes, strict=True) if g < 3 * s}
    assert len(free) <= 1
    assert all(3 * s / w <= u for s, w, g in zip(sizes, weights, goals, strict=True) for u in free if g == 3 * s)


def check(rows, docs):
    sizes = defaultdict(int)
    for text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, M.targets([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(goals[r.source]))
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.rounds * r.size + sum(b - a for a, b in r.parts)
        assert all(0 <= a < b <= r.size for a, b in r.parts)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - goals[s]) <= max(8, 0.03 * goals[s]), s


def test_documents(documents):
    docs = [(r.text, r.source) for r in documents.collect()]
    rows = M.quotas(documents, order="doc_id").collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    again = M.quotas(documents.repartition(7), order="doc_id").collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_taken_words(documents):
    mixed = M.quotas(documents, order="doc_id", carry_text=True)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    words = defaultdict(int)
    for r in M.take(mixed).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_odd_rows(odd, odd_rows, empty):
    check(M.quotas(odd, order="doc_id").collect(), [(r[1], r[3]) for r in odd_rows])
    assert M.quotas(empty, order="doc_id").collect() == []


def test_many_shards(documents, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 40)
    check(M.quotas(documents, order="doc_id").collect(), [(r.text, r.source) for r in documents.collect()])


def spark_hash(*values):
    """Spark's xxhash64 of ints (4 bytes), longs and strings, as a signed integer."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def seats_one_by_one(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        some = [k for k in range(len(votes)) if votes[k] and out[k] < most[k]]
        if not some:
            break
        out[max(some, key=lambda k: (Fraction(votes[k]) / (2 * out[k] + 1), -k))] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=8), st.integers(0, 60))
def test_seats_with_room(shards, seats):
    votes, most = [v for v, _ in shards], [m for _, m in shards]
    assert M.sainte_lague(votes, seats, most) == seats_one_by_one(votes, seats, most)


def by_hand(docs, shard_rows, fan):
    """What the mix takes of (id, text, source), step by step in plain Python."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    order = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    sums = [sum(n for n, d in zip(size, docs, strict=True) if d[2] == s) for s in order]
    goals = M.targets(sums, [1 + k % 3 for k in range(len(order))])
    total = sum(sums)
    block = max(1, min(1024, total // 200_000, int(min((g for g in goals if g), default=1) / 64)))
    blocks = seats_one_by_one(goals, round(total / block), [total] * len(goals))
    taken = [0] * len(docs)
    for number, s in enumerate(order):
        mine = [k for k, d in enumerate(docs) if d[2] == s]
        n = max(1, -(-len(mine) // shard_rows))
        marks = {k: spark_hash(("s", docs[k][1])) for k in mine}
        shards = defaultdict(list)
        for k in mine:
            shards[spark_hash(("i", M.SEED + 1), ("q", marks[k]), ("q", docs[k][0])) % n].append(k)
        words = {x: sum(size[k] for k in v) for x, v in shards.items()}

        def deal(names, seats, over, depth):
            """Blocks of each shard below a node, from the children of the node down."""
            kids = sorted({x // fan**depth for x in names})
            inside = [[x for x in names if x // fan**depth == c] for c in kids]
            given = seats_one_by_one([sum(words[x] for x in v) for v in inside], seats, [sum(3 * words[x] // block for x in v) for v in inside])
            over = over or sum(given) < seats
            if not depth:
                return {c: (g, over) for c, g in zip(kids, given, strict=True)}
            return {x: q for v, g in zip(inside, given, strict=True) for x, q in deal(v, g, over, depth - 1).items()}

        depth = 0
        while max(-(-sum(d[2] == o for d in docs) // shard_rows) for o in order) > fan ** (depth + 1):
            depth += 1
        for x, (quota, over) in deal(sorted(shards), blocks[number], False, depth).items():
            ring = sorted(shards[x], key=lambda k: (spark_hash(("i", M.SEED), ("q", marks[k]), ("q", docs[k][0])), docs[k][0], marks[k]))
            cells = [k for k in ring for _ in range(size[k])]
            if cells:
                want = 3 * len(cells) if over else quota * block
                at = spark_hash(("i", M.SEED + 2), ("i", number), ("q", x)) % max(1, -(-len(cells) // block)) * block
                for j in range(want):
                    # whole rounds need no start; the rest is a run from the seeded block on
                    taken[cells[(at + j) % len(cells)]] += 1
    return {d[0]: t for d, t in zip(docs, taken, strict=True)}


@pytest.mark.parametrize(("rows", "fan"), [(1 << 10, 1 << 10), (4, 3)])
def test_query_by_hand(spark, sf, documents, monkeypatch, rows, fan):
    monkeypatch.setattr(M, "SHARD_ROWS", rows)
    monkeypatch.setattr(M, "FAN", fan)
    want = by_hand([(r.doc_id, r.text, r.source) for r in documents.collect()], rows, fan)
    assert {r.doc_id: r.taken for r in M.op8_source_mix(spark, sf).collect()} == want


def test_keep_without_source_and_too_many_sources(documents, monkeypatch):
    rows = M.quotas(documents, keep=["doc_id"], order="doc_id").collect()
    assert "source" not in rows[0].asDict() and len(rows) == documents.count()
    monkeypatch.setattr(M, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        M.quotas(documents)
