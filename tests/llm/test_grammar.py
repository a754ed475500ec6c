import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridlens.llm import grammar as G


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(2, 5))
def test_round_trip(docs, least):
    ids = np.array([x for d in docs for x in d], np.uint32)
    ends = np.cumsum([len(d) for d in docs])
    seq, rules, sizes, at = G.compress(ids, ends, least)
    shard = G.Shard(G.pack(int(ids.max()) + 1, seq, rules, sizes))
    assert shard.all().tolist() == ids.tolist()
    for k, d in enumerate(docs):
        assert shard.document(at[k], at[k + 1] if k + 1 < len(at) else None).tolist() == d
    assert shard.widths().sum() == len(ids)
    for a, b in [(0, len(ids)), (len(ids) // 3, len(ids) // 2 + 1), (len(ids) - 1, len(ids))]:
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()


def test_repeats_shrink():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    seq, rules, _, _ = G.compress(ids, np.array([len(ids)]))
    assert len(seq) + 2 * len(rules) < len(ids) / 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=200), min_size=1, max_size=4))
def test_goes_on_while_a_pair_pays(docs):
    """In what is left no pair stands ``MIN_COUNT`` times (without overlaps) inside documents."""
    ids, ends = np.array([x for d in docs for x in d], np.uint32), np.cumsum([len(d) for d in docs])
    seq, _, _, at = G.compress(ids, ends)
    seen = {}
    for a, b in zip(at, [*at[1:], len(seq)], strict=True):
        part, k = seq[a:b].tolist(), 0
        last = {}
        for k, pair in enumerate(zip(part, part[1:], strict=False)):
            if last.get(pair) != k - 1:
                seen[pair] = seen.get(pair, 0) + 1
                last[pair] = k
    assert max(seen.values(), default=0) < G.MIN_COUNT


def test_counts_whole_shard_once_at_least_count(monkeypatch):
    """What is left near the end is found among places that stood often enough before, not by counting all of the shard again."""
    floors, count = [], G._frequent

    def counted(*args):
        out = count(*args)
        floors.append(out[3])
        return out

    monkeypatch.setattr(G, "_frequent", counted)
    rng = np.random.default_rng(6)
    passages = [rng.zipf(1.3, 40) % 3000 for _ in range(300)]
    ids = np.concatenate([*(passages[k] for k in rng.integers(0, 300, 900)), rng.zipf(1.3, 60_000) % 3000]).astype(np.uint32)
    seq, rules, sizes, _ = G.compress(ids, np.arange(40, len(ids) + 1, 40))
    assert G.Shard(G.pack(int(ids.max()) + 1, seq, rules, sizes)).all().tolist() == ids.tolist()
    assert floors.count(G.MIN_COUNT) == 1


def test_passages_of_equal_counts_take_few_levels():
    """Pairs of one passage stand equally often; the passage still becomes one id in about as many levels as doublings."""
    ids = np.tile(np.arange(4096, dtype=np.uint32), 8)
    seq, rules, sizes, _ = G.compress(ids, np.arange(4096, len(ids) + 1, 4096))
    assert len(seq) == 8 and len(rules) == 4095
    depth = {}
    for k, (a, b) in enumerate(rules.tolist()):
        depth[4096 + k] = 1 + max(depth.get(a, 0), depth.get(b, 0))
    assert max(depth.values()) < 40


def test_query(spark, sf, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    rows = {r.doc_id: r for r in G.op6_token_files(spark, sf).collect()}
    for d in sorted(documents.collect(), key=lambda d: d.doc_id):
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (rows[d.doc_id].start, rows[d.doc_id].n_tokens) == (start, len(ids))
        assert rows[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_small_shards_odd_rows(spark, odd, odd_rows, empty, tmp_path):
    G.write_tokens(odd, str(tmp_path / "t"), shard_ids=50)
    got = G.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    G.write_tokens(empty, str(tmp_path / "e"))
    assert G.read_tokens(spark, str(tmp_path / "e")).collect() == []
