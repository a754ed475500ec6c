"""The pipeline's stages on the small tables, each on its predecessor's rows."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from test_linededup import brute as recurring
from test_mixing import check as check_mix
from test_neardup import brute as near
from test_quality import brute as measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    out["documents"] = docs
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "bpe_tokens"]
    for name, _ in C.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes
        assert all(r.n_chars == len(r.text) for r in stages[name].collect())


def test_quality_rules(stages, spark, sf):
    kept = {r.doc_id for r in stages["quality_rules"].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in stages["documents"].collect():
        m = measures(r.text)
        if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
            assert r.doc_id not in kept
        elif labels.get(r.doc_id) == 1:
            assert r.doc_id in kept


def test_line_dedup(stages):
    rows = sorted(((r.doc_id, r.text) for r in stages["quality_rules"].collect()))
    assert sorted(((r.doc_id, r.text) for r in stages["line_dedup"].collect())) == [(d, t) for (d, _), t in zip(rows, recurring(rows, 10, True), strict=True)]


def test_near_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages["line_dedup"].collect()]
    want = near(rows)
    empty = {d for d, t in rows if not WORD.search(t)}
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == sorted({want[d] for d, _ in rows} | empty)


def test_source_mix(stages, spark):
    before = {r.doc_id: r for r in stages["near_dedup"].collect()}
    got = defaultdict(list)
    for r in stages["source_mix"].collect():
        got[r.doc_id].append(r.text)
        assert r.text in before[r.doc_id].text
    from gridlens.llm import mixing

    rows = mixing.quotas(stages["near_dedup"], order="doc_id").collect()
    check_mix(rows, [(r.text, r.source) for r in before.values()])
    assert {r.doc_id: r.taken for r in rows if r.taken} == {d: sum(len(WORD.findall(t)) for t in texts) for d, texts in got.items()}


def test_bpe_tokens(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages["source_mix"].collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["bpe_tokens"].collect()) == want


def test_steps_are_removed(spark, sf):
    """Of all that a run stores, what the last stage still reads is left."""
    from gridlens.llm import shared

    before = set(shared._kept)
    out = C.run(spark, sf)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(shared._kept) - before]
    assert sorted(left) == ["parts", "source_mix"]
    assert out.count() > 0


def test_run(spark, sf, stages):
    rows = entry.queries()["pipeline"](spark, sf).collect()
    assert Counter(r.ids_sha256 for r in rows) == Counter(r.ids_sha256 for r in stages["bpe_tokens"].collect())


def test_empty_and_odd_tables(spark, sf, odd, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for rows in (empty, odd):
        docs, seen = rows, {}
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == rows.columns
            seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
        last = C.STAGES[-1][1](spark, docs, sf).collect()
        if rows is empty:
            assert not any(seen.values()) and last == []
            continue
        rules = {k for k, t in ((r.doc_id, r.text) for r in odd.collect()) if (m := measures(t))["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"]}
        assert {d for d, _ in seen["quality_rules"]} <= rules
        assert len(seen["line_dedup"]) == len(seen["quality_rules"]) >= len(seen["near_dedup"])
        want = Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in seen["source_mix"])
        assert Counter((r.doc_id, r.n_tokens) for r in last) == want


def test_stages_on_nulls_and_repeats(spark, sf, odd):
    """Every stage by itself on the odd table, whose documents the first stage would mostly take away."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    lines = C.line_dedup(spark, odd, sf).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in lines) == sorted((str(k), str(t)) for (k, _), t in zip(rows, recurring(rows, 10, True), strict=True))
    near_rows = C.near_dedup(spark, odd, sf).collect()
    assert sum(1 for r in near_rows if not WORD.search(r.text or "")) == sum(1 for _, t in rows if not WORD.search(t or ""))
    assert len({r.text for r in near_rows if WORD.search(r.text or "")}) == len([r for r in near_rows if WORD.search(r.text or "")])
    mixed = C.source_mix(spark, odd, sf).collect()
    assert all(WORD.search(r.text) for r in mixed)
    tokens = C.bpe_tokens(spark, odd, sf).collect()
    assert len(tokens) == len(rows) and sum(r.n_tokens == 0 for r in tokens) == sum(1 for _, t in rows if not (t or "").strip())
