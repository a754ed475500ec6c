"""Texts of pure pattern, on which sums of powers modulo 2^64 collide whatever their base: Thue-Morse sequences and their complements, as words, lines and windows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from test_linededup import brute as recurring
from test_neardup import brute as near
from test_quality import brute as measures
from test_substring import brute as repeated
from test_viterbi import library as unigram
from tokenizers import Tokenizer

from gridlens.llm import grammar, linededup, neardup, quality, substring, textkit as K, viterbi, wordbpe


def morse(n, pair):
    """2^n symbols of a pair."""
    bits = np.zeros(1, int)
    for _ in range(n):
        bits = np.concatenate([bits, 1 - bits])
    return [pair[b] for b in bits]


WORD, OTHER = "".join(morse(11, "ab")), "".join(morse(11, "ba"))
LINE, LINE2 = " ".join(morse(10, ("tick", "tock"))), " ".join(morse(10, ("tock", "tick")))
TEXTS = [f"{WORD} {OTHER} end", f"{OTHER} {WORD} end", LINE, LINE2, f"{LINE}\n{LINE2}\n{LINE}", f"{WORD[:64]} {OTHER[:64]}", f"{WORD}\n{OTHER}", f"{OTHER}\n{OTHER}"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_hashes_differ():
    data = np.frombuffer((WORD + OTHER).encode(), np.uint8)
    for n in (64, 128, 1024, 2048):
        hashes = K.span_hashes(data, np.array([0, 2048]), np.array([n, 2048 + n]))
        assert hashes[0] != hashes[1]
        words = K.span_hashes(data, np.arange(4096), np.arange(4096) + 1)
        assert K.windows(words[:n], n)[0] != K.windows(words[2048 : 2048 + n], n)[0]


def test_windows_are_told_apart():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 3, 5, 7, 18, 35):
        names = K.windows(words, n)
        seen = {}
        for k, h in enumerate(names.tolist()):
            assert seen.setdefault(h, words[k : k + n].tobytes()) == words[k : k + n].tobytes()
        assert len(seen) == len({words[k : k + n].tobytes() for k in range(len(names))})


def test_substring(df):
    for length in (35, 64):
        rows = substring.repeats(df, min_words=length, block_bytes=3000).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_removed, r.kept_text) for r in rows] == repeated(TEXTS, length)
    words = [t.split() for t in TEXTS]
    for d, r in enumerate(rows):
        want, n = 0, 64
        while n <= len(words[d]):
            others = {tuple(w[i : i + n]) for e, w in enumerate(words) if e != d for i in range(len(w) - n + 1)}
            mine = [tuple(words[d][i : i + n]) for i in range(len(words[d]) - n + 1)]
            if any(x in others for x in mine) or len(set(mine)) < len(mine):
                want = n
            n *= 2
        assert r.longest == want


def test_neardup(df):
    assert {r.id: r.class_id for r in neardup.classes(df).collect()} == near(list(enumerate(TEXTS)))


def test_lines(spark, df):
    rows = [(k, f"see {WORD if k % 2 else OTHER} now\n{LINE if k % 2 else LINE2}") for k in range(8)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in linededup.drop_recurring(many, min_docs=4, keep_first=True).orderBy("doc_id").collect()]
    assert got == recurring(rows, 4, True)
    kept = {r.doc_id: r.dropped for r in linededup.drop_repeated(df).collect()}
    assert kept == {0: [], 1: [], 2: [], 3: [], 4: [0, 1, 2], 5: [], 6: [], 7: []}


def test_quality(df):
    for r in quality.judge(df.selectExpr("*", "'h' AS source")).collect():
        want = measures(TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_tokens(spark, df, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path(wordbpe.VOCABULARY))
    ids = [tok.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in wordbpe.round_trip(df, part=300).orderBy("doc_id").collect()] == ids
    grammar.write_tokens(df, str(tmp_path / "t"))
    rows = grammar.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [zlib.crc32(r.ids) for r in rows] == [zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for x in ids]
    counted = unigram(viterbi.pieces(public_tokenizers.path(viterbi.VOCABULARY)))
    assert [r.n_tokens for r in viterbi.token_counts(df).orderBy("doc_id").collect()] == [len(counted.encode(t).ids) for t in TEXTS]
