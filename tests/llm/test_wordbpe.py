import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridlens.llm import wordbpe as W

PATH = public_tokenizers.path(W.VOCABULARY)
ODD = [
    "", " ", "\t\n", "Hello  World's they'll", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "ẖ H̱ Åå Å K ſ", "İstanbul ΑΣ ΣΑΣ", "x y z\u0085w\x1cq",
    "日本語テキスト 한국어 🎉🎉👩‍👩‍👧", "naïve café résumé", "12345 3,14 $%^&*!!!???", "\x00\x01 \x7f", "'s 's't 'RE", "the" * 700, "ab1!" * 900, "zq" * 3000 + "é" * 1500,
]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


def check(bpe, tok, text):
    ids = np.frombuffer(bpe.ids(text.encode()), "<u4")
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, text[:80]
    assert bpe.text(ids).decode() == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [8, 1024])
def test_odd_texts(library, leaf):
    bpe = W.WordBpe(PATH, leaf)
    for text in ODD:
        check(bpe, library, text)


def test_random_runs_join_exactly(library):
    rng, bpe = random.Random(3), W.WordBpe(PATH, 6)
    for _ in range(400):
        letters = rng.choice(["abe", "thein", "aeiou stnr", "é ßü", "the<|endoftext|>"])
        check(bpe, library, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120))))


def test_forgetting_keeps_results(library, monkeypatch):
    monkeypatch.setattr(W, "KEPT_WORDS", 3)
    bpe = W.WordBpe(PATH)
    for text in ["one two three four five", "one six two", "seven one eight two nine"]:
        check(bpe, library, text)


def test_parts_in_tasks_of_their_own(spark, library, odd):
    rng = random.Random(8)
    texts = [*ODD, "the<|endoftext|>" * 30, "日本語" * 50, " " * 300, "w" * 200 + " " + "é" * 300]
    texts += ["".join(rng.choice(["thing", "é", " ", "\n", "<|endoftext|>", "!!", "日", "don't "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (1000, texts[-1]), (1000, texts[-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in W.round_trip(df, leaf=16, part=40).collect())
    want = []
    for k, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((k, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    rows = W.round_trip(odd, part=100).collect()
    assert rows[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "block", "row", "kept_text", "ids", "n_tokens", "decoded"}
    ids = sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows)
    assert ids == sorted(library.encode(r.text or "", add_special_tokens=False).ids for r in odd.collect())


@pytest.mark.parametrize("part", [9, 40])
def test_unsplit_runs_in_parts(library, part):
    """Every cut, open or closed, and every order of joining gives the library's ids."""
    rng, bpe, opened = random.Random(part), W.WordBpe(PATH, 6), 0
    alphabets = ["abe", "acgt", "theinab", "日本語漢字", "한국어글", "ab日é", "a1b2c3XYZ", "-=_", "--..ab", "aé́b", "x's't're", "ab<|endoftext|>", "ΑΣΣαβ", "бвгЙй", "กขค\u0e48", "かがき\u3099", "ab \t"]
    for k in range(600):
        letters = alphabets[k % len(alphabets)]
        parts = [letters] if k % 3 else [*letters, "<|endoftext|>", "'s", "'RE", "thing", "12"]
        text = "".join(rng.choice(list(parts[0]) if len(parts) == 1 else parts) for _ in range(rng.randint(0, 150)))
        ends = bpe.cuts(text, part)
        opened += sum(o for _, o in ends)
        row, at, left = [], 0, False
        for end, right in ends:
            row.append(bpe.segment(text[at:end], left, right))
            at, left = end, right
        while len(row) > 1:
            j = rng.randrange(len(row) - 1)
            row[j : j + 2] = [bpe.together(row[j], row[j + 1])]
        got = np.frombuffer(row[0].head + row[0].body + row[0].tail, "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, (text, ends)
    assert opened > 500


def test_long_unsplit_run_spreads_over_tasks(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("acgt") for _ in range(60_000)), "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(20_000)), "=" * 30_000, "plain words " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in W.round_trip(df, part=4000).collect()}
    assert [got[k] for k in range(4)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_structure(library):
    """Words that differ by a pattern of repetition, which sums modulo 2^64 can't tell apart."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    check(W.WordBpe(PATH), library, f"{a} {b} {a[:64]} {b[:64]}")


def test_equal_hashes_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(W.K, "span_hashes", lambda data, starts, ends, view=None: (ends - starts).astype(np.uint64))
    for bpe in [W.WordBpe(PATH)]:
        for text in ["one two three four five", "eno owt seven eight nine two " + "x" * 300 + " " + "y" * 300]:
            check(bpe, library, text)


def test_other_rules_are_refused(spark, documents):
    with pytest.raises(ValueError, match="otherwise"):
        W.round_trip(documents, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, documents, library):
    rows = {r.doc_id: r for r in W.round_trip(documents, keep=["doc_id"]).collect()}
    for d in documents.collect():
        want = library.encode(d.text or "", add_special_tokens=False).ids
        got = rows[d.doc_id]
        assert np.frombuffer(got.ids, "<u4").tolist() == want
        assert got.n_tokens == len(want)
        assert got.decoded == library.decode(want, skip_special_tokens=False)
