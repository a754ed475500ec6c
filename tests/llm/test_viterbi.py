import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from gridlens.llm import viterbi as V

PATH = public_tokenizers.path(V.VOCABULARY)


def library(vocabulary):
    tok = Tokenizer(models.Unigram(vocabulary, 0, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(V.MARK, "always", True)
    return tok


@pytest.fixture(scope="module")
def tok():
    return library(V.pieces(PATH))


@pytest.fixture(scope="module")
def count():
    return V.Counter(V.pieces(PATH))


def many(count, texts):
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return count.totals(np.frombuffer(b"".join(data), np.uint8), off)[0].tolist()


def test_odd_texts(tok, count):
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\na", " \n", "a\n b", "a \n", "\n ", "▁a ▁", "日本語 🎉🎉x", "<0x0A> <unk> <s>", "naïve\tcafé", "x" * 3000, "\u0000", "é́"]
    assert many(count, texts) == [len(tok.encode(t).ids) for t in texts]


def test_random_texts(tok, count):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abtheion  \n▁é日🎉'1") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert many(count, texts) == [len(tok.encode(t).ids) for t in texts]


def test_ties():
    rng = random.Random(4)
    for _ in range(60):
        names = {"<unk>", *("".join(rng.choice("ab▁"[: 2 + (k == 0)]) for k in range(1)) for _ in range(2))}
        names |= {rng.choice(["", "▁"]) + "".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        vocabulary = [("<unk>", 0.0)] + [(x, float(rng.choice([-1, -2, -2, -3, -4]))) for x in sorted(names - {"<unk>"})]
        vocabulary[0] = ("<unk>", -4.0)
        count, tok = V.Counter(vocabulary), library(vocabulary)
        count.bytes_known = True  # without byte pieces the library fuses unknown characters, so texts have none
        letters = [x for x in "ab" if x in names]
        if not letters or "▁" not in names:
            continue
        texts = ["".join(rng.choice([*letters, " "]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
        assert many(count, texts) == [len(tok.encode(t).ids) for t in texts]


def test_query(spark, documents, tok):
    got = {r.doc_id: r.n_tokens for r in V.token_counts(documents, keep=["doc_id"]).collect()}
    assert got == {d.doc_id: len(tok.encode(d.text or "").ids) for d in documents.collect()}


def test_odd_rows(odd, odd_rows, empty, tok):
    rows = V.token_counts(odd).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(r[0]), len(tok.encode(r[1] or "").ids)) for r in odd_rows)
    assert all(r.score == 0 for r in rows if not r.n_tokens)
    assert rows[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "block", "row", "kept_text", "n_tokens", "score"}
    assert V.token_counts(empty).collect() == []


def test_segments_of_equal_hash(tok, monkeypatch):
    monkeypatch.setattr(V.K, "span_hashes", lambda data, starts, ends, view=None: (ends - starts).astype(np.uint64))
    texts = ["one two six ten", "owt neo xis net one", "x" * 300 + " " + "y" * 300 + " y", "a b c d a"]
    assert many(V.Counter(V.pieces(PATH)), texts) == [len(tok.encode(t).ids) for t in texts]


def test_scores_do_not_depend_on_company():
    rng = random.Random(5)
    vocabulary = [("<unk>", -9.3)] + [(x, -rng.random() * 7) for x in ["▁", "a", "b", "c", "ab", "▁a", "bc", "▁ab", "ca"]]
    count = V.Counter(vocabulary)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    together = count.totals(np.frombuffer(b"".join(data), np.uint8), off)[1].tolist()
    alone = [count.totals(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[1][0] for d in data]
    assert together == alone
