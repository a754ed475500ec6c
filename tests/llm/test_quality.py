import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridlens.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(wins)
    marked = {i + k for i, x in enumerate(wins) if seen[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marked), "n_lines": len(lines)}


def check(rows, texts):
    for r, t in zip(rows, texts, strict=True):
        want = brute(t)
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])


def test_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n\té#|日<") for _ in range(rng.randint(0, 200))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(k, t, f"h{k % 4}", "x") for k, t in enumerate(texts)], "doc_id long, text string, source string, kept string")
    check(sorted(Q.judge(df).collect(), key=lambda r: r.doc_id), texts)


def test_prior():
    assert Q.beta_prior(None, None, None, None, 0) == (1.0, 1.0)
    alike = (400.0, 40.0, 4 * 10.0 * 10.0 / 100, 40000.0, 4)
    a, b = Q.beta_prior(*alike, sure=0.0)
    assert a / (a + b) == pytest.approx(0.1) and a + b >= 1e8  # hosts alike: the prior rules
    many = (4e6, 4e5, 40_000 * 10.0 * 10.0 / 100, 4e8, 40_000)
    assert sum(Q.beta_prior(*many)) > 100 * 100  # more so if they are many, however sure
    a, b = Q.beta_prior(400.0, 100.0, 100.0 * 100.0 / 100, 40000.0, 4)
    assert a / (a + b) == pytest.approx(0.25) and a + b < 10  # hosts far apart: each speaks for itself


def test_verdict_decides_on_documents(documents):
    """Documents with many repeats moved to one host: its verdict costs a document that others may keep."""
    moved = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("moved")).otherwise(F.col("source")))
    junk = Q.measured(moved).where("100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words").select("doc_id", F.lit("junk.example").alias("host"))
    borderline = " ".join(f"plain{k}" for k in range(99)) + " a b c d e" * 4  # 16 % repeated: within the rules, not within the strict ones
    spark = documents.sparkSession
    more = spark.createDataFrame([(900_001, borderline, "junk.example"), (900_002, borderline, "good.example")], "doc_id long, text string, source string")
    docs = moved.join(junk, "doc_id", "left").select("doc_id", "text", F.coalesce("host", "source").alias("source")).unionByName(more)
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert got[900_001].host_bad and not got[900_001].kept and not got[900_001].base_failed
    assert not got[900_002].host_bad and got[900_002].kept


def test_bad_host(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    light = clean + " ###" + " #" * 2  # 5 symbols in 63 words: within the rules, not within the strict ones
    rows = [(k, "junk", "bad.example", 0) for k in range(50)] + [(50, clean, "bad.example", 0), (51, light, "bad.example", 0)]
    rows += [(100 + k, clean, "good.example", 0) for k in range(80)] + [(190, light, "good.example", 0), (191, "junk", "rare.example", 0), (192, light, None, 0)]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, host_bad int")).collect()}
    assert got[50].kept and got[50].host_bad and not got[51].kept
    assert got[190].kept and not got[190].host_bad and got[100].kept
    assert got[192].kept or got[192].host_bad
    assert len(got) == len(rows)


def test_many_hosts_by_shuffle(spark, documents, monkeypatch):
    want = {tuple(r) for r in Q.judge(documents.select("doc_id", "text", "source")).collect()}
    monkeypatch.setattr(Q, "BROADCAST_HOSTS", 0)
    assert {tuple(r) for r in Q.judge(documents.select("doc_id", "text", "source")).collect()} == want


def test_odd_rows(odd, odd_rows, empty):
    rows = Q.judge(odd).collect()
    assert len(rows) == len(odd_rows)
    assert sum(r.n_words for r in rows) == sum(brute(r[1])["n_words"] for r in odd_rows)
    assert Q.judge(empty).collect() == []


def test_labels(spark, documents, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in Q.judge(documents).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert sum(r.kept for r in rows if labels[r.doc_id] == 0) <= 0.2 * sum(labels[r.doc_id] == 0 for r in rows)
