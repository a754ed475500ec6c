import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import chroma as C


def wav(samples, rate=C.RATE, channels=1):
    body = (np.repeat(np.clip(samples, -1, 1), channels) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(body)) + body


def melody(seed, n=64):
    rng = random.Random(seed)
    return [rng.uniform(-0.6, 0.6) for _ in range(n)]


def print_of(samples, rate=C.RATE):
    value, weak, key = C.items([C.chroma(samples, rate)])[0]
    return value, weak, key


def brute(prints, queries):
    """Every query class against every class, every offset with enough hits; prints: items, least certain bits, keys."""
    out = {}
    for q in queries:
        for m in prints:
            (a, weak, a_key), (b, _, b_key) = prints[q], prints[m]
            if a.tobytes() == b.tobytes():
                continue
            hits = {}
            for i in np.flatnonzero(a_key):
                mask = np.uint32(sum(1 << int(x) for x in weak[i]))
                for j in np.flatnonzero(b_key & ((a[i] | mask) == (b | mask))):
                    hits[int(i) - int(j)] = hits.get(int(i) - int(j), 0) + 1
            found = []
            for offset, n_hits in hits.items():
                bits, n = C.bit_error(a, b, offset)
                if n_hits >= C.MIN_HITS and n >= C.MIN_OVERLAP and bits <= 32 * C.MAX_ERROR * n:
                    found.append((Fraction(bits, n), offset, n, bits))
            if found:
                out[q, m] = min(found)[1:]
    return out


@pytest.fixture(scope="module")
def recordings():
    whole, _ = C.sonify(melody(1))
    noise = np.random.default_rng(0).normal(0, 0.1, len(whole))
    later = np.concatenate([C.sonify(melody(5, 8))[0], whole[: 6 * len(whole) // 8]])
    fast, _ = C.sonify(melody(1), rate=2 * C.RATE)
    rows = [(0, wav(whole)), (1, wav(whole + noise)), (2, wav(later)), (3, wav(whole, channels=2)), (4, wav(fast, rate=2 * C.RATE))]
    rows += [(k, wav(C.sonify(melody(k))[0])) for k in range(10, 20)]
    return rows + [(100, wav(C.sonify(melody(12))[0] + 0.5 * noise)), (30, None), (31, b""), (32, b"RIFFxxxxWAVE"), (33, wav(np.zeros(9000))), (34, wav(whole[:500])), (0, wav(whole)), (None, wav(whole)), (200, wav(np.zeros(40000)))]


def test_alignment(spark, recordings):
    df = spark.createDataFrame([(*r, "clash") for r in recordings], "rec long, audio binary, items string")
    rows, links = C.align(C.fingerprints(df, "audio", "rec"), F.col("id") % 100 == 0)
    got = {(r.query_class, r.class_id): (r.offset, r.overlap, r.bits) for r in links.collect()}
    prints, named = {}, {}
    for k, cell in sorted((r for r in recordings if r[0] is not None), key=lambda r: r[0]):
        p = print_of(*C.wav_samples(cell))
        if len(p[0]) and p[0].tobytes() not in named:
            named[p[0].tobytes()], prints[k] = k, p
    asked = sorted({named[p.tobytes()] for r in recordings if r[0] is not None and r[0] % 100 == 0 and len(p := print_of(*C.wav_samples(r[1]))[0])})
    assert got == brute(prints, asked)
    assert (0, 1) in got and got[0, 1][0] == 0
    assert (0, 2) in got and got[0, 2][0] < 0
    assert (100, 12) in got
    assert not any(0 in k and (set(k) & set(range(10, 20))) for k in got)
    by = {(r.id, r.class_id, r.n_items > 0) for r in rows.collect()}
    assert (3, 0, True) in by and (None, 0, True) in by and (30, 30, False) in by and (34, 34, False) in by
    assert len(rows.collect()) == len(recordings)


def test_empty(spark):
    df = spark.createDataFrame([], "rec long, audio binary")
    rows, links = C.align(C.fingerprints(df, "audio", "rec"), F.col("id") % 100 == 0)
    assert rows.collect() == [] and links.collect() == []


def test_query_by_hand(spark, sf):
    rows = {r.vec_id: r for r in C.op3_audio_match(spark, sf).collect()}
    assert len(rows) == 500 and all(r.n_items == 72 for r in rows.values())
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    prints, named, of = {}, {}, {}
    for k in sorted(vectors):
        p = print_of(*C.sonify(vectors[k]))
        of[k] = named.setdefault(p[0].tobytes(), k)
        if of[k] == k:
            prints[k] = p
    links = brute(prints, sorted({of[k] for k in vectors if k % 100 == 0}))
    best = {}
    for (q, m), (offset, n, bits) in links.items():
        best.setdefault(m, []).append((bits / (32 * n), q, offset, n))
    for k, r in rows.items():
        found = sorted(best.get(of[k], []))
        assert (r.class_id, r.n_links) == (of[k], len(found))
        assert not found or (r.best_query, r.best_offset, r.best_overlap) == found[0][1:]


@pytest.mark.parametrize(("sd", "least"), [(0.1, 1.0), (0.3, 1.0), (0.5, 0.98), (1.0, 0.9)])
def test_recall_under_noise(spark, sf, sd, least):
    """Recordings (amplitude 0.5) against themselves in white noise; no other pair may be taken for one."""
    rng = np.random.default_rng(int(10 * sd))
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(60).collect()]
    clean = [C.sonify(v)[0] for v in vectors]
    prints = {k: print_of(x) for k, x in enumerate(clean)} | {1000 + k: print_of(x + rng.normal(0, sd, len(x))) for k, x in enumerate(clean)}
    links = brute(prints, range(1000, 1060))
    assert sum((1000 + k, k) in links for k in range(60)) >= least * 60
    # the exact pairs decide what counts as alike: clean recordings by the same rule
    alike = brute(prints, range(60))
    assert all((m - 1000 if m >= 1000 else m) == q - 1000 or (q - 1000, m % 1000) in alike for q, m in links)


def test_rests_and_held_notes_are_one_key():
    quiet = np.zeros(5 * C.RATE)
    tune = C.sonify(melody(3))[0]
    held = C.sonify([0.1] * 40)[0]
    assert not print_of(quiet)[2].any()
    assert print_of(held)[2].sum() <= 3
    value, _, key = print_of(np.concatenate([tune, quiet, quiet, tune]))
    assert 20 < key.sum() < 1.2 * 2 * print_of(tune)[2].sum() + 30
    # silence laid on silence does not outvote the true offset
    a, b = np.concatenate([tune, quiet, quiet]), np.concatenate([quiet, tune, quiet])
    links = brute({0: print_of(a), 1: print_of(b)}, [0])
    assert abs(links[0, 1][0] + 5 * C.RATE / C.HOP) <= 1


def test_neighbours_in_a_batch_change_nothing():
    cells = [C.chroma(C.sonify(melody(k, 20 + k))[0]) for k in range(9)] + [np.zeros((0, 12)), np.zeros((5, 12))]
    together = C.items(cells)
    for x, (value, weak, key) in zip(cells, together, strict=True):
        alone = C.items([x])[0]
        assert value.tolist() == alone[0].tolist() and weak.tolist() == alone[1].tolist() and key.tolist() == alone[2].tolist()


def test_wav_forms():
    x = C.sonify(melody(2))[0]

    def cell(kind, bits, body, rate=C.RATE, channels=1, extra=b""):
        head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra
        return b"RIFF" + struct.pack("<I", 20 + len(head) + len(body)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body

    deep = (x * (2**31 - 1)).astype("<i4")
    three = deep.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
    two = (x * 32767).astype("<i2").tobytes()
    extended = struct.pack("<HHIH", 22, 16, 0, 1) + bytes(14)
    for made in [cell(1, 16, two), cell(1, 24, three), cell(1, 32, deep.tobytes()), cell(3, 32, x.astype("<f4").tobytes()), cell(3, 64, x.astype("<f8").tobytes()), cell(0xFFFE, 16, two, extra=extended)]:
        got, rate = C.wav_samples(made)
        assert rate == C.RATE and np.abs(got - x).max() < 1e-4
    for broken in [cell(1, 16, two, rate=0), cell(1, 16, two, channels=0), cell(7, 8, two), cell(1, 12, two), cell(3, 32, np.full(9, np.nan, "<f4").tobytes())]:
        assert not C.wav_samples(broken)[0].any()
        assert len(C.chroma(*C.wav_samples(broken))) == 0
    assert len(C.chroma(np.ones(9000), 0)) == 0
