"""Media columns: chroma fingerprints of audio, and their alignment.

A recording is cut into overlapping frames; a frame's spectrum, less the floor of noise that its median shows, is folded onto the twelve
pitch classes, smoothed over time and scaled to unit length. Filters are differences of
rectangle sums over the image of frames x pitch classes, read off its integral image;
each is quantised to two Gray-coded bits, and 16 filters make a 32-bit item per frame.

Two recordings are aligned by equal items: the histogram of their offsets shows where
they may match, and the share of differing bits over the overlap decides, at every offset with enough hits.
A query's item is looked up as it is and with its ``PROBES`` least certain bits flipped, so noise that turns a few bits
costs no hit. An item that says nothing (no sound under any filter) or that only goes on from the frame before is
no key, so rests and held notes are one position, not many.
Queries are a stated set against all recordings. Recordings of one fingerprint are one class
and are aligned once, so copies are never multiplied out. Hits are added up per (query, recording, offset); Spark may
deal the recordings of a frequent item to many tasks, as the join is a plain one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm.blocks import _q
from gridlens.llm.shared import bounded_batches, stored

RATE, FRAME, HOP = 8000, 2048, 683
LOW, HIGH = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Noise goes up to so many medians of a frame's spectrum.
FLOOR = 8.0
#: A filter over sound that stands still gives 0; bits turn a little beside it, so that rounding turns none.
STILL = 0.01
#: Least equal items at one offset, least overlapping items, and greatest share of differing bits.
MIN_HITS, MIN_OVERLAP, MAX_ERROR = 3, 20, 0.3
#: Least certain bits of a query's item that are tried both ways.
PROBES = 3


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, classes, frames): every kind over the narrow and the wide half and over few and many frames."""
    kinds, spans = 4, ((0, 6), (6, 6), (0, 12), (3, 6))
    return [(kind, low, height, width) for kind in range(kinds) for (low, height), width in zip(spans, (4, 8, 12, 16), strict=True)]


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Bins of the spectrum that are heard, and those bins x 12 pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
    note = np.round(12 * np.log2(hz[heard] / 440.0)).astype(int) % 12
    out = np.zeros((len(heard), 12), np.float32)
    out[np.arange(len(heard)), note] = 1.0
    return heard, out


_HEARD, _FOLD = _fold()
_WINDOW = np.hanning(FRAME).astype(np.float32)
_WIDEST = max(w for *_, w in filters())


def wav_samples(cell: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and the rate of a WAV cell (PCM of 8, 16, 24 or 32 bits, floats of 32 or 64, plain or extensible); what can't be read has no samples."""
    none = np.zeros(0), RATE
    if not cell or len(cell) < 12 or cell[:4] != b"RIFF" or cell[8:12] != b"WAVE":
        return none
    at, form = 12, None
    while at + 8 <= len(cell):
        name, size = struct.unpack_from("<4sI", cell, at)
        body = cell[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if kind == 0xFFFE and len(body) >= 26:  # extensible: the kind is the head of the sub-format
                kind = struct.unpack_from("<H", body, 24)[0]
            form = kind, channels, rate, bits
        elif name == b"data" and form:
            kind, channels, rate, bits = form
            if not channels or not rate or (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)):
                return none
            body = body[: len(body) // (bits // 8 * channels) * (bits // 8 * channels)]
            if kind == 3:
                x = np.nan_to_num(np.frombuffer(body, f"<f{bits // 8}").astype(float), nan=0.0, posinf=0.0, neginf=0.0)
            elif bits == 8:
                x = np.frombuffer(body, np.uint8) / 128.0 - 1.0
            elif bits == 24:
                three = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / 2.0**23
            else:
                x = np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)
            return x.reshape(-1, channels).mean(axis=1), rate
        at += 8 + size + size % 2
    return none


_notes: dict[tuple[int, float], np.ndarray] = {}


def sonify(vector: list[float] | None, rate: int = RATE, note_seconds: float = 0.125) -> tuple[np.ndarray, int]:
    """A vector as a melody, one note a number; nulls in it are rests."""
    if (rate, note_seconds) not in _notes:
        n = int(rate * note_seconds)
        pitch = 440.0 * 2.0 ** (np.arange(-30, 31) / 12.0)
        sounds = 0.5 * np.sin(2 * np.pi * pitch[:, None] * (np.arange(n) / rate)[None, :])
        _notes[rate, note_seconds] = np.concatenate([sounds, np.zeros((1, n))])
    values = np.array([np.nan if v is None else v for v in vector or []], float)
    key = np.where(np.isfinite(values), np.clip(np.round(np.nan_to_num(values, posinf=0.0, neginf=0.0) * 40.0), -30, 30) + 30, 61).astype(int)
    return _notes[rate, note_seconds][key].ravel(), rate


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12, smoothed, each frame of length 1 (0 where nothing sounds)."""
    if rate <= 0:
        return np.zeros((0, 12))
    if rate != RATE and len(samples):
        n = int(len(samples) * RATE / rate)
        samples = np.interp(np.arange(n) * (rate / RATE), np.arange(len(samples)), samples)
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    views = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    folded = np.empty((len(views), 12))
    for lo in range(0, len(views), 1024):  # a long recording a stretch at a time
        power = np.abs(np.fft.rfft(views[lo : lo + 1024] * _WINDOW, axis=1)[:, _HEARD]) ** 2
        middle = power.shape[1] // 2
        floor = FLOOR * np.partition(power, middle, axis=1)[:, middle : middle + 1]
        folded[lo : lo + 1024] = np.maximum(power - floor, 0) @ _FOLD
    n = len(folded) - len(SMOOTH) + 1
    if n <= 0:
        return np.zeros((0, 12))
    smooth = sum(w * folded[k : k + n] for k, w in enumerate(SMOOTH))
    size = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.divide(smooth, size, out=np.zeros_like(smooth), where=size > 1e-6)


def items(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each image: a 32-bit item for every frame from which the widest filter fits, its least certain bits (``PROBES`` bytes), and whether it is a key.

    All images are filtered at once; each has an integral image of its own, so what stands beside it changes nothing.
    """
    counts = np.array([max(0, len(x) - _WIDEST + 1) for x in images], np.int64)
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in images])])
    whole = np.zeros((int(begin[-1]), 13))
    for x, a in zip(images, begin, strict=False):
        whole[a + 1 : a + 1 + len(x), 1:] = np.cumsum(np.cumsum(x, axis=0), axis=1)
    at = np.arange(counts.sum()) + np.repeat(begin[:-1] - (np.cumsum(counts) - counts), counts)

    def box(t0, t1, y0, y1):
        return whole[at + t1, y1] - whole[at + t0, y1] - whole[at + t1, y0] + whole[at + t0, y0]

    out = np.zeros(len(at), np.uint32)
    certain = np.empty((len(at), 32), np.float32)
    for place, (kind, y, h, w) in enumerate(filters()):
        a, half, mid = box(0, w, y, y + h), w // 2, y + h // 2
        if kind == 0:  # low classes against high ones
            b = box(0, w, y, mid)
        elif kind == 1:  # earlier against later
            b = box(0, half, y, y + h)
        elif kind == 2:  # crosswise
            b = box(0, half, y, mid) + box(half, w, mid, y + h)
        else:  # the middle of the time against its ends
            b = box(w // 4, w - w // 4, y, y + h)
        level = np.log((1.0 + b) / (1.0 + a - b)) - STILL
        step = (level > -0.25).astype(np.uint32) + (level > 0) + (level > 0.25)
        out = (out << 2) | (step ^ (step >> 1)).astype(np.uint32)
        # the upper bit of the code turns at 0, the lower one a quarter to either side
        certain[:, 31 - 2 * place] = np.abs(level)
        certain[:, 30 - 2 * place] = np.abs(np.abs(level) - 0.25)
    weak = np.argsort(certain, axis=1, kind="stable")[:, :PROBES].astype(np.uint8)
    sounds = box(0, _WIDEST, 0, 12) > 0
    first = np.zeros(len(at), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    again = np.zeros(len(at), bool)
    again[1:] = out[1:] == out[:-1]
    key = sounds & (first | ~again)
    edge = np.concatenate([[0], np.cumsum(counts)])
    return [(out[a:b], weak[a:b], key[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def fingerprints(df: DataFrame, media: str, order: str, decode: Callable = wav_samples) -> DataFrame:
    """id, items (binary: little-endian 32-bit), weak (least certain bits, ``PROBES`` bytes an item), keys (a byte an item) and n_items of each row; ``decode`` makes samples and a rate of a cell.

    A map over batches. Null, unreadable and too short media have no items. Rows may repeat, other columns play no part,
    an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    packed = df.select(F.col(_q(order)).alias("id"), F.col(_q(media)).alias("media"))
    made = T.StructType([T.StructField("id", packed.schema["id"].dataType), *[T.StructField(c, T.BinaryType()) for c in ("items", "weak", "keys")], T.StructField("n_items", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                cells = items([chroma(*decode(x.as_py())) for x in batch["media"]])
                parts = [pa.array([c[k].astype(kind).tobytes() for c in cells], pa.binary()) for k, kind in enumerate(("<u4", np.uint8, np.uint8))]
                yield pa.RecordBatch.from_arrays([batch["id"], *parts, pa.array([len(c[0]) for c in cells], pa.int64())], names=made.names)

    return packed.mapInArrow(run, made)


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits, and overlapping items, of b laid ``offset`` items later than a (item k of a meets k - offset of b)."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()), hi - lo


def align(prints: DataFrame, is_query, min_hits: int = MIN_HITS, min_overlap: int = MIN_OVERLAP, max_error: float = MAX_ERROR) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, and links between them.

    First: id, class_id (least id of its class; its own id if it has no items) and n_items.
    Second: query_class, class_id, offset, overlap, bits, for each class that a query's class (one
    with a row for which ``is_query``, a condition on id, holds) matches: of the offsets with at least ``min_hits`` hits
    and ``min_overlap`` overlapping items the one with the least share of differing bits (of equal ones the
    least), if that is at most ``max_error``.

    Null ids are ids like others, last in order, and never queries; rows without items are a class each and link to nothing; rows may repeat
    and then share a class; an empty table gives two empty results; ``prints`` is what ``fingerprints`` makes, other columns play no part.
    """
    prints = stored(prints, "prints")
    some = prints.where("n_items > 0")
    kinds = some.groupBy("items").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked"), F.min("weak").alias("weak"), F.min("keys").alias("keys"))
    kinds = stored(kinds.select("items", F.col("least.id").alias("class_id"), "asked", "weak", "keys"), "kinds")
    named = kinds.select(F.col("items").alias("its"), F.col("class_id").alias("least"))
    rows = prints.join(named, prints["items"] == named["its"], "left").select("id", F.when(F.col("n_items") > 0, F.col("least")).otherwise(F.col("id")).alias("class_id"), "n_items")

    def spread(probes: int):
        """Keys and their positions; with ``probes`` every key also with its least certain bits the other way."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    value = np.frombuffer(batch["items"][k].as_py(), "<u4")
                    at = np.flatnonzero(np.frombuffer(batch["keys"][k].as_py(), np.uint8))
                    bits = np.frombuffer(batch["weak"][k].as_py(), np.uint8).reshape(-1, PROBES)[at, :probes].astype(np.uint32)
                    found = value[at][:, None]
                    for b in range(bits.shape[1]):
                        found = np.concatenate([found, found ^ (np.uint32(1) << bits[:, b : b + 1])], axis=1)
                    place = np.repeat(at, found.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel().astype(np.int64)), batch["class_id"].take(pa.array([k] * len(place), pa.int64())), pa.array(place.astype(np.int32))], names=["item", "class_id", "at"])

        return run

    cells = ("items", "class_id", "weak", "keys")
    made = T.StructType([T.StructField("item", T.LongType()), T.StructField("class_id", kinds.schema["class_id"].dataType), T.StructField("at", T.IntegerType())])
    every = kinds.select(*cells).mapInArrow(spread(0), made)
    asked = kinds.where("asked").select(*cells).mapInArrow(spread(PROBES), made).select("item", F.col("class_id").alias("query_class"), F.col("at").alias("q_at"))
    hits = every.join(asked, "item").where("query_class <> class_id").groupBy("query_class", "class_id", (F.col("q_at") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("hits"))
    places = hits.where(F.col("hits") >= min_hits).groupBy("query_class", "class_id").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    a = kinds.select(F.col("class_id").alias("query_class"), F.col("items").alias("a"))
    b = kinds.select("class_id", F.col("items").alias("b"))
    both = places.join(a, "query_class").join(b, "class_id")
    out = T.StructType([both.schema["query_class"], both.schema["class_id"], T.StructField("offset", T.IntegerType()), T.StructField("overlap", T.LongType()), T.StructField("bits", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for x, y, offsets in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["offsets"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                found = [(*bit_error(x, y, o), o) for o in offsets]
                found = [(Fraction(bits, 32 * n), o, n, bits) for bits, n, o in found if n >= min_overlap]
                best.append(min(found, default=None))
            keep = pa.array([f is not None and f[0] <= max_error for f in best])
            best = [f or (0, 0, 0, 0) for f in best]
            yield pa.RecordBatch.from_arrays([batch["query_class"], batch["class_id"], pa.array([f[1] for f in best], pa.int32()), pa.array([f[2] for f in best], pa.int64()), pa.array([f[3] for f in best], pa.int64())], names=out.names).filter(keep)

    return rows, both.select("query_class", "class_id", "offsets", "a", "b").mapInArrow(compare, out)


def op3_audio_match(spark, sf_dir: str) -> DataFrame:
    """Every recording with its class, how many of the query recordings (ids divisible by 100; by class) match it, and the best of them.

    The tables hold no audio, so the recordings are the melodies of the embeddings.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows, links = align(fingerprints(vectors, "embedding", "vec_id", sonify), F.col("id") % 100 == 0)
    error = F.col("bits") / (32 * F.col("overlap"))
    best = links.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"), F.min(F.struct(error.alias("error"), "query_class", "offset", "overlap")).alias("b"))
    best = best.select(F.col("class_id").alias("its"), "n_links", "b")
    out = rows.join(best, F.col("class_id") == F.col("its"), "left")
    return out.select(F.col("id").alias("vec_id"), "class_id", "n_items", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("b.query_class").alias("best_query"), F.col("b.offset").alias("best_offset"), F.col("b.overlap").alias("best_overlap"), F.col("b.error").alias("best_error"))
