"""Secret scans: patterns, and a token-efficiency test for random strings.

Patterns find assignments, access keys and long hexadecimal runs. Strings that no pattern
knows show by what they cost a tokenizer: words of a language are in its vocabulary, random
characters are not, so a run of ``MIN_RUN`` or more characters (of letters, digits and ``SYMBOLS``) with a letter is a span of
kind ``opaque`` if a tiktoken vocabulary needs more than one token for
every ``MAX_RATIO`` characters; runs of more than ``PIECE`` characters are counted piece by piece. Not tested: digests of known lengths and UUIDs. Of
identifiers (parts of letters with at most four digits behind them, joined by ``_ - / + =``) the
parts are tested, as short ones cost much without being random.
An opaque run that touches a pattern's span is that span already.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm import textkit as K
from gridlens.llm.blocks import _q, unpack
from gridlens.llm.shared import bounded_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "opaque")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
MIN_RUN, MAX_RATIO = 16, 2.2
SYMBOLS = "+/_=-"
PIECE = 2048

# The patterns of the contract. Letters of ASCII alone fold case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")

PART = re.compile(rb"[A-Za-z]*[0-9]{0,4}")
LETTER, JOINT = re.compile(rb"[A-Za-z]"), re.compile(rb"[_/+=-]+")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


@dataclass(frozen=True)
class Opaque:
    """What runs are tested, and how: least length, symbols beside letters and digits, and characters per token below which a run is opaque."""

    min_run: int = MIN_RUN
    symbols: str = SYMBOLS
    max_ratio: float = MAX_RATIO

    def runs(self) -> re.Pattern[bytes]:
        return re.compile(b"[A-Za-z0-9%s]{%d,}" % (re.escape(self.symbols.encode("ascii")), self.min_run))


def opaque(run: bytes, enc: tiktoken.Encoding, rule: Opaque = Opaque()) -> bool:
    """Whether a run reads as random characters; linear in its length."""
    if not LETTER.search(run) or UUID.fullmatch(run):
        return False
    parts = JOINT.split(run)
    if len(parts) > 1 and all(map(PART.fullmatch, parts)):
        return any(len(part) >= rule.min_run and opaque(part, enc, rule) for part in parts)
    if len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run):
        return False
    text = run.decode("ascii")
    return len(run) < rule.max_ratio * sum(len(enc.encode_ordinary(text[k : k + PIECE])) for k in range(0, len(text), PIECE))


def scan(data: np.ndarray, off: np.ndarray, enc: tiktoken.Encoding, rule: Opaque = Opaque()) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) of each text, in code points, by start and then kind.

    Runs hold no separator, so only words of enough bytes are looked into for them;
    assignments can hold spaces, and only texts with a keyword are searched.
    """
    pattern = rule.runs()
    body, out = data.tobytes(), [[] for _ in range(len(off) - 1)]
    starts, ends, first = K.words(data, off)
    long = np.flatnonzero(ends - starts >= min(MIN_ACCESS, rule.min_run, MIN_HEX))
    owner = np.searchsorted(first, long, side="right") - 1
    runs: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(owner.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        word = body[a:b]
        base = int(off[d])
        if b"AKIA" in word:
            out[d] += [(1, a - base + m.start(), a - base + m.end()) for m in ACCESS.finditer(word) if m.end() - m.start() >= MIN_ACCESS]
        out[d] += [(2, a - base + m.start(), a - base + m.end()) for m in HEX.finditer(word) if m.end() - m.start() >= MIN_HEX]
        found = [(a - base + m.start(), a - base + m.end()) for m in pattern.finditer(word) if opaque(m.group(), enc, rule)]
        if found:
            runs[d] = runs.get(d, []) + found
    for d in range(len(off) - 1):
        text = body[off[d] : off[d + 1]]
        spans = out[d] + [(3, a, b) for a, b in runs.get(d, ())]
        if spans and not text.isascii():
            # code points before each byte
            before = np.concatenate([[0], np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80)]).tolist()
            spans = [(k, before[a], before[b]) for k, a, b in spans]
        small = text.lower()
        if any(w in small for w in KEYWORDS):
            spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text.decode("utf-8", "replace")) if len(m.group(2)) >= MIN_VALUE]
        known = sorted((a, b) for k, a, b in spans if k < 3)
        begins, reach = [a for a, _ in known], list(accumulate((b for _, b in known), max))
        out[d] = sorted(((k, a, b) for k, a, b in spans if k < 3 or not ((n := bisect_left(begins, b)) and reach[n - 1] > a)), key=lambda s: (s[1], s[0]))
    return out


def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, rule: Opaque = Opaque()) -> DataFrame:
    """The columns ``keep`` (all but ``text`` by default) and secrets: an array of (kind, start, end), in code points, ends exclusive, by start and then kind.

    A map over batches, without a shuffle. Null and empty texts have no secrets. Rows may
    repeat; a column named secrets is replaced. An empty table gives an empty result.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    bounded_batches(df.sparkSession)
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(_q(c)) for c in keep]).alias("row"), F.col(_q(text)).cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    made = T.StructType([packed.schema["row"], T.StructField("secrets", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            data, off = K.buffers(batch["text"])
            found = []
            for lo, hi in K.slices(off):
                for spans in scan(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], enc, rule):
                    found.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, kind)], names=made.names)

    return unpack(packed.mapInArrow(run, made), keep, ["secrets"])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, keep=["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"] != "opaque")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
