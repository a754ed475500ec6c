"""Token counts without tokens: a Viterbi search that carries score and piece count alone.

A unigram vocabulary gives every piece a score; a text's segmentation is the one of
greatest total. An Aho-Corasick automaton lists all pieces that end at each character,
longest first, and the search keeps, for each end, the best score and how many pieces it
has. Ties follow the tokenizers library: the piece that starts first stays unless a later
one is strictly better; a character that is no piece by itself may stand as unknown for the least
score minus ``PENALTY``, and falls back to its bytes.

No piece reaches over a space (which turns into the mark that pieces start with), nor over
a character that no piece holds, so the search runs per segment between these,
each different segment once per worker (its bytes are compared, not its hash alone), and whole texts are sums of
their segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm import textkit as K
from gridlens.llm.blocks import _q, unpack
from gridlens.llm.memo import Memo, grown, numbered
from gridlens.llm.shared import bounded_batches

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10.0
#: Segments that a worker keeps; beyond that it starts anew.
KEPT = 1_500_000
_counters: dict[str, Counter] = {}


def pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(pieces(path))
    return _counters[path]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY
        held = set().union(*(piece for piece, _ in vocabulary))
        names = {piece for piece, _ in vocabulary}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))
        #: Line feeds part segments if no piece holds one.
        self.parts_lines = "\n" not in held
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece has the mark inside; texts can't be parted at spaces")
        self.marked, self.bare = _Kept(), _Kept()

    def solve(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        ends = self.found.iter(text)
        at, hit = next(ends, (n, None))
        for end in range(n):
            top, many, alone = None, 0, False
            while at == end:
                size, score = hit
                score += best[end + 1 - size]
                if top is None or score > top:
                    top, many = score, count[end + 1 - size] + 1
                alone = alone or size == 1
                at, hit = next(ends, (n, None))
            if not alone:
                score = best[end] + self.unknown
                if top is None or score > top:
                    top, many = score, count[end] + (len(text[end].encode()) if self.bytes_known else 1)
            best[end + 1], count[end + 1] = top, many
        return count[n], best[n]

    def totals(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and scores of texts."""
        data, off = _spaced(data, off)
        cut = data == 0x20
        if self.parts_lines:
            cut |= data == 0x0A
        lines = np.flatnonzero(data == 0x0A) if self.parts_lines else np.zeros(0, np.int64)
        starts, ends, first = K._runs(~cut, off)
        marked = _follows(data, off, starts)
        # a segment is told apart by its bytes; those behind a mark and others have memos of their own
        count, score = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.float64)
        for head, kept in ((MARK, self.marked), ("", self.bare)):
            at = np.flatnonzero(marked == bool(head))
            if len(at):
                count[at], score[at] = self.solved(kept, head, data, starts[at], ends[at])
        owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
        count, score = (np.bincount(owner, x, len(off) - 1) for x in (count, score))
        count = count.astype(np.int64)
        # spaces whose mark stands alone, and line feeds
        bare = _bare_spaces(data, off)
        for at, symbol in ((bare, MARK), (lines, "\n")):
            if len(at):
                k, s = self.solve(symbol)
                many = np.diff(np.searchsorted(at, off))
                count, score = count + k * many, score + s * many
        # a text that doesn't begin with a space gets a mark; before a line feed it stands alone
        full = np.diff(off) > 0
        head = data[np.minimum(off[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(off) - 1, np.uint8)
        if self.parts_lines and (alone := full & (head == 0x0A)).any():
            k, s = self.solve(MARK)
            count, score = count + k * alone, score + s * alone
        return count, score

    def solved(self, kept: _Kept, head: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each segment; each different one is searched once and kept."""

        def text(k: int) -> str:
            return head + data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")

        def learn(one: np.ndarray) -> None:
            found, n = [self.solve(text(k)) for k in one], kept.memo.n
            kept.count, kept.score = grown(kept.count, n + len(one)), grown(kept.score, n + len(one))
            kept.count[n : n + len(one)] = [k for k, _ in found]
            kept.score[n : n + len(one)] = [s for _, s in found]

        if kept.memo.n > KEPT:
            kept.__init__()
        number, odd = numbered(kept.memo, data, starts, ends, learn)
        count, score = kept.count[number], kept.score[number]
        for k in odd:
            count[k], score[k] = self.solve(text(k))
        return count, score


class _Kept:
    """Segments and what was found for them."""

    def __init__(self):
        self.memo = Memo()
        self.count = np.zeros(1 << 12, np.int64)
        self.score = np.zeros(1 << 12, np.float64)


def _spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mark in a text is what a space turns into, so it may as well be one."""
    mark, body = MARK.encode(), data.tobytes()
    if mark not in body:
        return data, off
    texts = [body[a:b].replace(mark, b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _follows(data: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Segments that begin with the mark: those behind a space or at the start of a text."""
    head = np.zeros(len(data) + 1, bool)
    head[off] = True
    return head[starts] | (data[np.maximum(starts - 1, 0)] == 0x20)


def _bare_spaces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Spaces before another space, a line feed or the end of the text."""
    space = data == 0x20
    end = np.zeros(len(data) + 1, bool)
    end[off] = True
    follow = np.concatenate([data[1:], [0x20]]) if len(data) else data
    return np.flatnonzero(space & (end[1:] | (follow == 0x20) | (follow == 0x0A)))


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``text`` by default), n_tokens and score of every whole text.

    A map over batches, without a shuffle. Counts are those of the tokenizers library's Unigram
    model with byte fallback behind a Metaspace splitter. Null and empty texts have 0 tokens
    and score 0. Rows may repeat; columns named like an output are replaced. An empty table gives
    an empty result.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    bounded_batches(df.sparkSession)
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(_q(c)) for c in keep]).alias("row"), F.col(_q(text)).cast("string").alias("text"))
    made = T.StructType([packed.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            data, off = K.buffers(batch["text"])
            for lo, hi in K.slices(off):
                many, score = count.totals(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch["row"].slice(lo, hi - lo), pa.array(many), pa.array(score)], names=made.names)

    return unpack(packed.mapInArrow(run, made), keep, made.names[1:])


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, keep=["doc_id"]).select("doc_id", "n_tokens", "score")
