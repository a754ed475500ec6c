"""Exact BPE encoding and decoding by tree concatenation.

A text is a tree of parts. What a cut may do depends on its two neighbours, because the normaliser and
the splitter of this tokenizer look no further:

* At a separator, and between plain characters of different classes (letters, digits, marks) or two digits, both
  sides are right as they stand. Such a cut is *closed*.
* Between two plain letters, or two plain marks, both sides are normalised right, but one piece of the
  splitter goes through. Such a cut is *open*: each side's piece is merged as far as it goes, without the mark of a
  word's end on the left one, and the two are joined: the tokens around the cut are merged again as one
  window, which grows until its first and last tokens are those that the two sides already had.
  Neighbouring tokens are then compatible everywhere, which is what makes a BPE encoding the encoding.

A text of more than ``PART`` characters is cut into parts, at separators where there are some and at open cuts inside long
unsplit runs, and parts are encoded in tasks of their own. Texts with open cuts are joined two neighbours at
a time, level by level, each level a table in the shared folder. Inside a part words are leaves: each different word is
encoded once by the tokenizers library itself and kept (its bytes are compared, not a hash alone); a piece of more than
``LEAF`` symbols is cut into leaves that are merged independently and joined as above. Words are parted at closed cuts
first, so a word with a comma behind it is no other word.

Only in a run with no two neighbouring plain characters over a whole part (say, of letters with separate accents alone) is
no cut found there; the part then goes on to the next place that has one.
The vocabulary file is a parameter, but its normaliser and splitter must be those of ``NORMALISER`` and ``SPLITTER``;
it is read on each worker once and kept.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm import textkit as K
from gridlens.llm.blocks import _q, unpack
from gridlens.llm.memo import Memo, grown, numbered
from gridlens.llm.shared import bounded_batches, dropped, stored

VOCABULARY = "word_bpe_49k.json"
#: Bytes of a run without a separator from which it is cut, and symbols of a leaf.
LEAF = 1024
#: Characters of a text from which its parts are encoded in tasks of their own, and of such a part.
PART = 1 << 16
#: Words that a worker keeps; beyond that it starts anew.
KEPT_WORDS = 2_000_000
_encoders: dict[tuple[str, int], WordBpe] = {}

# The normaliser and splitter for which cuts are right.
NORMALISER = [("NFC",), ("Replace", r"\s+", " "), ("Lowercase",)]
SPLITTER = [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel",)]

SEPARATORS = " \t\n\x0b\x0c\r"
#: Plain letters: no normaliser joins two of them. Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, ideographs, Hangul.
LETTERS = "A-Za-z\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0928\u092a-\u0930\u0e01-\u0e2e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fd0\uac00-\ud7a3"
#: Plain marks: those of ASCII but what contractions and special tokens are written with.
MARKS = re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{}~")
_SEPARATOR = re.compile(f"[{SEPARATORS}]")
#: Between plain characters; contractions end within three characters of their apostrophe.
_PLAIN_CUT = re.compile(f"(?<=[{LETTERS}{MARKS}0-9]{{4}})(?=[{LETTERS}{MARKS}0-9])")
_CLOSED = re.compile(f"[{SEPARATORS}]|(?<=[{LETTERS}])(?=[{MARKS}0-9])|(?<=[{MARKS}])(?=[{LETTERS}0-9])|(?<=[0-9])(?=[{LETTERS}{MARKS}0-9])")
_LETTER, _MARK = re.compile(f"[{LETTERS}]"), re.compile(f"[{MARKS}]")


def encoder(path: str, leaf: int = LEAF) -> WordBpe:
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = WordBpe(path, leaf)
    return _encoders[path, leaf]


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for kind, pattern in ((1, "[A-Za-z]"), (2, f"[{MARKS}]"), (3, "[0-9]")):
        out[[k for k in range(128) if re.match(pattern, chr(k))]] = kind
    return out


_KIND = _kinds()


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``textkit.words``, but words are also parted at closed cuts between ASCII characters, so fewer of them differ."""
    kind = _KIND[data]
    cuts = np.zeros(len(data), bool)
    left, right = kind[:-1], kind[1:]
    cuts[1:] = (left > 0) & (right > 0) & ((left != right) | (right == 3))
    return K._runs(~K._SEP[data], off, cuts)


def _small_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters that no normaliser changes: a to z, and in two bytes those from U+00DF to U+00FF (but the sign U+00F7)."""
    out = (data >= 0x61) & (data <= 0x7A)
    pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] <= 0xBF) & (data[1:] != 0xB7))
    out[pair] = out[pair + 1] = True
    return out


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Spans with a space behind each, and where each begins and the last ends."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(to[-1]), 0x20, np.uint8)
    step = np.arange(int(size.sum()))
    before = np.cumsum(size) - size
    out[step + np.repeat(to[:-1] - before, size)] = data[step + np.repeat(starts - before, size)]
    return out.tobytes(), to


def check_rules(path: str) -> None:
    """Refuses a vocabulary whose normaliser or splitter is another."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)

    def steps(rule: dict | None, names: str) -> list[tuple]:
        out = []
        for x in (rule or {}).get(names) or ([rule] if rule else []):
            pattern = x.get("pattern") or {}
            out.append((x["type"], *([pattern["Regex"]] if "Regex" in pattern else []), *([x["content"]] if "content" in x else [])))
        return out

    if steps(held["normalizer"], "normalizers") != NORMALISER or steps(held["pre_tokenizer"], "pretokenizers") != SPLITTER or held["model"].get("type") != "BPE":
        raise ValueError(f"{path} normalises or splits texts otherwise than this operator can cut them")


class WordBpe:
    def __init__(self, path: str, leaf: int = LEAF):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        check_rules(path)
        self.tok = Tokenizer.from_file(path)
        #: The same vocabulary for words of plain letters with spaces between.
        self.letters = Tokenizer(self.tok.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf = leaf
        self.path = path
        self._merges: dict[tuple[int, int], tuple[int, int]] | None = None
        self._names: list[bytes] | None = None
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        self.marked_ends = self._marked_ends()
        self.forget()

    # -- encoding ---------------------------------------------------------------

    def forget(self) -> None:
        """No words known. ``at`` has the range of each known word's ids in ``pool``."""
        self.known = Memo()
        self.at = np.zeros((1 << 12) + 1, np.int64)
        self.pool = np.zeros(1 << 14, np.uint32)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.known.n > KEPT_WORDS:
            self.forget()
        data = self.lowered(data, off)
        starts, ends, first = units(data, off)
        found, odd = numbered(self.known, data, starts, ends, lambda one: self.learn(data, starts[one], ends[one]))
        size = self.at[found + 1] - self.at[found] if len(found) else np.zeros(0, np.int64)
        apart = [self.solve(data, starts[k : k + 1], ends[k : k + 1])[1] for k in odd]
        size[odd] = [len(x) for x in apart]
        edge = np.concatenate([[0], np.cumsum(size)])
        begin = self.at[found]
        begin[odd] = 0
        if len(odd):
            self.pool = grown(self.pool, int(size[odd].max()))
        ids = self.pool[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)]
        for k, x in zip(odd, apart, strict=True):
            ids[edge[k] : edge[k + 1]] = x
        ids = ids.astype("<u4").tobytes()
        cuts = 4 * edge[first]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, text: bytes) -> bytes:
        return self.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))[0]

    @staticmethod
    def lowered(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Lower case is what the normaliser makes of ASCII letters anyway, so fewer words differ; not in texts with combining marks or with what could spell a special token."""
        odd = data >= 0xCC
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        plain = np.diff(np.concatenate([[0], np.cumsum(odd)])[off]) == 0
        upper = (data >= 0x41) & (data <= 0x5A) & np.repeat(plain, np.diff(off))
        return data + (upper.view(np.uint8) << 5)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the ids of new words, behind those of the words known so far."""
        size, ids = self.solve(data, starts, ends)
        n, new = self.known.n, len(starts)
        self.at = grown(self.at, n + new + 1)
        begin = int(self.at[n])
        self.pool = grown(self.pool, begin + len(ids))
        self.pool[begin : begin + len(ids)] = ids
        self.at[n + 1 : n + new + 1] = begin + np.cumsum(size)

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of words, and all their ids in order: by the library, of long words by the tree."""
        size = np.zeros(len(starts), np.int64)
        # A word of plain letters is one piece, which normalising doesn't change and whose last token has the end mark. So
        # such words are encoded many to a text, without normaliser and splitter, and told apart.
        plain, some = np.zeros(0, np.int64), []
        if self.marked_ends is not None:
            marks = np.concatenate([[0], np.cumsum(~_small_letters(data))])
            plain = np.flatnonzero((marks[ends] == marks[starts]) & (ends - starts <= self.leaf))
            body, cuts = _spaced(data, starts[plain], ends[plain])
            some = [body[a : b - 1].decode() for a, b in zip(cuts[:-1:500], [*cuts[500:-1:500], cuts[-1]], strict=True)] if len(plain) else []
        found = [x.ids for x in self.letters.encode_batch_fast(some, add_special_tokens=False)] if some else []
        easy = np.fromiter(chain.from_iterable(found), np.uint32)
        if len(plain):
            last = np.flatnonzero(self.marked_ends[easy]) + 1
            if len(last) == len(plain):
                size[plain] = np.diff(last, prepend=0)
            else:
                plain, easy = plain[:0], easy[:0]
        hard: dict[int, list[int]] = {}
        rest = np.setdiff1d(np.arange(len(starts)), plain, assume_unique=True)
        texts = {int(k): data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in rest}
        for lo in range(0, len(rest), 2000):
            part = rest[lo : lo + 2000].tolist()
            done = iter(self.tok.encode_batch_fast([texts[k] for k in part if len(texts[k]) <= self.leaf], add_special_tokens=False))
            for k in part:
                hard[k] = next(done).ids if len(texts[k]) <= self.leaf else self.long(texts[k])
                size[k] = len(hard[k])
        begin = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.uint32)
        ids[np.arange(len(easy)) + np.repeat(begin[plain] - (np.cumsum(size[plain]) - size[plain]), size[plain])] = easy
        for k, x in hard.items():
            ids[begin[k] : begin[k] + len(x)] = x
        return size, ids

    def pieces(self, run: str) -> list[int | str]:
        """Ids of special tokens, and the splitter's pieces between them."""
        out: list[int | str] = []
        for part in self.cut.split(run):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [piece for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out

    def piece_ids(self, piece: int | str, ended: bool = True) -> list[int]:
        if isinstance(piece, int):
            return [piece]
        if ended and len(piece) <= self.leaf:
            return [t.id for t in self.tok.model.tokenize(piece)]
        return self.tree(self.symbols(piece, ended))

    def long(self, run: str) -> list[int]:
        """Ids of a long run without separators."""
        return [i for piece in self.pieces(run) for i in self.piece_ids(piece)]

    def _marked_ends(self) -> np.ndarray | None:
        """Which ids end a piece; None if the vocabulary has no mark for that, or splits letters otherwise than expected."""
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        probe = self.tok.pre_tokenizer.pre_tokenize_str("ab cé,, d") if self.tok.pre_tokenizer else []
        if not suffix or len(probe) != 4:
            return None
        return np.array([n.endswith(suffix.encode()) for n in self.names])

    @property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Pair of ids to its rank and the id it becomes."""
        if self._merges is None:
            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocab = model["vocab"]
            self._suffix = model.get("end_of_word_suffix") or ""
            pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
            self._merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
            self._vocab = vocab
        return self._merges

    def symbols(self, piece: str, ended: bool = True) -> list[int]:
        self.merges  # noqa: B018  reads the vocabulary
        return [self._vocab[c] for c in piece[:-1]] + [self._vocab[piece[-1] + (self._suffix if ended else "")]]

    def spelled(self, ids: list[int]) -> list[int]:
        """The symbols that tokens are made of."""
        out: list[int] = []
        for i in ids:
            name = self.tok.id_to_token(i)
            ended = name.endswith(self._suffix) and len(name) > len(self._suffix)
            out += self.symbols(name.removesuffix(self._suffix) if ended else name, ended)
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain BPE over symbols: least rank first, leftmost of equals."""
        merges, n = self.merges, len(symbols)
        ids, live = list(symbols), [True] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], live[j] = new, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, m[1]))
        return [ids[i] for i in range(n) if live[i]]

    def tree(self, symbols: list[int]) -> list[int]:
        """Leaves first, then joins level by level."""
        row = [self.merge(symbols[k : k + self.leaf]) for k in range(0, len(symbols), self.leaf)]
        while len(row) > 1:
            row = [self.join(row[k], row[k + 1]) for k in range(0, len(row) - 1, 2)] + row[len(row) - len(row) % 2 :]
        return row[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbours inside one piece as one."""
        width = 4
        while left and right:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.merge(self.spelled(left[a:]) + self.spelled(right[:b]))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            width *= 2
        return left + right

    # -- parts of long texts ----------------------------------------------------

    def cuts(self, text: str, part: int) -> list[tuple[int, bool]]:
        """Where parts of about ``part`` characters end, and whether that cut is open."""
        out, at = [], part
        while at < len(text):
            near = _SEPARATOR.search(text, at, at + part // 4)
            m = near or next((m for m in _PLAIN_CUT.finditer(text, at) if not self._inside(text, m.start())), None) or _SEPARATOR.search(text, at)
            if not near and m and (first := _SEPARATOR.search(text, at, m.start() + 1)):
                m = first
            if m is None or m.end() >= len(text):
                break
            end = m.end()
            both = text[end - 1 : end + 1]
            out.append((end, any(len(kind.findall(both)) == 2 for kind in (_LETTER, _MARK))))
            at = end + part
        return [*out, (len(text), False)]

    def _inside(self, text: str, at: int) -> bool:
        """Whether a special token's string goes through a place."""
        return any(x in text[max(0, at - len(x) + 1) : at + len(x) - 1] for x in self.added)

    def segment(self, text: str, left: bool, right: bool) -> Segment:
        """A part between cuts of which the left or the right may be open."""
        if not left and not right:
            return Segment(b"", self.ids(text.encode()), b"", False)
        closed = [m.end() for m in _CLOSED.finditer(text) if m.end()]
        if not closed:
            return self._fragment(text, left, right)
        a, b = closed[0] if left else 0, closed[-1] if right else len(text)
        head = self._fragment(text[:a], left, False)
        tail = self._fragment(text[b:], False, right)
        return Segment(head.head, head.body + self.ids(text[a:b].encode()) + tail.body, tail.tail, False)

    def _fragment(self, text: str, left: bool, right: bool) -> Segment:
        pieces = self.pieces(text)
        if not pieces:
            return Segment(b"", b"", b"", False)
        if left and right and len(pieces) == 1:
            return Segment(packed(self.piece_ids(pieces[0], False)), b"", b"", True)
        inner = pieces[left : len(pieces) - right] if len(pieces) > 1 else [] if left or right else pieces
        return Segment(
            packed(self.piece_ids(pieces[0])) if left else b"",
            packed([i for x in inner for i in self.piece_ids(x)]),
            packed(self.piece_ids(pieces[-1], False)) if right else b"",
            False,
        )

    def together(self, a: Segment, b: Segment) -> Segment:
        """Two neighbours as one."""
        self.merges  # noqa: B018  reads the vocabulary
        seam = packed(self.join(unpacked(a.head if a.whole else a.tail), unpacked(b.head)))
        if a.whole:
            return Segment(seam, b.body, b.tail, b.whole)
        if b.whole:
            return Segment(a.head, a.body, seam, False)
        return Segment(a.head, a.body + seam + b.body, b.tail, False)

    # -- decoding ---------------------------------------------------------------

    @property
    def names(self) -> list[bytes]:
        if self._names is None:
            n = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
            self._names = [(self.tok.id_to_token(i) or "").encode() for i in range(n)]
        return self._names

    def text(self, ids: np.ndarray) -> bytes:
        """What the library's decode makes of ids, special tokens included: this vocabulary has no decoder, so names with a space between; unknown ids are left out."""
        if self.tok.decoder is not None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False).encode()
        names = self.names
        if len(ids) and int(ids.max()) >= len(names):
            ids = ids[ids < len(names)]
        return b" ".join(map(names.__getitem__, ids.tolist()))


def token_batches(batch: pa.RecordBatch, column: str, bpe: WordBpe) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of bounded size with the ids of each text."""
    data, off = K.buffers(batch[column])
    for lo, hi in K.slices(off):
        yield batch.slice(lo, hi - lo), bpe.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


class Segment(NamedTuple):
    """A run of parts: ids of the piece that an open left cut goes through, of what stands between, and of the piece at an open right cut. ``whole``: all of it is one piece between two open cuts, and in ``head``."""

    head: bytes
    body: bytes
    tail: bytes
    whole: bool


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def long_texts(packed: DataFrame, path: str, leaf: int, part: int) -> DataFrame:
    """row and ids of long texts: parts are encoded apart from each other and joined, two neighbours at a time where a piece goes through a cut."""
    spark, row = packed.sparkSession, packed.schema["row"]
    keys = [T.StructField("key", T.LongType()), T.StructField("place", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("open", T.BooleanType())]
    cut_schema = T.StructType([row, *keys, T.StructField("left", T.BooleanType()), T.StructField("right", T.BooleanType()), T.StructField("part", T.StringType())])
    seg_schema = T.StructType([row, *keys, *[T.StructField(c, T.BinaryType()) for c in ("head", "body", "tail")], T.StructField("whole", T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, leaf)
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch["text"][k].as_buffer().to_pybytes().decode("utf-8", "replace")
                ends = bpe.cuts(text, part)
                n, at, before = len(ends), 0, False
                made_open = any(is_open for _, is_open in ends)
                for lo in range(0, n, 64):
                    some = ends[lo : lo + 64]
                    rows = batch["row"].take(pa.array([k] * len(some)))
                    starts = [at, *[e for e, _ in some[:-1]]]
                    lefts = [before, *[o for _, o in some[:-1]]]
                    at, before = some[-1]
                    yield pa.RecordBatch.from_arrays(
                        [rows, pa.array([batch["key"][k].as_py()] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int64()), pa.array([n] * len(some), pa.int64()), pa.array([made_open] * len(some)), pa.array(lefts), pa.array([o for _, o in some]), pa.array([text[a:b] for a, (b, _) in zip(starts, some, strict=True)], pa.string())],
                        names=cut_schema.names,
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, leaf)
        for batch in batches:
            for k in range(batch.num_rows):
                x = bpe.segment(batch["part"][k].as_py(), batch["left"][k].as_py(), batch["right"][k].as_py())
                some = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*[some[c] for c in ("row", "key", "place", "parts", "open")], *[pa.array([v], pa.binary()) for v in x[:3]], pa.array([x.whole])], names=seg_schema.names)

    def segments(table: pa.Table) -> list[Segment]:
        return [Segment(*x) for x in zip(*[table[c].to_pylist() for c in Segment._fields], strict=True)]

    def two(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        some = segments(table)
        x = encoder(path, leaf).together(*some) if len(some) == 2 else some[0]
        lead = table.slice(0, 1)
        return pa.table([lead["row"], lead["key"], pa.array([lead["place"][0].as_py() >> 1], pa.int64()), lead["parts"], lead["open"], *[pa.array([v], pa.binary()) for v in x[:3]], pa.array([x.whole])], names=seg_schema.names)

    def all_closed(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return pa.table({"row": table["row"].slice(0, 1), "ids": pa.array([b"".join(table["body"].to_pylist())], pa.binary())})

    keyed = packed.select("row", "text", F.monotonically_increasing_id().alias("key"))
    parts = keyed.mapInArrow(cut, cut_schema).repartition("key", "place").mapInArrow(encode, seg_schema)
    found = stored(parts, "parts", even=False)
    # what is read back may be null
    row, seg_schema = found.schema["row"], found.schema
    made = T.StructType([row, T.StructField("ids", T.BinaryType())])
    closed = found.where("NOT open").groupBy("key").applyInArrow(all_closed, made)
    most = found.where("open").agg(F.max("parts")).first()[0] or 0
    if not most:
        return closed
    joined = found.where("open")
    for _ in range((most - 1).bit_length()):
        before, joined = joined, stored(joined.groupBy("key", F.shiftright("place", 1)).applyInArrow(two, seg_schema), "parts", even=False)
        dropped(before)
    return closed.unionByName(joined.select("row", F.concat("head", "body", "tail").alias("ids")))


def round_trip(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """Encodes every whole text and decodes the ids again; only the parts of texts of more than ``part`` characters are shuffled.

    Returns the columns ``keep`` (all but ``text`` by default), ids (binary: little-endian
    unsigned 32-bit integers), n_tokens and decoded. Columns named like an output are
    replaced by it. Null and empty texts, and texts of separators alone, have no ids and
    decode to "". Rows may repeat; an empty table gives an empty result. A vocabulary of other rules raises ValueError.

    Parts of long texts are encoded and written to the shared folder when this is called; the rest is lazy.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    bounded_batches(df.sparkSession)
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(_q(c)) for c in keep]).alias("row"), F.col(_q(text)).cast("string").alias("text"))
    made = T.StructType([packed.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def spelled(rows: pa.Array, ids: list[bytes], bpe: WordBpe) -> pa.RecordBatch:
        back = [bpe.text(np.frombuffer(x, "<u4")) for x in ids]
        return pa.RecordBatch.from_arrays([rows, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(back, pa.binary()).cast(pa.string())], names=made.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, leaf)
        for batch in batches:
            for piece, ids in token_batches(batch, "text", bpe):
                yield spelled(piece["row"], ids, bpe)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, leaf)
        for batch in batches:
            for k in range(batch.num_rows):
                yield spelled(batch["row"].slice(k, 1), [batch["ids"][k].as_py()], bpe)

    check_rules(path)
    size = F.coalesce(F.length("text"), F.lit(0))
    short = packed.where(size <= part).mapInArrow(whole, made)
    long = long_texts(packed.where(size > part), path, leaf, part)
    long = long.mapInArrow(decode, T.StructType([long.schema["row"], *made.fields[1:]]))
    return unpack(short.unionByName(long), keep, made.names[1:])


def op10_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs, "text", ["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
