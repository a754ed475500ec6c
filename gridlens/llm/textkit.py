"""Word, line and hash kernels over Arrow string buffers, vectorised with NumPy.

All of them work on UTF-8 bytes. The separators of words (space, tab, LF, VT, FF, CR)
are ASCII bytes, which never occur inside a longer UTF-8 sequence, so words found in
bytes are the words ``[^\\x20\\x09-\\x0D]+`` of the text.

Hashes are 64 bits, not linear anywhere: a span folds its bytes in eight at a time with a
multiply-and-shift mix between (xxh3 beyond ``LANES`` of these), and a window is mixed from the two windows
of half its length. N different strings have about N^2 / 2^65 colliding pairs, and no pattern of repetition
makes one (sums of powers modulo 2^64 do collide on such patterns). Where results must be exact,
``memo`` compares the bytes too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SLICE_BYTES = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Eights of bytes up to which spans are hashed many at a time.
LANES = 16
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_LANE, _LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, body = texts.buffers()
    off = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone. After the last one memory goes back."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
    release()


def release() -> None:
    """Gives memory that is free inside this process back to the system: workers live long and stand beside a JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


# of the GNU C library; others have none
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (one more entry than documents)."""
    return _runs(~_SEP[data], off)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every ``\\n``-split line, empty ones included, and each document's first line.

    A document of n line feeds has n + 1 lines; an empty one has one empty line.
    """
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(off, feeds, side="right") - 1
    n = len(off) - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n) + 1)]).astype(np.int64)
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    slot = np.arange(len(feeds)) + owner
    starts[first[:-1]] = off[:-1]
    starts[slot + 1] = feeds + 1
    ends[first[1:] - 1] = off[1:]
    ends[slot] = feeds
    return starts, ends, first


def _runs(inside: np.ndarray, off: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes inside; a run also ends before each byte of ``cuts``."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[off] = True
    if cuts is not None:
        edge[:-1] |= cuts
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros stand behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)))


def lanes(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k-th eight bytes of spans, for k = 0, 1 and so on: which spans reach that far, and the bytes, zeros behind their ends."""
    at, k = np.flatnonzero(sizes > 0), 0
    while len(at):
        left = sizes[at] - 8 * k
        part = view[starts[at] + 8 * k]
        part &= _FIRST[np.minimum(left, 8)]
        yield at, part
        k += 1
        at = at[left > 8]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """Hash of the bytes from each start to its end; ``view`` is what ``eights`` makes of data, if at hand."""
    sizes = ends - starts
    out = mix(sizes.astype(U) + _RIGHT)
    wide = np.flatnonzero(sizes > 8 * LANES)
    view = eights(data) if view is None else view
    with np.errstate(over="ignore"):
        for at, part in lanes(view, starts, np.where(sizes > 8 * LANES, 0, sizes)):
            out[at] = mix((out[at] ^ part) * _LANE)
    if len(wide):
        body = memoryview(np.ascontiguousarray(data))
        out[wide] = [xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)]
    return out


def joined(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    """Hash of two windows that begin ``apart`` words from each other."""
    with np.errstate(over="ignore"):
        return mix(left * _LEFT + (right ^ (right >> U(29))) * _RIGHT + U(apart))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on, by doubling; positions run on over the ends of documents, so mask them with ``room``."""
    if len(hashes) < length:
        return hashes[:0]
    have, out = 1, hashes
    while have * 2 <= length:
        out = joined(out[: len(out) - have], out[have:], have)
        have *= 2
    rest = length - have
    return joined(out[: len(out) - rest], out[rest:], rest) if rest else out


def word_sequence(body: bytes) -> bytes:
    """128-bit hash of the words of a text, in order."""
    return xxhash.xxh3_128_digest(b" ".join(body.split()))


def room(first: np.ndarray, n_words: int) -> np.ndarray:
    """Words from each word to its document's end, itself included."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(n_words)


def slide(values: np.ndarray, length: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of each ``length`` consecutive values, by doubling."""
    if len(values) < length:
        return values[:0]
    have, out = 1, values
    while have * 2 <= length:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    rest = length - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among ``known`` (sorted); a bitmap answers most of them."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    bits = min(24, max(10, int(len(known)).bit_length() + 4))
    table = np.zeros(1 << bits, dtype=bool)
    table[(known >> U(64 - bits)).astype(np.int64)] = True
    out = table[(values >> U(64 - bits)).astype(np.int64)]
    hit = np.flatnonzero(out)
    at = np.searchsorted(known, values[hit])
    out[hit] = known[np.minimum(at, len(known) - 1)] == values[hit]
    return out


def cover(marked: np.ndarray, length: int) -> np.ndarray:
    """Positions within ``length`` of a marked start; a mark must not stand closer than that to its document's end."""
    at = np.flatnonzero(marked)
    step = np.bincount(at, minlength=len(marked) + 1)
    step -= np.bincount(np.minimum(at + length, len(marked)), minlength=len(marked) + 1)
    return np.cumsum(step[:-1]) > 0
