"""Token ids in files, compressed by Re-Pair per shard.

Documents are sorted by id and encoded; each task cuts its range into shards of about
``SHARD_IDS`` ids. In a shard frequent pairs of neighbouring ids are replaced by new
ids (nonterminals), level after level, from the most frequent down: a level replaces the
pairs that occur at least a quarter as often as the most frequent one, and those that become so frequent by it; the last one finds no pair
``MIN_COUNT`` times. A pair never crosses
the end of a document, so each document is a range of the compressed sequence.

A file is a Parquet row per shard: part, shard, start (ids before it in its part),
n_ids, docs (kept columns, n_tokens, at: where the document begins in the compressed sequence)
and grammar, a binary cell: header ``<4sIIQ`` of magic ``RPG1``, first nonterminal, number
of rules, length of the sequence; then, each as a 32-bit length and a zstd frame of
little-endian 32-bit integers: left and right sides of the rules, their expansion lengths,
the sequence. Expansion lengths let a reader find any id without expanding what stands before.
Spark's writer puts the rows in the shared folder, so a lost task is written again and
half-written files never show.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridlens.llm import wordbpe
from gridlens.llm.blocks import _q, unpack
from gridlens.llm.shared import bounded_batches, fresh_path

SHARD_IDS = 1 << 20
END_ID = 2
#: A rule costs its two sides, so a pair pays from three occurrences on; at two, files grow again.
MIN_COUNT = 3
_HEAD = struct.Struct("<4sIIQ")
_HASH_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def compress(ids: np.ndarray, ends: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, rules (n x 2), expansion lengths of the rules, and where each document begins in the sequence.

    ``ends``: index after each document's last id. Nonterminals count on from ids.max() + 1.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq, edges = ids.astype(np.uint32), ends.astype(np.int64) - 1
    rules: list[np.ndarray] = []
    fresh, floor = None, len(seq)

    def named(names: np.ndarray, which: np.ndarray) -> np.ndarray:
        """New ids for different pairs, and of each place the one that it gets."""
        begin = base + sum(map(len, rules))
        rules.append(np.stack([(names >> np.uint64(32)).astype(np.uint32), names.astype(np.uint32)], 1))
        return (begin + which).astype(np.uint32)

    while len(seq) > 1:
        chosen = np.zeros(0, np.int64)
        if fresh is not None:
            # what has become frequent since the last full count has a nonterminal of the round before in it
            new = np.zeros(len(seq) + 1, bool)
            new[fresh] = new[fresh - 1] = True
            new[edges] = new[-1] = False
            at = np.flatnonzero(new)
            keys = _pairs(seq, at)
            some = _likely(keys, floor)
            at = at[some]
            take, _, names, which = _apart(keys[some], np.diff(at) == 1, floor, floor)
            chosen = at[take]
        if not len(chosen):
            # while frequent pairs are few, a small table that stays in the cache tells them well enough
            chosen, names, which, floor = _frequent(seq, edges, min_count, _HASH_BITS if floor <= 16 else _HASH_BITS - 3)
            if floor == min_count:
                seq, edges = _settle(seq, edges, chosen, min_count, named)
                break
        seq[chosen] = named(names, which)
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        seq = seq[keep]
        edges -= np.searchsorted(chosen + 1, edges, side="right")
        # few replacements bring few more: the next level finds them
        fresh = chosen - np.arange(len(chosen)) if 1024 * len(chosen) > len(seq) else None
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    sizes = np.ones(base + len(table), np.int64)
    done = base
    for r in rules:
        sizes[done : done + len(r)] = sizes[r[:, 0]] + sizes[r[:, 1]]
        done += len(r)
    starts = np.concatenate([[0], edges[:-1] + 1]) if len(seq) else np.zeros(0, np.int64)
    return seq, table, sizes[base:].astype(np.uint32), starts.astype(np.int64)


def _pairs(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]


def _told(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in the order in which they come, and which of them each is; by a hash table, as sorting takes several times as long."""
    held = pa.array(keys).dictionary_encode()
    return held.dictionary.to_numpy(), held.indices.to_numpy()


def _odd(after: np.ndarray) -> np.ndarray:
    """Of places that overlap the one before, in order, those to leave: the first of each run, the third and so on."""
    head = np.ones(len(after), bool)
    head[1:] = np.diff(after) != 1
    begin = np.flatnonzero(head)[np.cumsum(head) - 1]
    return after[(np.arange(len(after)) - begin) % 2 == 0]


def _frequent(seq: np.ndarray, edges: np.ndarray, min_count: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of pairs that stand at least a quarter as often as the most frequent one, none overlapping; the different pairs and which of them each is; and the least count that was asked for, lower where that gives none.

    Where that count is ``min_count``, all places of pairs that may stand so often, overlapping or not, without names. Counts are by hash
    first, which leaves few places to count exactly; no pair begins at ``edges``, where documents end.
    """
    with np.errstate(over="ignore"):
        slot = seq[:-1] * np.uint32(0x9E3779B1)
        slot += seq[1:] * np.uint32(0x85EBCA77)
    slot >>= np.uint32(32 - bits)
    slot = slot.astype(np.int64)
    tally = np.bincount(slot, minlength=1 << bits)
    np.subtract.at(tally, slot[edges[:-1]], 1)
    floor = max(min_count, int(tally.max()) // 4)
    while True:
        some = (tally >= floor)[slot]
        some[edges[:-1]] = False
        at = np.flatnonzero(some)
        if floor == min_count:
            return at, np.zeros(0, np.uint64), np.zeros(0, np.int32), floor
        take, _, names, which = _apart(_pairs(seq, at), np.diff(at) == 1, floor, min_count)
        if len(take):
            return at[take], names, which, floor
        floor = max(min_count, floor // 2)


def _likely(keys: np.ndarray, floor: int) -> np.ndarray:
    """Where many keys are: the places of those that may stand ``floor`` times; most are too rare even if all that share a hash were the same."""
    if len(keys) < 1 << 12:
        return np.arange(len(keys))
    slot = ((keys * _MIX) >> np.uint64(64 - _HASH_BITS + 3)).astype(np.int64)
    return np.flatnonzero((np.bincount(slot) >= floor)[slot])


def _apart(keys: np.ndarray, near: np.ndarray, floor: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at some places, in order, which to take, none overlapping: those that stand ``floor`` times, and of these those that then have ``min_count`` places; ``near`` tells where a pair overlaps the next.

    Returns which are taken and which stand so often but are not, and of those taken the different pairs, sorted, and which of them each is.
    The more frequent pair goes first, so the most frequent one keeps all its places.
    """
    names, which = _told(keys)
    # a pair of equal ids overlaps itself: every other place of a run
    single = np.ones(len(keys), bool)
    single[_odd(np.flatnonzero(near & (which[1:] == which[:-1])) + 1)] = False
    counts = np.bincount(which[single], minlength=len(names))
    enough = (counts >= floor)[which]
    some = np.flatnonzero(enough & single)
    which = which[some]
    # of two that overlap the one of lower rank gives way, unless it has lost its own place; equals in no order that a text follows
    rank = np.empty(len(counts), np.int32)
    rank[np.lexsort((names * _MIX, -counts))] = np.arange(len(counts), dtype=np.int32)
    rank = rank[which]
    won, free = np.zeros(len(some), bool), np.arange(len(some))
    while len(free):
        meets = (np.diff(some[free]) == 1) & near[some[free[:-1]]]
        first = rank[free[1:]] < rank[free[:-1]]
        wins = np.ones(len(free), bool)
        wins[1:] &= ~meets | first
        wins[:-1] &= ~(meets & first)
        won[free[wins]] = True
        out = wins.copy()
        out[1:] |= wins[:-1] & meets
        out[:-1] |= wins[1:] & meets
        free = free[~out]
    some, which = some[won], which[won]
    good = np.bincount(which, minlength=len(counts)) >= min_count
    kept = good[which]
    some, which = some[kept], which[kept]
    enough[some] = False
    good = np.flatnonzero(good)
    order = good[np.argsort(names[good])]
    to = np.zeros(len(names), np.int32)
    to[order] = np.arange(len(order), dtype=np.int32)
    return some, np.flatnonzero(enough), names[order], to[which]


def _settle(seq: np.ndarray, edges: np.ndarray, places: np.ndarray, min_count: int, named: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Replaces until no pair stands ``min_count`` times. ``places`` has all those of pairs that do. The sequence is a linked list meanwhile, so a round costs no more than the places it looks at.

    A pair gets its places at once, when the later of its two ids is made, and only loses some from then on. So after each round
    only neighbours of its replacements are looked at, and when these give nothing more, what stood often enough when it was last counted.
    """
    n = len(seq)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    end, gone = np.zeros(n + 1, bool), np.zeros(n, bool)
    end[edges] = end[-1] = True
    at, open_, whole = places, [], True
    while True:
        keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[after[at]]
        some = _likely(keys, min_count)
        at = at[some]
        take, left, names, which = _apart(keys[some], after[at[:-1]] == at[1:], min_count, min_count)
        open_.append(at[left])
        fresh = at[take]
        if len(fresh):
            lost = after[fresh]
            seq[fresh] = named(names, which)
            end[fresh] = end[lost]
            gone[lost] = True
            after[fresh] = after[lost]
            inner = after[fresh] < n
            before[after[fresh[inner]]] = fresh[inner]
            at, whole = np.unique(np.concatenate([fresh, before[fresh]])), False
        elif whole:
            break
        else:
            at, open_, whole = np.unique(np.concatenate(open_)), [], True
            at = at[~gone[at]]
        # a place before the first is -1, which stands for the end
        at = at[~end[at]]
    keep = ~gone
    return seq[keep], np.flatnonzero(end[:-1][keep])


def expand(seq: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids that a (part of a) sequence stands for."""
    while len(at := np.flatnonzero(seq >= base)):
        width = np.ones(len(seq), np.int64)
        width[at] = 2
        to = np.cumsum(width) - width
        out = np.empty(int(to[-1] + width[-1]), np.uint32)
        out[to] = seq
        out[to[at]], out[to[at] + 1] = rules[seq[at] - base, 0], rules[seq[at] - base, 1]
        seq = out
    return seq


def pack(base: int, seq: np.ndarray, rules: np.ndarray, sizes: np.ndarray) -> bytes:
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(np.ascontiguousarray(x, "<u4").tobytes()) for x in (rules[:, 0], rules[:, 1], sizes, seq)]
    return _HEAD.pack(b"RPG1", base, len(rules), len(seq)) + b"".join(struct.pack("<I", len(p)) + p for p in parts)


class Shard:
    """A reader of one grammar cell."""

    def __init__(self, cell: bytes):
        magic, self.base, n_rules, n = _HEAD.unpack_from(cell)
        if magic != b"RPG1":
            raise ValueError("not a token shard")
        at, parts, unpress = _HEAD.size, [], zstandard.ZstdDecompressor()
        for count in (n_rules, n_rules, n_rules, n):
            size = struct.unpack_from("<I", cell, at)[0]
            body = unpress.decompress(cell[at + 4 : at + 4 + size], max_output_size=max(1, 4 * count)) if count else b""
            parts.append(np.frombuffer(body, "<u4"))
            at += 4 + size
        self.rules, self.sizes, self.seq = np.stack(parts[:2], 1), parts[2], parts[3]

    def widths(self) -> np.ndarray:
        """Ids that each symbol of the sequence stands for."""
        out = np.ones(len(self.seq), np.int64)
        deep = self.seq >= self.base
        out[deep] = self.sizes[self.seq[deep] - self.base]
        return out

    def all(self) -> np.ndarray:
        """Every id: each rule is expanded once and copied to where it stands."""
        if not len(self.rules):
            return self.seq
        flat = np.concatenate([np.arange(self.base, dtype=np.uint32), expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32), self.base, self.rules)])
        size = np.concatenate([np.ones(self.base, np.int64), self.sizes])
        begin, width = (np.cumsum(size) - size)[self.seq], size[self.seq]
        return flat[np.arange(int(width.sum())) + np.repeat(begin - (np.cumsum(width) - width), width)]

    def document(self, begin: int, end: int | None) -> np.ndarray:
        """A document by its range of the sequence."""
        return expand(self.seq[begin:end], self.base, self.rules)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end - 1 of the shard; only symbols that reach into that range are expanded."""
        edge = np.cumsum(self.widths())
        a = int(np.searchsorted(edge, begin, side="right"))
        b = int(np.searchsorted(edge, end, side="left")) + 1
        skip = begin - (int(edge[a - 1]) if a else 0)
        return expand(self.seq[a:b], self.base, self.rules)[skip : skip + end - begin]


def write_tokens(df: DataFrame, path: str, text: str = "text", order: str = "doc_id", keep: list[str] | None = None, vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes every whole text, ends each document with ``end_id`` and writes shards in ascending order of ``order``.

    Null ids come first; rows of one id are ordered by text. Null and empty texts are
    documents of the end id alone. Rows may repeat; an empty table makes a file without rows.
    """
    spark = df.sparkSession
    keep = [order] if keep is None else keep
    tokenizer = vocabulary or public_tokenizers.path(wordbpe.VOCABULARY)
    tail = np.array([end_id], "<u4").tobytes()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = F.col(_q(text)).cast("string").alias("text")
    bounded_batches(df.sparkSession)
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(_q(c)) for c in keep]).alias("row"), F.col(_q(order)).alias("order"), texts)
    dealt = packed.repartitionByRange(n, F.col("order"), F.xxhash64("text")).sortWithinPartitions("order", F.xxhash64("text"), "text").select("row", "text")
    doc = T.StructType([packed.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("at", T.LongType())])
    made = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("docs", T.ArrayType(doc)), T.StructField("grammar", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, shard, start = wordbpe.encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        rows, cells, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(cells), "<u4")
            sizes = np.array([len(x) // 4 for x in cells], np.int64)
            seq, rules, lengths, at = compress(ids, np.cumsum(sizes))
            docs = pa.StructArray.from_arrays([pa.concat_arrays(rows), pa.array(sizes), pa.array(at)], names=["row", "n_tokens", "at"])
            cell = pack(int(ids.max()) + 1, seq, rules, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([cell], pa.binary())], names=made.names)

        for batch in batches:
            for piece, found in wordbpe.token_batches(batch, "text", bpe):
                rows.append(piece["row"])
                cells += [x + tail for x in found]
                size += sum(len(x) // 4 + 1 for x in found)
                if size >= shard_ids:
                    yield flush()
                    shard, start = shard + 1, start + size
                    rows, cells, size = [], [], 0
        if cells:
            yield flush()

    dealt.mapInArrow(run, made).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: the kept columns, start (ids of all documents before), n_tokens and ids (binary, little-endian 32-bit) of each document.

    The driver adds up one number per part (a partition of the write).
    """
    shards = spark.read.parquet(path)
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, base = 0, {}
    for part in sorted(totals):
        base[part] = before
        before += totals[part]
    row = shards.schema["docs"].dataType.elementType["row"]
    made = T.StructType([row, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs = batch["docs"].slice(k, 1).flatten()
                ids = Shard(batch["grammar"][k].as_py()).all()
                sizes = np.asarray(docs.field("n_tokens"))
                edge = np.concatenate([[0], np.cumsum(sizes)])
                if edge[-1] != len(ids):
                    raise ValueError("a shard's documents and ids differ in number")
                first = base[batch["part"][k].as_py()] + batch["start"][k].as_py()
                cells = [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([docs.field("row"), pa.array(edge[:-1] + first), pa.array(sizes), pa.array(cells, pa.binary())], names=made.names)

    return unpack(shards.select("part", "start", "docs", "grammar").mapInArrow(run, made), [f.name for f in row.dataType if f.name != "_"], ["start", "n_tokens", "ids"])


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
