"""Counting keys over a whole corpus without a row per key.

Documents are dealt by a hash into *blocks* of a few MB. A block reports each of its
distinct keys (64-bit hashes) once, with a count, packed into one binary cell per
*bucket* of the hash space; a bucket adds the counts of all blocks and sends back to
each block those of its own keys that reach a threshold. Blocks are added up in a tree, ``FAN``
at a time, so a key that a third of all documents hold costs one entry a block on the lowest level, at most
``FAN`` entries in any task, never a group of documents, and neither the
driver nor any one task sees the keys of the whole corpus.

Every step is a lazy DataFrame over shuffles that Spark can recompute, so lost
executors cost only their share. The shuffle of documents to blocks is the same
sub-plan in every step, and Spark reuses it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridlens.llm.shared import bounded_batches

BLOCK_BYTES = 4 << 20
#: Blocks whose cells one task adds up.
FAN = 1024
REPORT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("firsts", T.BinaryType())])
ANSWER = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("firsts", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_REPORT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("firsts", pa.binary()), ("counts", pa.binary())])


def block_count(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Blocks that hold about ``block_bytes`` of text each, and bytes of the longest text; one pass over lengths."""
    size = F.coalesce(F.octet_length(F.col(_q(text)).cast("string")), F.lit(0)).cast("long")
    total, most = df.agg(F.sum(size + F.lit(16)), F.max(size)).first()
    return max(1, math.ceil((total or 0) / block_bytes)), most or 0


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def to_blocks(df: DataFrame, text: str, keep: list[str], n: int) -> DataFrame:
    """Columns block, row (a struct of the columns to keep) and text.

    The block is a hash of the kept columns and the text (``name``), so that neither copies of one
    text nor rows without an id meet in one block, and every job deals rows alike; only rows that repeat
    as a whole, id included, share one.
    """
    bounded_batches(df.sparkSession)
    texts = F.col(_q(text)).cast("string")
    row = F.struct(F.lit(0).alias("_"), *[F.col(_q(c)) for c in keep])
    plain = [F.col(_q(c)).cast("string") for c in keep if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    name = F.xxhash64(*plain, texts)
    return df.select(F.pmod(F.xxhash64(name), F.lit(n)).alias("block"), name.alias("name"), row.alias("row"), texts.alias("text"))


def unpack(df: DataFrame, keep: list[str], made: list[str]) -> DataFrame:
    """The kept columns beside the operator's own; the latter replace columns of the same name."""
    own = {m.lower() for m in made}
    return df.select(*[F.col("row")[c].alias(c) for c in keep if c.lower() not in own], *[F.col(_q(m)) for m in made])


def tally(keys: np.ndarray, counts: np.ndarray | None = None, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, with summed counts and least firsts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        total = np.diff(np.concatenate([new, [len(keys)]]))
    else:
        total = np.add.reduceat(counts[order].astype(np.int64), new) if len(keys) else np.zeros(0, np.int64)
    least = None if firsts is None else (np.minimum.reduceat(firsts[order], new) if len(keys) else np.zeros(0, np.int64))
    return keys[new], total, least


def report(block: int, keys: np.ndarray, counts: np.ndarray, firsts: np.ndarray | None, n_buckets: int) -> pa.Table:
    """Cells of one block; ``keys`` sorted and distinct."""
    if not len(keys):
        return _REPORT.empty_table()
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    parts = list(zip(new, [*new[1:], len(keys)], strict=True))
    counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
    return pa.table(
        {
            "bucket": pa.array(bucket[new].astype(np.int64)),
            "block": pa.array(np.full(len(new), block, np.int64)),
            "keys": pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() if counts[a:b].max() > 1 else None for a, b in parts], pa.binary()),
            "firsts": pa.array([None if firsts is None else firsts[a:b].tobytes() for a, b in parts], pa.binary()),
        },
        schema=_REPORT,
    )


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Keys, counts, least firsts (if every cell has some) of cells, and where each cell ends."""
    parts = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
    sizes = np.array([len(x) for x in parts], np.int64)
    counts = np.concatenate([np.ones(n, np.uint32) if c is None else np.frombuffer(c, np.uint32) for c, n in zip(table["counts"].to_pylist(), sizes, strict=True)])
    has = table["firsts"].null_count == 0
    firsts = np.concatenate([np.frombuffer(x, np.int64) for x in table["firsts"].to_pylist()]) if has else None
    return keys, counts.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), firsts


def _answers(table: pa.Table, at: np.ndarray, keys: np.ndarray, wanted: np.ndarray, sums: np.ndarray | None, least: np.ndarray | None) -> pa.Table:
    """To each block that has a cell, its wanted keys."""
    out: dict[str, list] = {name: [] for name in _ANSWER.names}
    for k, (bucket, block) in enumerate(zip(table["bucket"].to_pylist(), table["block"].to_pylist(), strict=True)):
        mine = np.flatnonzero(wanted[at[k] : at[k + 1]]) + at[k]
        if len(mine):
            out["bucket"].append(bucket)
            out["block"].append(block)
            out["keys"].append(keys[mine].tobytes())
            out["firsts"].append(None if least is None else least[mine].tobytes())
            out["counts"].append(None if sums is None else sums[mine].tobytes())
    return pa.table(out, schema=_ANSWER)


def exchange(reports: DataFrame, n_blocks: int, threshold: int, tell_counts: bool = False, fan: int | None = None) -> DataFrame:
    """To each block, its keys whose counts over all blocks add up to ``threshold`` or more (with the least first, if any was reported, and with the sums if asked to).

    Up to ``fan`` blocks meet at once. More are first added up by ranges of ``fan`` blocks, which go on as blocks themselves,
    and each range passes on what it is answered.
    """
    fan = fan or FAN

    def settle(table: pa.Table) -> pa.Table:
        keys, counts, at, firsts = _cells(table)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        starts = np.flatnonzero(new)
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(new) - 1
        sums = np.add.reduceat(counts[order], starts)[group]
        least = None if firsts is None else np.minimum.reduceat(firsts[order], starts)[group]
        return _answers(table, at, keys, sums >= threshold, sums if tell_counts else None, least)

    if n_blocks <= fan:
        return reports.groupBy("bucket").applyInArrow(settle, ANSWER)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts, _, firsts = _cells(table)
        keys, counts, firsts = tally(keys, counts, firsts)
        counts = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"bucket": [key[0].as_py()], "block": [key[1].as_py()], "keys": [keys.tobytes()], "counts": [counts.tobytes()], "firsts": [None if firsts is None else firsts.tobytes()]}, schema=_REPORT)

    def pass_on(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(answer) or not len(table):
            return _ANSWER.empty_table()
        keys, _, at, _ = _cells(table)
        known = np.frombuffer(answer["keys"][0].as_py(), np.uint64)
        slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        told = [np.frombuffer(answer[c][0].as_py(), np.int64)[slot] if answer[c].null_count == 0 else None for c in ("counts", "firsts")]
        return _answers(table, at, keys, known[slot] == keys, *told)

    span = F.floor(F.col("block") / F.lit(fan)).cast("long").alias("span")
    above = exchange(reports.groupBy("bucket", span).applyInArrow(merge, REPORT), -(-n_blocks // fan), threshold, tell_counts, fan)
    return reports.groupBy("bucket", span).cogroup(above.groupBy("bucket", "block")).applyInArrow(pass_on, ANSWER)


def bucket_count(spark: SparkSession, n_blocks: int) -> int:
    """As many buckets as blocks, and four for each partition of a shuffle at least, so that partitions are alike."""
    return max(n_blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_reports(blocks: DataFrame, emit: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(emit, REPORT)


def answered(blocks: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType = REPORT) -> DataFrame:
    """Each block again, with what it was sent."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(use, schema)


def sent(answers: pa.Table, beside: str = "firsts") -> tuple[np.ndarray, np.ndarray | None]:
    """Keys that a block was sent, sorted, and their firsts (or counts)."""
    parts = [np.frombuffer(x, np.uint64) for x in answers["keys"].to_pylist()]
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    if parts and answers[beside].null_count == 0:
        return keys[order], np.concatenate([np.frombuffer(x, np.int64) for x in answers[beside].to_pylist()])[order]
    return keys[order], None
