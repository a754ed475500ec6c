"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Targets share all words by weight; a target stops at ``CAP`` times its
source's size and what is left over is shared among the others. The mix is a number
of equal blocks of words: blocks go to sources by the highest quotients
target / (2 k + 1), and each source's blocks go on to its shards in the same way by
their sizes. A shard lays its documents out in a seeded order, as one ring of
words cut into blocks; it takes as many whole rounds as its quota holds and, for
the rest, consecutive blocks from a seeded one on. So each document is taken a whole
number of times, but for the two at the ends of the run.

A source has as many shards as its rows need, so a source with a third of all rows is spread like the others, and
its blocks are apportioned down a tree of shards, ``FAN`` siblings at a time; none is given more than ``CAP``
times its words, what it can't hold going to its siblings. The driver holds one row per source (a list that weights
are given for, at most ``MAX_SOURCES``, which bounds what is broadcast too).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gridlens.llm import textkit as K
from gridlens.llm.blocks import _q
from gridlens.llm.shared import bounded_batches

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20240601
SHARD_ROWS = 1 << 10
FAN = 1 << 10
MAX_SOURCES = 100_000
#: Blocks of the whole mix, and least blocks of the smallest target.
BLOCKS, LEAST_BLOCKS = 200_000, 64
MAX_BLOCK = 1024


def targets(sizes: list[int], weights: list[int], cap: int = CAP) -> list[Fraction]:
    """Shares of all words by weight, none above ``cap`` times its size."""
    out = [Fraction(0)] * len(sizes)
    rest, active = Fraction(sum(sizes)), set(range(len(sizes)))
    while active:
        unit = rest / sum(weights[k] for k in active)
        full = {k for k in active if unit * weights[k] > cap * sizes[k]}
        if not full:
            for k in active:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = Fraction(cap * sizes[k])
            rest -= out[k]
        active -= full
    return out


def sainte_lague(votes: list, seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), at most ``most`` each; of equal quotients the earlier comes first.

    Starts from rounded shares, which are at most a few seats off, and gives or takes the rest
    one by one, so it costs no more for many seats.
    """
    total, n = sum(votes), len(votes)
    if not total or seats <= 0:
        return [0] * n
    most = [seats] * n if most is None else most
    out, free = [0] * n, set(range(n))
    # shares; where one is more than there is room for, the others' shares of the rest grow
    while True:
        rest, left = seats - sum(out[k] for k in range(n) if k not in free), sum(votes[k] for k in free)
        full = [k for k in free if left and Fraction(votes[k]) * rest / left >= most[k]]
        if not full:
            break
        for k in full:
            out[k] = most[k]
            free.discard(k)
    for k in free:
        out[k] = int(Fraction(votes[k]) * rest / left) if left else 0

    def gain(k: int) -> tuple:
        return (-Fraction(votes[k]) / (2 * out[k] + 1), k)

    heap = [gain(k) for k in range(n) if votes[k] and out[k] < most[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        out[k] += 1
        if out[k] < most[k]:
            heapq.heappush(heap, gain(k))
    # a floor can hold a seat that another's quotient beats
    while True:
        takers = [gain(k) for k in range(n) if votes[k] and out[k] < most[k]]
        givers = [(Fraction(votes[k]) / (2 * out[k] - 1), -k) for k in range(n) if out[k]]
        if not takers or not givers:
            return out
        taker, giver = min(takers), min(givers)
        if (-taker[0], -taker[1]) <= giver:
            return out
        out[taker[1]] += 1
        out[-giver[1]] -= 1


def sized(df: DataFrame, text: str, keep: list[str], carry_text: bool) -> DataFrame:
    """row (the kept columns), text if asked for, size (words) and mark (a hash of the text)."""
    bounded_batches(df.sparkSession)
    packed = df.select(F.struct(F.lit(0).alias("_"), *[F.col(_q(c)) for c in keep]).alias("row"), F.col(_q(text)).cast("string").alias("text"), F.xxhash64(F.col(_q(text)).cast("string")).alias("mark"))
    body = [T.StructField("text", T.StringType())] if carry_text else []
    made = T.StructType([packed.schema["row"], *body, T.StructField("mark", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch["text"])
            counts = [np.diff(K.words(data[off[a] : off[b]], off[a : b + 1] - off[a])[2]) for a, b in K.slices(off)]
            size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["row"], *([batch["text"]] if carry_text else []), batch["mark"], pa.array(size, pa.int64())], names=made.names)

    return packed.mapInArrow(run, made)


def quotas(df: DataFrame, text: str = "text", source: str = "source", keep: list[str] | None = None, order: str | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, carry_text: bool = False) -> DataFrame:
    """What the mix takes of every document.

    Returns the kept columns (all but ``text`` by default), the text if ``carry_text``, and
    size, source_size, target, taken, rounds (whole times) and parts (array of [first word,
    word after the last] taken once more). Sources are ordered by code point, null last as a
    source of its own, and weigh ``weights`` in turn. Null and empty texts have size 0 and are
    taken 0 words; a source of size 0 has target 0. ``order`` (an id) and the text alone seed
    a document's place, so reruns agree, and copies of one row may change places without
    any effect. Columns named like an output are replaced. An empty table gives an empty result.
    More than ``MAX_SOURCES`` sources raise ValueError.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c != text] if keep is None else keep
    asked, keep = keep, [*dict.fromkeys([*keep, source, *([order] if order else [])])]
    docs = sized(df, text, keep, carry_text)
    name = F.col("row")[source].cast("string")
    # one pass without the text: sizes by source, then by shard
    plain = sized(df, text, keep, False).select(name.alias("source"), "mark", "size", *([F.col("row")[order].alias("id")] if order else []))
    rows = plain.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    ranked = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in ranked]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(ranked))], cap)
    total, least = sum(sizes), min((g for g in goals if g), default=Fraction(1))
    block = max(1, min(MAX_BLOCK, total // BLOCKS, int(least / LEAST_BLOCKS)))
    seats = sainte_lague(goals, round(total / block))
    shards = [max(1, -(-r.n // SHARD_ROWS)) for r in ranked]
    per_source = spark.createDataFrame(
        [(k, r.source, sizes[k], float(goals[k]), seats[k], shards[k]) for k, r in enumerate(ranked)] or [(0, None, 0, 0.0, 0, 1)], "number int, source string, source_size long, target double, seats long, shards long"
    )
    place = F.xxhash64(F.lit(seed), "mark", *(["id"] if order else []))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "mark", *(["id"] if order else [])), F.col("shards"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        blocks = int(pdf["seats"].iloc[0])
        given = sainte_lague([int(x) for x in pdf["words"]], blocks, [int(x) for x in pdf["most"]])
        # blocks that no sibling has room for: all take what they can hold, to the word
        return pd.DataFrame({"number": pdf["number"], "shard": pdf["shard"], "words": pdf["words"], "quota": given, "full": pdf["over"] | (sum(given) < blocks)})

    known = F.broadcast(per_source)
    same = lambda left: F.col(left).eqNullSafe(known["source"])
    cells = plain.withColumnRenamed("source", "its").join(known, same("its")).withColumn("shard", shard).groupBy("number", "shard").agg(F.sum("size").alias("words"), F.max("seats").alias("of"))
    tree = [cells.withColumn("most", F.floor(F.lit(cap) * F.col("words") / F.lit(block)).cast("long"))]
    while max(shards, default=1) > FAN ** len(tree):
        tree.append(tree[-1].groupBy("number", F.floor(F.col("shard") / F.lit(FAN)).cast("long").alias("shard")).agg(*[F.sum(c).alias(c) for c in ("words", "most")], F.max("of").alias("of")))
    held = "number int, shard long, words long, quota long, full boolean"
    cells = tree.pop().withColumn("over", F.lit(False)).withColumnRenamed("of", "seats").groupBy("number").applyInPandas(deal, held)
    while tree:
        above = cells.select(F.col("number").alias("above"), F.col("shard").alias("parent"), F.col("quota").alias("seats"), F.col("full").alias("over"))
        below = tree.pop().withColumn("parent_shard", F.floor(F.col("shard") / F.lit(FAN)).cast("long"))
        cells = below.join(above, (F.col("number") == F.col("above")) & (F.col("parent_shard") == F.col("parent"))).groupBy("number", "parent").applyInPandas(deal, held)
    laid = docs.withColumn("its", name).withColumn("id", F.col("row")[order] if order else F.lit(0)).join(known, same("its"))
    laid = laid.withColumn("shard", shard).withColumn("place", place)
    ring = Window.partitionBy("number", "shard").orderBy("place", "id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    thin = laid.select(*[c for c in ("row", "text", "size", "source_size", "target", "number", "shard", "place", "id", "mark") if c != "text" or carry_text])
    thin = thin.withColumn("begin", F.sum("size").over(ring) - F.col("size"))
    cells = cells.withColumnRenamed("number", "cell_number").withColumnRenamed("shard", "cell_shard")
    both = thin.join(cells, (F.col("number") == F.col("cell_number")) & (F.col("shard") == F.col("cell_shard")))
    wanted = F.when(F.col("full"), F.lit(cap) * F.col("words")).otherwise(F.col("quota") * F.lit(block))
    both = both.withColumn("rounds", F.when(F.col("words") > 0, F.floor(wanted / F.greatest("words", F.lit(1)))).otherwise(0).cast("long"))
    both = both.withColumn("rest", wanted - F.col("rounds") * F.col("words"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / F.lit(block)))
    both = both.withColumn("from", F.pmod(F.xxhash64(F.lit(seed + 2), "number", "shard"), blocks).cast("long") * F.lit(block))
    lo, hi, size = F.col("begin"), F.col("begin") + F.col("size"), F.col("size")
    pieces = []
    for shift in (F.lit(0).cast("long"), F.col("words")):
        # the run, and the run as it comes round past the end of the ring
        a = F.greatest(lo, F.col("from") - shift) - lo
        b = F.least(hi, F.col("from") + F.col("rest") - shift) - lo
        pieces.append(F.when((b > a) & (size > 0), F.array(a, b)))
    both = both.withColumn("parts", F.array_compact(F.array(*pieces[::-1])))
    extra = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p[1] - p[0])
    made = [*([text] if carry_text else []), "size", "source_size", "target", "taken", "rounds", "parts"]
    both = both.withColumn("taken", F.col("rounds") * size + extra)
    if carry_text and text != "text":
        both = both.withColumnRenamed("text", text)
    own = {m.lower() for m in made}
    return both.select(*[F.col("row")[c].alias(c) for c in asked if c.lower() not in own], *map(_q, made))


def take(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mixed corpus: each document as many times as it is taken whole, and a row with the words of each part taken.

    Whole copies keep their text; a part keeps the bytes from its first word to its last. ``mixed`` is what ``quotas`` makes with
    ``carry_text``. Null and empty texts, and what has no quota, give no row; repeated rows are taken each by its own; other columns
    are kept; an empty table gives an empty result.
    """
    made = mixed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = made.names.index(text)
        for batch in batches:
            rows, texts = [], []
            data, off = K.buffers(batch.column(at))
            column = batch.column(at)
            for d, (times, parts, size) in enumerate(zip(batch["rounds"].to_pylist(), batch["parts"].to_pylist(), batch["size"].to_pylist(), strict=True)):
                for _ in range(times if size else 0):
                    rows.append(d)
                    texts.append(column[d].as_py())
                if parts:
                    body = data[off[d] : off[d + 1]]
                    starts, ends, _ = K.words(body, np.array([0, len(body)]))
                    for a, b in parts:
                        rows.append(d)
                        texts.append(body[starts[a] : ends[b - 1]].tobytes().decode("utf-8", "replace"))
            out = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else out.column(k) for k in range(out.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    return mixed.mapInArrow(run, made)


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quotas(docs, keep=["doc_id", "source"], order="doc_id").select("doc_id", "size", "source_size", "target", "taken")
