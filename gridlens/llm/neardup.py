"""Near-duplicate detection by DartMinHash, banded joining and exact checks.

A document is the multiset of its ``SHINGLE``-word windows; similarity is weighted Jaccard
(sum of lesser counts over sum of greater ones). Two documents are linked at ``THRESHOLD``
or more, and classes are the connected components of links.

1. Documents of one word sequence are one *node* (a 128-bit hash). Each node gets
   a signature of ``K_DARTS`` darts in bands of ``ROWS``; nodes that agree in a band share a
   bucket. At the threshold a pair shares none of 20 buckets in 3 cases of 100,000.
2. Every bucket is joined as a star: its members are compared with its most *popular*
   member, the one with the most company over all its buckets, which in a
   group of variants is the one nearest to the rest. A star has one row a member.
3. Components of those links. In a bucket whose other members still lie in several
   components, signatures of pairs from different components are compared first, ``SIGNATURES`` members against as many
   (pairs that agree too seldom for the threshold are left out, by ``SLACK`` standard deviations or, if that is None, not at all).
   Only members that have such a pair bring their texts, and are compared exactly, in blocks of ``CHUNK`` members and
   ``CHUNK_BYTES`` of text; a pair is seen
   in its first common band only, and pairs already connected are skipped. A block gives
   at most one link a member, so rows stay in proportion to members even in a
   group of thousands; what grows with the square are comparisons, between components that stars left apart,
   and copies of rows by the number of blocks: of signatures one for ``SIGNATURES`` members, of texts, where signatures leave
   pairs open, one for ``CHUNK``. What this finds joins whole components, so only these go through the rounds again.

Every link is checked on whole texts. What the steps share is written to the shared
folder, so a lost executor costs its tasks alone; nothing of the corpus is collected. Tables that come
from a shuffle, or row by row from the input, are written as they lie: dealing them out again would cost a shuffle and, where
partitions are small, a task for every few rows. Links alone are, being far fewer than the texts they come from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm import dart, textkit as K
from gridlens.llm.blocks import _q
from gridlens.llm.shared import bounded_batches, dropped, stored

SHINGLE, THRESHOLD = 5, 0.8
K_DARTS, ROWS = 80, 4
#: Members of a bucket whose texts are compared at once, and their bytes; members whose signatures are.
CHUNK, CHUNK_BYTES, SIGNATURES = 512, 8 << 20, 4096
#: Standard deviations by which a pair's signatures may agree less than the threshold says.
SLACK = 4.5


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their counts, the index of each text's first, and a 128-bit hash of its words (n x 2).

    A text of fewer words than a shingle has one shingle of all of them; one without words has none.
    """
    starts, ends, first = K.words(data, off)
    hashes = K.span_hashes(data, starts, ends)
    room, n = K.room(first, len(starts)), np.diff(first)
    wide = K.windows(hashes, size)
    at = np.flatnonzero(room[: len(wide)] >= size)
    own = np.repeat(np.arange(len(n)), n)[at]
    body = data.tobytes()
    names = np.frombuffer(b"".join([K.word_sequence(body[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]), np.uint64).reshape(-1, 2)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = names[:, 0]
    values, own = np.concatenate([wide[at], whole[short]]), np.concatenate([own, short])
    order = np.lexsort((values, own))
    values, own = values[order], own[order]
    new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (own[1:] != own[:-1])])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(values)]])).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(n)))]).astype(np.int64)
    return values[new], counts, begin, names


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted distinct values, counts)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def _each(texts: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    data, off = K.buffers(texts)
    out = []
    for lo, hi in K.slices(off):
        values, counts, first, _ = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        out += [(values[a:b], counts[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def signed(df: DataFrame, text: str, order: str) -> DataFrame:
    """id, mark (a hash of the text), node (null without words), bands and sig (low 16 bits of each dart)."""
    bounded_batches(df.sparkSession)
    packed = df.select(F.col(_q(order)).alias("id"), F.xxhash64(F.col(_q(text)).cast("string")).alias("mark"), F.col(_q(text)).cast("string").alias("text"))
    made = T.StructType([T.StructField("id", packed.schema["id"].dataType), T.StructField("mark", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch["text"])
            for lo, hi in K.slices(off):
                values, counts, first, names = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sig = dart.signatures(values, counts, first, K_DARTS)
                band = dart.bands(sig, ROWS).astype(np.int64)
                some = np.diff(first) > 0
                low = sig.astype(np.uint16)
                node = [names[d].tobytes() if some[d] else None for d in range(hi - lo)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * band.shape[1]), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), batch["mark"].slice(lo, hi - lo), pa.array(node, pa.binary()), lists, pa.array([x.tobytes() for x in low], pa.binary())], names=made.names)

    return packed.mapInArrow(run, made)


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node of its component) of every node that has a link in (a, b).

    Least labels pass along links and then along themselves (a label takes its own label's
    label), so rounds grow with the logarithm of a chain, not with its length. A round is one table.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "both", even=False)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp")), "labels", even=False)
    last = labels
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = met.select(F.col("node").alias("up_node"), F.col("comp").alias("up"))
        new = stored(met.join(up, met["comp"] == up["up_node"]).select("node", "was", F.least("comp", "up").alias("comp")), "labels", even=False)
        dropped(last)
        labels, last = new.select("node", "comp"), new
        if new.where("was <> comp").isEmpty():
            dropped(both)
            return labels


def classes(df: DataFrame, text: str = "text", order: str = "doc_id", threshold: float = THRESHOLD, chunk: int = CHUNK, slack: float | None = SLACK) -> DataFrame:
    """One row per document: id and mark, and class_id and class_mark, those of the least (id, mark) of its class.

    A document without words (null, empty, separators) is linked to nothing and is a class of
    its own. Null ids sort first. Rows may repeat and then share a class. Other columns play no part.
    An empty table gives an empty result. ``slack`` None compares all pairs of a bucket on whole texts.
    """
    rows = stored(signed(df, text, order), "signatures", even=False)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("first"), F.max(F.struct("bands", "sig")).alias("s"))
    nodes = stored(nodes.select("node", "first", "s.bands", "s.sig"), "nodes", even=False)

    # buckets with company, and the most popular member of each
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(spread.join(sizes, "bucket"), "buckets", even=False)
    popular = members.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = members.select("bucket", "node").join(popular, "node")
    ranked = stored(ranked.select("bucket", F.struct(-F.col("company"), "node").alias("rank"), "node"), "ranked", even=False)
    centres = ranked.groupBy("bucket").agg(F.min("rank").alias("top")).select("bucket", F.col("top.node").alias("centre"))
    seated = stored(ranked.select("bucket", "node").join(centres, "bucket"), "seated", even=False)
    pairs = seated.where("node <> centre").select("node", "centre").distinct()
    pairs = stored(pairs, "pairs", even=False)

    # whole texts of the nodes concerned, one document each
    asked = members.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", F.col("first.id").alias("its_id"), F.col("first.mark").alias("its_mark"))
    plain = df.select(F.col(_q(order)).alias("id"), F.xxhash64(F.col(_q(text)).cast("string")).alias("mark"), F.col(_q(text)).cast("string").alias("text"))
    texts = plain.join(asked, (plain["mark"] == asked["its_mark"]) & plain["id"].eqNullSafe(asked["its_id"]))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "texts", even=False)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                near = [similarity(x, y) >= threshold for x, y in zip(_each(batch["text"]), _each(batch["other"]), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    link = "a binary, b binary"
    one = pairs.join(texts, "node").select("centre", F.col("node").alias("a"), "text")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), F.col("centre") == F.col("b")).select("a", "b", "text", "other")
    links = stored(two.mapInArrow(check, link), "links")
    comps = components(links)

    # buckets whose members beside the centre are still apart
    def labelled(left: DataFrame, comps: DataFrame) -> DataFrame:
        known = comps.select(F.col("node").alias("c_node"), "comp")
        return left.join(known, left["node"] == known["c_node"], "left").drop("c_node").withColumn("comp", F.coalesce("comp", "node"))

    rest = labelled(seated.where("node <> centre"), comps)
    apart = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", F.ceil(F.col("size") / F.lit(max(chunk, SIGNATURES * chunk // CHUNK))).alias("n_chunks"))

    def dealt(left: DataFrame) -> DataFrame:
        """Members with their cells: chunk i meets chunk j in the cell (least, greatest) of the two."""
        left = left.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n_chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
        left = left.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "comp")
        return left.join(nodes.select("node", "bands", "sig"), "node")

    least = -1.0 if slack is None else threshold * K_DARTS - slack * (threshold * (1 - threshold) * K_DARTS) ** 0.5

    class Cell:
        """Members of a cell; ``candidates``: of member x those that it is to be compared with."""

        def __init__(self, key: tuple, table: pa.Table):
            self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(table), -1)
            self.bands = np.array(table["bands"].to_pylist(), np.int64)
            self.band = int(np.flatnonzero((self.bands == key[0].as_py()).all(axis=0))[0])
            self.side, self.lo, self.hi = np.asarray(table["mine"]), key[1].as_py(), key[2].as_py()
            name: dict[bytes, int] = {}
            self.top = np.array([name.setdefault(c, len(name)) for c in table["comp"].to_pylist()])

        def candidates(self, x: int) -> np.ndarray:
            ok = self.top != self.top[x]
            if self.lo == self.hi:
                ok[: x + 1] = False
            elif self.side[x] == self.hi:
                return np.zeros(0, np.int64)
            else:
                ok &= self.side == self.hi
            at = np.flatnonzero(ok)
            at = at[(self.sig[at] == self.sig[x]).sum(axis=1) >= least]
            return at[~(self.bands[at, : self.band] == self.bands[x, : self.band]).any(axis=1)] if self.band else at

    def open_members(key: tuple, table: pa.Table) -> pa.Table:
        cell, found = Cell(key, table), np.zeros(len(table), bool)
        for x in range(len(table)):
            if len(at := cell.candidates(x)):
                found[at] = found[x] = True
        return table.select(["bucket", "node", "comp"]).filter(pa.array(found))

    some = dealt(rest.select("bucket", "node", "comp").join(apart, "bucket")).groupBy("bucket", "lo", "hi").applyInArrow(open_members, "bucket long, node binary, comp binary")
    some = stored(some.distinct(), "open", even=False)
    held = some.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    blocks = held.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(chunk)), F.ceil(F.sum("bytes") / F.lit(CHUNK_BYTES))).alias("n_chunks"))
    held = dealt(some.join(blocks, "bucket")).join(texts, "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Components that a pair joins."""
        cell, sets, comp, found = Cell(key, table), _each(table["text"]), table["comp"].to_pylist(), []
        weight, top = np.array([s[1].sum() for s in sets]), cell.top
        for x in range(len(sets)):
            at = cell.candidates(x)
            for y in at[np.minimum(weight[at], weight[x]) >= threshold * np.maximum(weight[at], weight[x])]:
                if top[y] != top[x] and similarity(sets[x], sets[y]) >= threshold:
                    found.append((comp[x], comp[y]))
                    top[top == top[y]] = top[x]
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    more = stored(held.groupBy("bucket", "lo", "hi").applyInArrow(compare, link), "links")
    joined = None if more.isEmpty() else components(more).select(F.col("node").alias("part"), F.col("comp").alias("whole"))
    dropped(members, ranked, seated, pairs, texts, links, some, more)

    lead = labelled(nodes.select("node", "first"), comps)
    if joined is not None:
        lead = lead.join(joined, lead["comp"] == joined["part"], "left").select("node", "first", F.coalesce("whole", "comp").alias("comp"))
    best = lead.groupBy("comp").agg(F.min("first").alias("best"))
    named = lead.join(best, "comp").select(F.col("node").alias("its"), F.col("best.id").alias("class_id"), F.col("best.mark").alias("class_mark"))
    out = rows.select("id", "mark", "node").join(named, F.col("node") == F.col("its"), "left")
    alone = F.col("node").isNull()
    return out.select("id", "mark", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("mark")).otherwise(F.col("class_mark")).alias("class_mark"))


def keep_one(df: DataFrame, text: str = "text", order: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each class the one of least (id, text hash), once; documents without words all stay.

    All columns are kept. Null ids sort first.
    """
    found = classes(df, text, order, threshold)
    first = found.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).select(F.col("id").alias("_k_id"), F.col("mark").alias("_k_mark")).distinct()
    words = F.coalesce(F.col(_q(text)).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = df.select(F.struct(*[F.col(_q(c)) for c in df.columns]).alias("_row"), F.col(_q(order)).alias("_id"), F.xxhash64(F.col(_q(text)).cast("string")).alias("_mark"), words.alias("_words"))
    some = marked.where("_words").join(first, (F.col("_mark") == F.col("_k_mark")) & F.col("_id").eqNullSafe(F.col("_k_id")), "left_semi").dropDuplicates(["_id", "_mark"])
    return some.unionByName(marked.where("NOT _words")).select(*[F.col("_row")[c].alias(c) for c in df.columns])


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id")


OP2_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), sh AS (
  SELECT doc_id, s, count(*) AS n FROM (
    SELECT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM docs WHERE len(ws) > 0)
  ) GROUP BY ALL
), total AS (
  SELECT doc_id, sum(n) AS t FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT x, y FROM shared JOIN total p ON p.doc_id = x JOIN total q ON q.doc_id = y WHERE m / (p.t + q.t - m) >= 0.8
), links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x
"""
