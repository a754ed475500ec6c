"""Substring dedup by level-wise doubling.

A window is ``min_words`` consecutive words of one document; it is *repeated* if its
word sequence also starts anywhere else. Levels of doubling length lead there and on:

1. Windows of half the length (rounded up). Of the half windows inside a full window the
   one of least hash stands for it, so equal full windows have equal stand-ins, and only
   about one position in nine is counted at all.
2. Only full windows whose stand-in is repeated are extended to the full length and
   counted. Those repeated survive; the words they cover are removed.
3. A survivor is extended to twice its length where the window behind it survives too; its
   hash is made of the two, so no text is read again. Those of the new length that are repeated survive to the
   next level, and so on until none does. The last level a document reaches is its ``longest``.

Levels beyond the second run one after the other: each is written to the shared folder as the survivors of
every block, and the loop ends at the first level without any, so neither the plan nor the work grows with
the longest text. Documents of one word sequence survive together up to their whole length, so
one of them goes on for all, counted twice, and a group of thousands of copies costs as much as one.

Counting goes through ``blocks``: a passage that many documents share is one entry a
block. Keys are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm import blocks as B, textkit as K
from gridlens.llm.shared import dropped, stored

WINDOW = 35
STATE = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("names", "best", "first", "begin", "size", "keys")]])


def _per_slice(texts: pa.ChunkedArray):
    data, off = K.buffers(texts)
    for lo, hi in K.slices(off):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = K.words(part, at)
        yield part, starts, ends, first, K.span_hashes(part, starts, ends), K.room(first, len(starts))


def _stand_ins(hashes: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least half-window hash of each full window; which positions hold a full window; which half windows were picked."""
    half = (length + 1) // 2
    hashes = K.windows(hashes, half)
    least = K.slide(hashes, length - half + 1)
    full = room[: len(least)] >= length
    # a half window is picked if some full window around it has its hash as the least
    spread = np.where(full, least, np.uint64(0))
    pad = np.zeros(length - half, np.uint64)
    most = K.slide(np.concatenate([pad, spread, pad]), length - half + 1, np.maximum)[: len(hashes)]
    return least, full, hashes[(most == hashes) & (most > 0)]


class _Survivors:
    """Windows of a block that survive, document by document: runs of neighbouring starts, and a key a start.

    Of document d (a hash of the row, ``names``) the runs are first[d] .. first[d + 1] - 1; run r has size[r] starts from
    begin[r] on. ``best`` is the greatest length at which a window of the document survived.
    """

    def __init__(self, row: dict):
        self.names, self.best, self.first, self.begin, self.size = (np.frombuffer(row[c], np.int64) for c in ("names", "best", "first", "begin", "size"))
        self.keys = np.frombuffer(row["keys"], np.uint64)

    def extended(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Survivors of ``length`` words whose neighbour ``length`` words on survives too: their documents, starts, and keys at twice the length."""
        run = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(run)) - (np.cumsum(self.size) - self.size)[run] + self.begin[run]
        doc = np.repeat(np.arange(len(self.names)), np.diff(self.first))[run]
        here = (doc << 40) | at
        there = np.searchsorted(here, here + length)
        there[there == len(here)] = 0
        go = np.flatnonzero(here[there] == here + length) if len(here) else there
        return doc[go], at[go], K.joined(self.keys[go], self.keys[there[go]], length)


def _packed(block: int, names: np.ndarray, best: np.ndarray, doc: np.ndarray, at: np.ndarray, keys: np.ndarray) -> dict:
    """A row of ``STATE``; starts are sorted within documents."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)])) if len(at) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(names)))])
    size = np.diff(np.concatenate([new, [len(at)]]))
    cells = {"names": names, "best": best, "first": first, "begin": at[new], "size": size}
    return {"block": block, **{c: x.astype(np.int64).tobytes() for c, x in cells.items()}, "keys": keys.tobytes()}


def _report(block: int, parts: list[np.ndarray], n: int, counts: list[np.ndarray] | None = None) -> pa.Table:
    keys, counts, _ = B.tally(np.concatenate([*parts, np.zeros(0, np.uint64)]), None if counts is None else np.concatenate([*counts, np.zeros(0, np.int64)]))
    return B.report(block, keys, counts, None, n)


def longest_levels(docs: DataFrame, found: DataFrame, n_blocks: int, min_words: int, levels: int | None) -> tuple[DataFrame, DataFrame]:
    """Doubles the windows ``found`` until none survives (or ``levels`` times): ``found`` itself and rows of ``STATE`` with the documents' ``best``, both stored.

    The first table holds both, so documents are dealt once for all that leads there.
    """
    spark = docs.sparkSession
    buckets = B.bucket_count(spark, n_blocks)

    def sequences(table: pa.Table) -> pa.Table:
        keys = np.array([int.from_bytes(K.word_sequence((x or "").encode())[:8], "little") for x in table["text"].to_pylist()], np.uint64)
        block = table["block"][0].as_py()
        keys, counts, firsts = B.tally(keys, None, np.full(len(keys), block))
        return B.report(block, keys, counts, firsts, buckets)

    def begin(table: pa.Table, answer: pa.Table) -> pa.Table:
        named = pa.compute.is_valid(answer["firsts"])
        known, _ = B.sent(answer.filter(pa.compute.invert(named)))
        copied, owner = B.sent(answer.filter(named))
        if not len(table) or not len(known):
            return pa.Table.from_pylist([], schema=_STATE)
        block = table["block"][0].as_py()
        told = {c: None for c in STATE.names} | {"block": block, "keys": known.tobytes()}
        names, best, docs_at, ats, keys, done = [], [], [], [], [], set()
        body, row = table["text"].to_pylist(), 0
        for _, _, _, first, words, room in _per_slice(table["text"]):
            hashes = K.windows(words, min_words)
            marked = K.member(hashes, known) & (room[: len(hashes)] >= min_words)
            for d in range(len(first) - 1):
                a, b = int(first[d]), int(first[d + 1])
                at = np.flatnonzero(marked[a : max(a, b - min_words + 1)])
                if len(at):
                    name = int.from_bytes(K.word_sequence((body[row + d] or "").encode())[:8], "little")
                    slot = int(np.searchsorted(copied, np.uint64(name)))
                    copies = slot < len(copied) and int(copied[slot]) == name
                    goes_on = not copies or (owner[slot] == block and name not in done)
                    done.add(name)
                    names.append(table["name"][row + d].as_py())
                    # a copied document survives whole: as far as doublings fit, and the one that goes on counts twice (a sign)
                    reach = min_words
                    while copies and 2 * reach <= b - a and (levels is None or reach < min_words << levels):
                        reach *= 2
                    best.append(-reach if copies and goes_on else reach)
                    if goes_on:
                        docs_at.append(np.full(len(at), len(names) - 1))
                        ats.append(at)
                        keys.append(hashes[a + at])
            row += len(first) - 1
        none = np.zeros(0, np.int64)
        return pa.Table.from_pylist([told, _packed(block, np.array(names, np.int64), np.array(best, np.int64), np.concatenate([*docs_at, none]), np.concatenate([*ats, none]), np.concatenate([*keys, none.astype(np.uint64)]))], schema=_STATE)

    def candidates(length: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = _Survivors(row)
                    doc, _, keys = x.extended(length)
                    yield from _report(row["block"], [keys], buckets, [np.where(x.best[doc] < 0, 2, 1)]).to_batches()

        return run

    def survive(length: int):
        def run(table: pa.Table, answer: pa.Table) -> pa.Table:
            known, _ = B.sent(answer)
            rows = []
            for row in table.to_pylist():
                x = _Survivors(row)
                doc, at, keys = x.extended(length)
                on = K.member(keys, known)
                best = x.best.copy()
                reached = np.unique(doc[on])
                best[reached] = np.where(best[reached] < 0, np.minimum(best[reached], -2 * length), np.maximum(best[reached], 2 * length))
                rows.append(_packed(row["block"], x.names, best, doc[on], at[on], keys[on]))
            return pa.Table.from_pylist(rows, schema=_STATE)

        return run

    copies = B.exchange(B.first_reports(docs, sequences), n_blocks, 2)
    first = stored(B.answered(docs, found.unionByName(copies), begin, STATE), "found", even=False)
    none = F.lit(None).cast("binary")
    found = first.where("names IS NULL").select(F.lit(0).cast("long").alias("bucket"), "block", "keys", none.alias("firsts"), none.alias("counts"))
    state, level = first.where("names IS NOT NULL"), 0
    while (levels is None or level < levels) and not state.where(F.octet_length("keys") > 0).isEmpty():
        length = min_words << level
        answers = B.exchange(state.mapInArrow(candidates(length), B.REPORT), n_blocks, 2)
        after = stored(B.answered(state, answers, survive(length), STATE), "level", even=False)
        dropped(state)
        state, level = after, level + 1
    return found, state


_STATE = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("names", "best", "first", "begin", "size", "keys")]])


def repeats(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = WINDOW, levels: int | None = None, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Removes from every text the words covered by a repeated window.

    Returns the columns ``keep`` (all but ``text`` by default) and kept_text (kept words
    joined by one space), n_words, n_removed, spans (array of first word and word after
    the last of each removed run) and longest (the greatest of ``min_words``, twice that and so on at which a
    window is still repeated; 0 if no word goes). ``levels`` limits the doublings beyond ``min_words``;
    None goes on until no window survives. Windows are judged on
    the input, not on what is left, and the first copy goes like the others.

    Null and empty texts have no words: kept_text is "", counts are 0. A text shorter than
    the window keeps everything. Rows may repeat; each counts. Columns named like an
    output are replaced by it. An empty table gives an empty result.

    Levels are written to the shared folder when this is called; the result itself is lazy.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    n, _ = B.block_count(df, text, block_bytes)
    buckets = B.bucket_count(df.sparkSession, n)
    docs = B.to_blocks(df, text, keep, n)

    def halves(table: pa.Table) -> pa.Table:
        found = [_stand_ins(hashes, room, min_words)[2] for *_, hashes, room in _per_slice(table["text"])]
        return _report(table["block"][0].as_py(), found, buckets)

    def wholes(table: pa.Table, answer: pa.Table) -> pa.Table:
        known, _ = B.sent(answer)
        found = []
        if len(known):
            for *_, hashes, room in _per_slice(table["text"]):
                least, full, _ = _stand_ins(hashes, room, min_words)
                # neighbours mostly share a stand-in: look up one of each run
                run = np.concatenate([[True], least[1:] != least[:-1]]) if len(least) else np.zeros(0, bool)
                again = K.member(least[run], known)[np.cumsum(run) - 1] if len(least) else run
                found.append(K.windows(hashes, min_words)[again & full])
        return _report(table["block"][0].as_py() if len(table) else 0, found, buckets)

    made = T.StructType(
        [
            docs.schema["row"],
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("longest", T.LongType()),
        ]
    )

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        told = pa.compute.is_valid(answer["counts"])
        known, _ = B.sent(answer.filter(pa.compute.invert(told)))
        doc_names, reach = B.sent(answer.filter(told), "counts")
        best = dict(zip(doc_names.view(np.int64).tolist(), reach.tolist(), strict=True)) if reach is not None else {}
        kept, n_words, n_removed, spans, longest = [], [], [], [], []
        names = table["name"].to_pylist()
        for part, starts, ends, first, words, room in _per_slice(table["text"]):
            hashes = K.windows(words, min_words)
            marked = np.zeros(len(starts), bool)
            marked[: len(hashes)] = K.member(hashes, known) & (room[: len(hashes)] >= min_words)
            gone = K.cover(marked, min_words)
            body, n_doc = part.tobytes(), np.diff(first)
            total = np.concatenate([[0], np.cumsum(gone)])
            for d in range(len(n_doc)):
                a, b = first[d], first[d + 1]
                out = int(total[b] - total[a])
                n_words.append(int(b - a))
                n_removed.append(out)
                longest.append(best.get(names[len(longest)], min_words) if out else 0)
                if not out:
                    spans.append([])
                    kept.append(b" ".join(body[starts[a] : ends[b - 1]].split()) if b > a else b"")
                    continue
                mine = gone[a:b]
                step = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                spans.append(np.stack([begin, end], 1).tolist())
                rest = [body[starts[a + x] : ends[a + y - 1]] for x, y in zip([0, *end], [*begin, b - a], strict=True) if y > x]
                kept.append(b" ".join(b" ".join(rest).split()))
        return pa.table(
            {
                "row": table["row"],
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                "longest": pa.array(longest, pa.int64()),
            }
        )

    answers = B.exchange(B.first_reports(docs, halves), n, 2)
    answers = B.exchange(B.answered(docs, answers, wholes), n, 2)
    if levels != 0:
        answers, state = longest_levels(docs, answers, n, min_words, levels)

        def bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    # rows that repeat as a whole have one name; the one that reaches furthest speaks for all
                    names, reach = np.frombuffer(row["names"], np.int64).view(np.uint64), np.abs(np.frombuffer(row["best"], np.int64))
                    order = np.lexsort((-reach, names))
                    order = order[np.unique(names[order], return_index=True)[1]]
                    told = {"bucket": 0, "block": row["block"], "keys": names[order].tobytes(), "firsts": None, "counts": reach[order].tobytes()}
                    yield pa.RecordBatch.from_pylist([told], schema=B._ANSWER)

        answers = answers.unionByName(state.select("block", "names", "best").mapInArrow(bests, B.ANSWER))
    return B.unpack(B.answered(docs, answers, cut, made), keep, made.names[1:])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = repeats(docs, "text", ["doc_id"], WINDOW)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM words WHERE len(ws) >= 35)
), again AS (
  SELECT doc_id, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again
), each AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
