"""Line dedup by a log-template tree.

A line's tokens are its words; a token with a digit is a variable field. The tree has a
fixed depth: a line goes to the leaf of its token count and its ``DEPTH`` leading tokens (all, if it has fewer).
In a leaf a token that ``min_docs`` documents have at the same place is constant, any other
is a variable field; what remains is the line's template. On a large leaf the values of a variable field reach ``min_docs``
documents too, so each line has a template at every level: at level k a token is constant from
``min_docs`` * 2^k documents on, and whatever the size of its leaf, a template of N documents meets a level between the
values of its fields and N. A template recurs if ``min_docs`` documents have a line of it and at least
``MIN_CONSTANT`` of its tokens are constant. Lines with a recurring template are dropped.

With ``keep_first`` the first document that has the most general of a line's recurring templates keeps
its lines. Where a corpus still holds whole copies, nothing at all would be left of a document with
many copies otherwise; the pipeline, whose near-dedup comes later, uses it.

Leaves, places and templates are counted in documents through ``blocks``, so a line that
a third of all documents share is one entry a block, and a leaf of any size is spread
over all blocks. Keys are 64-bit hashes.

Long lines need no ten documents to be no chance: ``drop_repeated`` drops a line of
``LONG`` words whose words, in order, stand in an earlier document too. It comes after
near-dedup, which takes whole copies away and would no longer know them by what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, functions as F, types as T

from gridlens.llm import blocks as B, textkit as K
from gridlens.llm.textkit import U

DEPTH = 3
MIN_DOCS = 10
MIN_CONSTANT = 0.5
LONG = 50
_FIELD = U(0x2545F4914F6CDD1D)
_NOBODY = np.iinfo(np.int64).max


class _Lines:
    """The lines of a slice of documents that have enough tokens."""

    def __init__(self, data: np.ndarray, off: np.ndarray, min_tokens: int):
        starts, ends, _ = K.words(data, off)
        self.begin, self.end, self.first = K.lines(data, off)
        hashes = K.span_hashes(data, starts, ends)
        digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
        self.field = digits[ends] > digits[starts]
        self.tokens = np.where(self.field, _FIELD, hashes)
        self.body, self.spans = data, (starts, ends)
        at = np.searchsorted(starts, self.begin)
        n = np.searchsorted(starts, self.end) - at
        self.line = np.flatnonzero(n >= min_tokens)
        self.at, self.n = at[self.line], n[self.line]
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))[self.line]
        leaf = self.n.astype(U)
        with np.errstate(over="ignore"):
            for k in range(DEPTH):
                has = self.n > k
                leaf[has] = K.mix(leaf[has] * U(0x9E3779B97F4A7C15) + self.tokens[self.at[has] + k])
        self.leaf = leaf

    def texts(self) -> np.ndarray:
        """A hash of the words of each line, in order."""
        body, (starts, ends) = self.body.tobytes(), self.spans
        spans = zip(starts[self.at].tolist(), ends[self.at + self.n - 1].tolist(), strict=True)
        return np.array([int.from_bytes(K.word_sequence(body[a:b])[:8], "little") for a, b in spans], U)

    def only(self, known: np.ndarray) -> None:
        """Lines of known leaves."""
        keep = K.member(self.leaf, known)
        self.line, self.at, self.n, self.doc, self.leaf = self.line[keep], self.at[keep], self.n[keep], self.doc[keep], self.leaf[keep]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token beyond the leading ones that is no variable field: its line (a number in this object), and a key of leaf, place and token. And the running number of such tokens before each line."""
        rest = np.maximum(self.n - DEPTH, 0)
        owner = np.repeat(np.arange(len(self.n)), rest)
        edge = np.concatenate([[0], np.cumsum(rest)])
        place = np.arange(edge[-1]) - np.repeat(edge[:-1], rest) + DEPTH
        word = self.at[owner] + place
        with np.errstate(over="ignore"):
            key = K.mix((self.leaf[owner] ^ K.mix(place.astype(U) + U(1))) * U(0x9E3779B97F4A7C15) + self.tokens[word])
        plain = ~self.field[word]
        return owner[plain], key[plain], np.concatenate([[0], np.cumsum(plain)])[edge]

    def templates(self, known: np.ndarray, docs: np.ndarray, min_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lines and their templates, of which enough is constant, level by level; at each the lines that have another template than before. ``docs``: documents that hold each known place."""
        owner, key, edge = self.places()
        fixed = K.member(key, known)
        sums = np.zeros(len(key) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(np.where(fixed, K.mix(key), U(0)), out=sums[1:])
            state = (sums[edge[1:]] - sums[edge[:-1]]) + self.leaf * U(0xBF58476D1CE4E5B9) + U(7)
        count = np.concatenate([[0], np.cumsum(fixed)])
        constant = count[edge[1:]] - count[edge[:-1]]
        for k in range(DEPTH):
            has = self.n > k
            constant[has] += ~self.field[self.at[has] + k]
        lines = np.flatnonzero(constant >= MIN_CONSTANT * self.n)
        yield lines, K.mix(state[lines])
        at = np.flatnonzero(fixed)
        held = docs[np.searchsorted(known, key[at])]
        least = min_docs
        while len(at):
            least *= 2
            field = held < least
            gone, at, held = at[field], at[~field], held[~field]
            if len(gone):
                with np.errstate(over="ignore"):
                    np.subtract.at(state, owner[gone], K.mix(key[gone]))
                np.subtract.at(constant, owner[gone], 1)
                lines = np.unique(owner[gone])
                lines = lines[constant[lines] >= MIN_CONSTANT * self.n[lines]]
                yield lines, K.mix(state[lines])

    def once(self, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Indices of one of each (document, key)."""
        return np.unique(K.mix(key ^ K.mix(doc.astype(U) + U(3))), return_index=True)[1]


def _rest(data: np.ndarray, off: np.ndarray, x: _Lines, gone: np.ndarray, null: list[bool], texts: list, n_lines: list[int], dropped: list[list[int]]) -> None:
    """Adds what is left of each document of a slice."""
    body = data.tobytes()
    total = np.concatenate([[0], np.cumsum(gone)])[x.first]
    for d in range(len(null)):
        a, b = x.first[d], x.first[d + 1]
        if null[d]:
            texts.append(None)
            n_lines.append(0)
            dropped.append([])
            continue
        n_lines.append(int(b - a))
        if total[d + 1] == total[d]:
            dropped.append([])
            texts.append(body[off[d] : off[d + 1]])
        else:
            mine = gone[a:b]
            dropped.append(np.flatnonzero(mine).tolist())
            texts.append(b"\n".join([body[x.begin[k] : x.end[k]] for k in (a + np.flatnonzero(~mine))]))


def _slices(table: pa.Table):
    data, off = K.buffers(table["text"])
    for lo, hi in K.slices(off):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _orders(table: pa.Table) -> np.ndarray:
    return np.asarray(pa.compute.struct_field(table["row"].combine_chunks(), "_order_")) if len(table) else np.zeros(0, np.int64)


def _dealt(df: DataFrame, text: str, keep: list[str], order: str, block_bytes: int) -> tuple[DataFrame, int, T.StructType]:
    """Documents in blocks, with their orders; the number of blocks; and what is made of them."""
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        raise ValueError(f"{order} must hold integers, which say what document is first")
    n, _ = B.block_count(df, text, block_bytes)
    named = df.select(*[F.col(B._q(c)) for c in dict.fromkeys([*keep, text])], F.coalesce(F.col(B._q(order)).cast("long"), F.lit(_NOBODY)).alias("_order_"))
    docs = B.to_blocks(named, text, [*keep, "_order_"], n)
    return docs, n, T.StructType([docs.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("dropped", T.ArrayType(T.IntegerType()))])


def _table(table: pa.Table, texts: list, n_lines: list[int], dropped: list[list[int]]) -> pa.Table:
    return pa.table({"row": table["row"], "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array([len(x) for x in dropped], pa.int64()), "dropped": pa.array(dropped, pa.list_(pa.int32()))})


def _columns(out: DataFrame, text: str, keep: list[str]) -> DataFrame:
    own = {text.lower(), "n_lines", "n_dropped", "dropped"}
    return out.select(*[F.col("row")[c].alias(c) for c in keep if c.lower() not in own], F.col("text").alias(text), "n_lines", "n_dropped", "dropped")


def drop_repeated(df: DataFrame, text: str = "text", keep: list[str] | None = None, order: str = "doc_id", min_docs: int = 2, min_words: int = LONG, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Like ``drop_recurring`` with ``keep_first``, but drops lines of at least ``min_words`` words whose words, in order, ``min_docs`` documents hold, outside the first of these.

    Nulls, empty texts, ties, repeated rows, clashing names and empty tables are treated as there.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    docs, n, made = _dealt(df, text, keep, order, block_bytes)

    buckets = B.bucket_count(df.sparkSession, n)

    def lines(table: pa.Table) -> pa.Table:
        found, firsts, rank = [np.zeros(0, U)], [np.zeros(0, np.int64)], _orders(table)
        for lo, _, data, off in _slices(table):
            x = _Lines(data, off, max(min_words, 1))
            key = x.texts()
            one = x.once(x.doc, key)
            found.append(key[one])
            firsts.append(rank[lo + x.doc[one]])
        return B.report(table["block"][0].as_py(), *B.tally(np.concatenate(found), None, np.concatenate(firsts)), buckets)

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        known, first = B.sent(answer)
        rank, null = _orders(table), table["text"].is_null().to_pylist()
        texts, n_lines, dropped = [], [], []
        for lo, hi, data, off in _slices(table):
            x = _Lines(data, off, max(min_words, 1))
            gone = np.zeros(len(x.begin), bool)
            if len(known):
                key = x.texts()
                hit = np.flatnonzero(K.member(key, known))
                gone[x.line[hit]] = first[np.searchsorted(known, key[hit])] != rank[lo + x.doc[hit]]
            _rest(data, off, x, gone, null[lo:hi], texts, n_lines, dropped)
        return _table(table, texts, n_lines, dropped)

    return _columns(B.answered(docs, B.exchange(B.first_reports(docs, lines), n, min_docs), cut, made), text, keep)


def drop_recurring(df: DataFrame, text: str = "text", keep: list[str] | None = None, order: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = 1, block_bytes: int = B.BLOCK_BYTES, keep_first: bool = False) -> DataFrame:
    """Returns the columns ``keep`` (all but ``text`` by default), the text without the dropped lines under its own name, n_lines, n_dropped and dropped (numbers of the lines from 0).

    Lines are what ``\\n`` separates. Lines of fewer than ``min_tokens`` tokens (1 at least)
    are never dropped. With ``keep_first`` the first document is that of least ``order``, an integer; null comes last, and
    rows of one id count as the one document for being first. Null stays null with 0 lines; an
    empty text has one empty line. Rows may repeat; each counts as a document.
    Columns named like an output are replaced. An empty table gives an empty result.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    min_tokens = max(min_tokens, 1)
    docs, n, made = _dealt(df, text, keep, order, block_bytes)
    buckets = B.bucket_count(df.sparkSession, n)

    def split(answer: pa.Table) -> tuple[np.ndarray, ...]:
        """Leaves; places and the documents that hold them; templates and their first documents."""
        named = pa.compute.is_valid(answer["firsts"])
        rest = answer.filter(pa.compute.invert(named))
        told = pa.compute.is_valid(rest["counts"])
        leaf, _ = B.sent(rest.filter(pa.compute.invert(told)))
        place, held = B.sent(rest.filter(told), "counts")
        return leaf, place, np.zeros(0, np.int64) if held is None else held, *B.sent(answer.filter(named))

    def block(table: pa.Table) -> int:
        return table["block"][0].as_py() if len(table) else 0

    def told(table: pa.Table, keys: list[np.ndarray], firsts: list[np.ndarray] | None = None) -> pa.Table:
        if not keys:
            return B.report(0, np.zeros(0, U), np.zeros(0, np.int64), None, buckets)
        return B.report(block(table), *B.tally(np.concatenate(keys), None, None if firsts is None else np.concatenate(firsts)), buckets)

    def leaves(table: pa.Table) -> pa.Table:
        found = []
        for _, _, data, off in _slices(table):
            x = _Lines(data, off, min_tokens)
            found.append(x.leaf[x.once(x.doc, x.leaf)])
        return told(table, found)

    def places(table: pa.Table, answer: pa.Table) -> pa.Table:
        known, _ = B.sent(answer)
        found = []
        for _, _, data, off in _slices(table) if len(known) else ():
            x = _Lines(data, off, min_tokens)
            x.only(known)
            owner, key, _ = x.places()
            found.append(key[x.once(x.doc[owner], key)])
        return told(table, found)

    def templates(table: pa.Table, answer: pa.Table) -> pa.Table:
        known, place, held, _, _ = split(answer)
        found, firsts = [], []
        rank = _orders(table)
        for lo, _, data, off in _slices(table) if len(known) else ():
            x = _Lines(data, off, min_tokens)
            x.only(known)
            for line, name in x.templates(place, held, min_docs):
                doc = x.doc[line]
                one = x.once(doc, name)
                found.append(name[one])
                firsts.append(rank[lo + doc[one]])
        return told(table, found, firsts)

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        known, place, held, recurring, first = split(answer)
        rank, null = _orders(table), table["text"].is_null().to_pylist()
        texts, n_lines, dropped = [], [], []
        for lo, hi, data, off in _slices(table):
            x = _Lines(data, off, min_tokens)
            gone = np.zeros(len(x.begin), bool)
            if len(recurring):
                x.only(known)
                for line, name in x.templates(place, held, min_docs):
                    hit = K.member(name, recurring)
                    line, name = line[hit], name[hit]
                    gone[x.line[line]] = (first[np.searchsorted(recurring, name)] != rank[lo + x.doc[line]]) | (not keep_first)
            _rest(data, off, x, gone, null[lo:hi], texts, n_lines, dropped)
        return _table(table, texts, n_lines, dropped)

    leaf = B.exchange(B.first_reports(docs, leaves), n, min_docs)
    known = leaf.unionByName(B.exchange(B.answered(docs, leaf, places), n, min_docs, True))
    named = B.exchange(B.answered(docs, known, templates), n, min_docs)
    out = B.answered(docs, known.unionByName(named), cut, made)
    return _columns(out, text, keep)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL
), parsed AS (
  SELECT doc_id, i, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN chr(1) ELSE t END) AS m FROM lines
), leafed AS (
  SELECT doc_id, i, m, concat_ws(' ', len(m), m[1], m[2], m[3]) AS leaf FROM parsed WHERE len(m) >= 1
), leaves AS (
  SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10
), inside AS (
  SELECT doc_id, i, m, leaf FROM leafed SEMI JOIN leaves USING (leaf)
), tokens AS (
  SELECT doc_id, i, leaf, unnest(range(4, len(m) + 1)) AS p, unnest(m[4:]) AS t FROM inside
), places AS (
  SELECT leaf, p, t, count(DISTINCT doc_id) AS held FROM tokens WHERE t <> chr(1) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10
), levels AS (
  SELECT unnest(range(0, (SELECT CAST(coalesce(max(floor(log2(held / 10.0))), 0) AS BIGINT) + 2 FROM places))) AS k
), rest AS (
  SELECT doc_id, i, k, string_agg(CASE WHEN held >= 10 * 2 ** k THEN f.t ELSE chr(1) END, ' ' ORDER BY s.p) AS tail, count(CASE WHEN held >= 10 * 2 ** k THEN 1 END) AS fixed
  FROM tokens s LEFT JOIN places f ON s.leaf = f.leaf AND s.p = f.p AND s.t = f.t CROSS JOIN levels GROUP BY doc_id, i, k
), templates AS (
  SELECT DISTINCT s.doc_id, s.i, leaf || ' ' || coalesce(tail, '') AS template
  FROM inside s LEFT JOIN rest r ON s.doc_id = r.doc_id AND s.i = r.i
  WHERE coalesce(fixed, 0) + len(list_filter(m[1:3], lambda t: t <> chr(1))) >= 0.5 * len(m)
), recurring AS (
  SELECT template FROM templates GROUP BY template HAVING count(DISTINCT doc_id) >= 10
), gone AS (
  SELECT DISTINCT doc_id, i FROM templates SEMI JOIN recurring USING (template)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), all_lines AS (
  SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(a.n, 0) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN all_lines a ON d.doc_id = a.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
