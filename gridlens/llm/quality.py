"""Quality rules per document and per host.

A document is measured once and held against fixed rules. Every host (any column: a
domain, a source) gets, rule by rule, the share of its documents that fail the rule, shrunk towards the
corpus by a beta prior that is fitted to the hosts themselves: the mean is the corpus's
share, and the strength follows from how much the hosts' shares scatter beyond chance, so
a host of few documents says little. Where few hosts scatter no more than chance would have them, the scatter is not known to be none;
the prior is the weakest that the hosts' number allows at ``SURE`` standard errors, so that a host's own documents always count for something. A host
whose shrunk share of any rule is more than ``host_lift`` times the corpus's is
bad. The verdict joins back: documents of a bad host are held against the strict rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridlens.llm import textkit as K
from gridlens.llm.blocks import _q
from gridlens.llm.shared import bounded_batches, cut_lineage

REPEAT_WORDS = 5
SYMBOLS = b"#*$%&|<>"
#: Hosts up to which the verdicts are sent to every executor; beyond that they are joined by a shuffle.
BROADCAST_HOSTS = 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Limits:
    """Least words, most per 100 words (symbols, repeated words) or lines (equal lines), and bounds of the mean word length."""

    min_words: int = 10
    repeat_pct: int = 20
    symbol_pct: int = 10
    dup_line_pct: int = 50
    min_chars: int = 2
    max_chars: int = 15


BASE = Limits()
#: Three quarters of the base limits (whole numbers, rounded down); a fifth off either end of the word lengths. Short
#: documents are no worse for coming from a bad host, so the least length is the same.
STRICT = Limits(repeat_pct=15, symbol_pct=7, dup_line_pct=37, min_chars=3, max_chars=12)
RULES = ("short", "repeat", "symbol", "dup_line", "chars")
#: A bad host's shrunk share of failures over the corpus's, and standard errors of the scatter.
HOST_LIFT, SURE = 1.5, 1.64


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; null counts as empty."""
    data, off = K.buffers(texts)
    out: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for lo, hi in K.slices(off):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = K.words(part, at)
        view, n = K.eights(part), hi - lo

        def per_doc(flags: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

        hashes = K.span_hashes(part, starts, ends, view)
        out["n_words"].append(np.diff(first))
        out["word_chars"].append(per_doc(~K._SEP[part] & ((part & 0xC0) != 0x80)))
        out["n_symbols"].append(per_doc(symbol[part]))
        # words in windows that the same text has twice
        room = K.room(first, len(starts))
        wide = K.windows(hashes, REPEAT_WORDS)
        whole = np.flatnonzero(room[: len(wide)] >= REPEAT_WORDS)
        doc = np.repeat(np.arange(n), np.diff(first))
        key = K.mix(wide[whole] ^ (doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marked = np.zeros(len(starts), bool)
        marked[whole[twice]] = True
        out["n_repeat_words"].append(per_doc(K.cover(marked, REPEAT_WORDS), first))
        # lines that have a word, and how many of them are new
        begin, end, line_first = K.lines(part, at)
        owner = np.repeat(np.arange(n), np.diff(line_first))
        has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        name = K.mix(K.span_hashes(part, begin[has], end[has], view) ^ (owner[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, new = np.unique(name, return_index=True)
        filled = np.bincount(owner[has], minlength=n)
        out["n_lines"].append(filled)
        out["n_dup_lines"].append(filled - np.bincount(owner[has][new], minlength=n))
    return {m: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for m, x in out.items()}


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the six measures, which replace columns of the same name."""
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in MEASURES]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(keep.index(text)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, measure_texts(texts).values())], names=schema.names)

    return df.select(*map(_q, keep)).mapInArrow(run, schema)


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < BASE.min_words) | (100 * F.col("n_repeat_words") > BASE.repeat_pct * F.col("n_words"))


def broken(x: Limits) -> dict[str, Column]:
    """Whether a document breaks each rule."""
    words = F.col("n_words")
    return {
        "short": words < x.min_words,
        "repeat": 100 * F.col("n_repeat_words") > x.repeat_pct * words,
        "symbol": 100 * F.col("n_symbols") > x.symbol_pct * words,
        "dup_line": 100 * F.col("n_dup_lines") > x.dup_line_pct * F.col("n_lines"),
        "chars": (F.col("word_chars") < x.min_chars * words) | (F.col("word_chars") > x.max_chars * words),
    }


def breaks(x: Limits) -> Column:
    return reduce(Column.__or__, broken(x).values())


def host_verdicts(stats: DataFrame, host: str, host_lift: float) -> DataFrame:
    """One row per host: host_null, host_name, docs, and of each rule the failures and the shrunk rate; lift (the greatest rate over the corpus's), host_bad.

    Rows are added up before they are shuffled, so a host with a third of them is one row a task.
    """
    failed = [F.sum(c.cast("double")).alias(f"failed_{r}") for r, c in broken(BASE).items()]
    hosts = stats.groupBy(F.col(_q(host)).isNull().alias("host_null"), F.coalesce(F.col(_q(host)).cast("string"), F.lit("")).alias("host_name")).agg(F.count(F.lit(1)).cast("double").alias("docs"), *failed)
    hosts = cut_lineage(hosts)
    sums = [F.sum("docs"), F.sum(F.col("docs") * F.col("docs")), F.count(F.lit(1))]
    for r in RULES:
        f = F.col(f"failed_{r}")
        sums += [F.sum(f), F.sum(f * f / F.col("docs"))]
    docs, docs_squared, n, *rest = hosts.agg(*sums).first()
    lifts = []
    for k, r in enumerate(RULES):
        a, b = beta_prior(docs, rest[2 * k], rest[2 * k + 1], docs_squared, n)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))
        mean = (rest[2 * k] or 0.0) / docs if docs else 0.0
        lifts.append(F.col(f"rate_{r}") / F.lit(mean) if mean else F.lit(0.0))
    return hosts.withColumn("lift", F.greatest(*lifts)).withColumn("host_bad", F.col("lift") > F.lit(host_lift))


def beta_prior(docs: float | None, failed: float | None, squares: float | None, docs_squared: float | None, hosts: int, sure: float = SURE) -> tuple[float, float]:
    """Moments of a beta prior from sums over hosts: of documents, failures, failures^2 / documents, documents^2, and the number of hosts.

    The scatter is taken ``sure`` of its standard errors above what was found. Still no scatter beyond chance (or one host, or none)
    gives a prior that outweighs every host; shares that are all 0 or all 1 give a mean at that end.
    """
    if not docs:
        return 1.0, 1.0
    mean = failed / docs
    if mean in (0.0, 1.0):
        return mean, 1.0 - mean
    chance = mean * (1 - mean)
    scatter = squares - failed * mean
    room = docs - docs_squared / docs
    beyond = (scatter - (hosts - 1 - sure * math.sqrt(2 * (hosts - 1))) * chance) / room if room > 0 else 0.0
    strength = max(1e-3, chance / beyond - 1) if beyond > chance * 1e-9 else 1e9
    strength = min(strength, 1e9)
    return mean * strength, (1 - mean) * strength


def judge(df: DataFrame, text: str = "text", host: str = "source", host_lift: float = HOST_LIFT) -> DataFrame:
    """All columns, the measures, base_failed, host_lift, host_bad and kept.

    kept is false where a base rule fails, where a document breaks ``BASE``, or where its
    host is bad and it breaks ``STRICT``. A null host is a host of its own. Null and empty
    texts have no words and fail. Rows may repeat; columns named like an output are replaced.
    An empty table gives an empty result.

    Measuring is a map over batches and runs twice, once for the hosts and once for the
    result, so that no text is shuffled or stored.
    """
    made = ["base_failed", "host_lift", "host_bad", "kept"]
    stats = measured(df, text)
    stats = stats.select(*[_q(c) for c in stats.columns if c.lower() not in made or c in (text, host)])
    verdicts = host_verdicts(stats, host, host_lift).select("host_null", "host_name", "lift", "host_bad")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    v = verdicts.select(F.struct("lift", "host_bad").alias("_verdict"), F.col("host_null").alias("_host_null"), F.col("host_name").alias("_host_name"))
    name = F.col(_q(host))
    joined = stats.join(v, (name.isNull() == F.col("_host_null")) & (F.coalesce(name.cast("string"), F.lit("")) == F.col("_host_name")), "left")
    bad = F.coalesce(F.col("_verdict.host_bad"), F.lit(False))
    return joined.select(
        *[_q(c) for c in stats.columns],
        base_failed().alias("base_failed"),
        F.col("_verdict.lift").alias("host_lift"),
        bad.alias("host_bad"),
        (~(base_failed() | breaks(BASE) | (bad & breaks(STRICT)))).alias("kept"),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(x: Limits) -> dict[str, str]:
    rules = {
        "short": "n_words < {min_words}",
        "repeat": "100 * n_repeat_words > {repeat_pct} * n_words",
        "symbol": "100 * n_symbols > {symbol_pct} * n_words",
        "dup_line": "100 * n_dup_lines > {dup_line_pct} * n_lines",
        "chars": "(word_chars < {min_chars} * n_words OR word_chars > {max_chars} * n_words)",
    }
    return {r: q.format(**asdict(x)) for r, q in rules.items()}


def _any(x: Limits) -> str:
    return "(" + " OR ".join(_sql(x).values()) + ")"


OP9_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), wins AS (
  SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS w
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs WHERE len(ws) >= 5)
), again AS (
  SELECT k, i FROM wins WHERE (k, w) IN (SELECT (k, w) FROM wins GROUP BY k, w HAVING count(*) > 1)
), covered AS (
  SELECT k, count(DISTINCT i) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS i FROM again) GROUP BY k
), ls AS (
  SELECT k, count(*) AS n_lines, count(DISTINCT l) AS n_new
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k
), stats AS (
  SELECT d.k, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines - n_new, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON d.k = c.k LEFT JOIN ls ON d.k = ls.k
), failures AS (
  SELECT source, unnest([{rules}]) AS rule, unnest([{broken}]) AS fails FROM stats
), hosts AS (
  SELECT rule, source IS NULL AS host_null, coalesce(source, '') AS host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (fails) AS DOUBLE) AS f FROM failures GROUP BY 1, 2, 3
), fit AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS scatter, sum(n) - sum(n * n) / sum(n) AS room, count(*) AS h FROM hosts GROUP BY rule
), beyond AS (
  SELECT rule, mean, mean * (1 - mean) AS chance, CASE WHEN room > 0 THEN (scatter - (h - 1 - 1.64 * sqrt(2 * (h - 1))) * mean * (1 - mean)) / room ELSE 0 END AS beyond FROM fit
), prior AS (
  SELECT rule, mean, CASE WHEN mean IN (0, 1) THEN 1 WHEN beyond > chance * 1e-9 THEN least(1e9, greatest(1e-3, chance / beyond - 1)) ELSE 1e9 END AS strength FROM beyond
), verdicts AS (
  SELECT host_null, host, max(CASE WHEN mean > 0 THEN (f + mean * strength) / (n + strength) / mean ELSE 0 END) > 1.5 AS bad FROM hosts JOIN prior USING (rule) GROUP BY 1, 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR {base} OR (bad AND {strict})) AS kept
FROM stats JOIN verdicts ON (source IS NULL) = host_null AND coalesce(source, '') = host
""".replace("{rules}", ", ".join(f"'{r}'" for r in RULES)).replace("{broken}", ", ".join(_sql(BASE).values())).replace("{base}", _any(BASE)).replace("{strict}", _any(STRICT))
