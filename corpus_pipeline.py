"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage is (name, function) and works on all that its predecessor kept. The first four return
the columns of documents; the last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.llm import linededup, mixing, neardup, quality, wordbpe
from gridlens.llm.shared import dropped, stored, transient

#: Seeded block selection and the tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, the strict ones if their host (source) is bad.

    A null or empty text has no words and goes; a null source is a host of its own; repeated rows are judged each and
    stay or go together; other columns are kept as they are. An empty table gives an empty one.
    """
    return quality.judge(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates beyond the first document's.

    The first document keeps its lines because copies are still in the corpus: a group of ten or more would lose its whole text.
    A null text stays null, an empty one empty; null ids come last, and rows of one id count as one document for being first;
    of repeated rows each counts as a document. An empty table gives an empty one.
    """
    return _as(docs, linededup.drop_recurring(docs, keep_first=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, without long lines that an earlier one of them holds.

    The one of least id stays, of equal ids the one of least text hash, a null id before others; a repeated row stays once.
    Documents without words (null, empty) are like no other and all stay. An empty table gives an empty one.
    """
    with transient(spark) as steps:
        kept = steps.keep(stored(neardup.keep_one(docs), "near", even=False))
    return _as(docs, linededup.drop_repeated(kept))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a part taken has its words alone.

    Null and empty texts have size 0 and are not taken; a null source is a source of its own, last in order; places in the mix
    hang on id and text, so repeated rows may change places without effect. An empty table gives an empty one.
    """
    return _as(docs, mixing.take(mixing.quotas(docs, order="doc_id", carry_text=True)))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of each whole text, their number, and digests of the ids and of the text they decode to.

    Null and empty texts have no ids and the digests of nothing; null ids and sources stay null; repeated rows each give a row; other
    columns play no part. An empty table gives an empty one.
    """
    out = wordbpe.round_trip(docs, keep=["doc_id", "source"])
    return out.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again. What a stage has stored on its way, and what it read, goes when it stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with transient(spark) as steps:
            before, docs = docs, steps.keep(stored(stage(spark, docs, sf_dir), name, even=False))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
