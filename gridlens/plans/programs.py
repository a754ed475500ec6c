"""The batch programs: prepare digits, train, evaluate, search parameters, report."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.operators import metrics, nn, report, sampling
from gridlens.sources import files, records

DEFAULTS = {"EPOCHS": 50.0, "BATCH_SIZE": 32.0, "LEARNING_RATE": 0.01}


def samples(spark: SparkSession, images: str, labels: str, extra: list[str] = (), seed: int = 1) -> DataFrame:
    """Digits 1..9 of an IDX pair and framed files, and blank cells as class 0, a ninth as many as there are digits."""
    out = records.read_idx(spark, images, labels)
    for path in extra:
        out = sampling.append(out, records.read_framed(spark, path))
    n = out.count()
    size = math.isqrt(len(first.pixels)) if (first := out.select("pixels").first()) else 28
    return sampling.append(out, sampling.empty_samples(spark, n // 9, size, seed))


def prepare_digits(spark: SparkSession, folder: str, out: str, share: float = 0.7, seed: int = 1, side: int = 28) -> dict[str, int]:
    """A folder of named digits, shuffled and split exactly, as framed files under out/train and out/test; files written of each."""
    digits = files.read_digit_folder(spark, folder, side)
    parts = sampling.exact_split(digits, sampling.seeded_order("origin", seed), share)
    as_bytes = F.unhex(F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(F.round(p * 255).cast("int")), 2, "0")), ""))
    packed = parts.select("part", F.col("label").cast("int").alias("label"), as_bytes.alias("pixels"))
    return {p: files.write_files(records.framed_cells(packed.where(F.col("part") == p).drop("part"), side, side), f"{out}/{p}") for p in ("train", "test")}


def train(spark: SparkSession, data: DataFrame, out: str, parameters: str | None = None, model: nn.Model | None = None, share: float = 0.8, batches: int = 16, seed: int = 1) -> tuple[nn.Model, list[float]]:
    """Trains on a seeded share of the samples, keeps the weights that do best on the rest, and writes them as weights.bin.

    Epochs and rate come from a parameter file where there is one. Over a cluster a step takes
    a share of all rows (``batches`` to an epoch), so BATCH_SIZE does not apply.
    """
    settings = DEFAULTS | (files.read_parameters(spark, parameters) if parameters else {})
    keyed = data.withColumn("key", F.xxhash64("label", "pixels")).cache()
    held = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1000)) >= int(1000 * share)
    best, history = nn.train(keyed.where(~held), keyed.where(held), model or nn.Model(seed=seed), "key", int(settings["EPOCHS"]), batches, settings["LEARNING_RATE"], seed=seed)
    keyed.unpersist()
    files.write_files(spark.createDataFrame([("weights.bin", bytearray(files.weights_bytes(best)))], "file string, body binary"), out)
    return best, history


def evaluate(data: DataFrame, model: nn.Model) -> tuple[DataFrame, DataFrame]:
    """Confusion counts, and metrics of every class with a printed line."""
    guessed = nn.predict(data, model).select(F.col("label").cast("int").alias("actual"), "predicted")
    classes = metrics.per_class(guessed)
    return metrics.confusion(guessed), classes.join(metrics.formatted(classes), "class")


def search(spark: SparkSession, data: DataFrame, out: str, model: nn.Model | None = None, epochs: int = 20) -> DataFrame:
    """Trains every configuration of the grid; writes the parameters of the best by F1, then accuracy."""
    grid = report.parameter_grid(spark, epochs=[epochs], batch_size=[32], learning_rate=[0.005, 0.01, 0.02], momentum=[0.0, 0.9])
    scores = nn.grid_search(data, grid, model or nn.Model())
    rows = [(r.config_id, r.accuracy, r.macro_f1, r.confusion) for r in scores.collect()]  # one row a configuration
    found = grid.join(spark.createDataFrame(rows, "config_id int, accuracy double, macro_f1 double, confusion array<long>"), "config_id")
    best = found.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "config_id").first()
    files.write_parameters(spark, out, {"EPOCHS": best.epochs, "BATCH_SIZE": best.batch_size, "LEARNING_RATE": best.learning_rate, "MOMENTUM": best.momentum}, [f"macro F1 {best.macro_f1:.4f}"])
    return found


def analyse(spark: SparkSession, results: str, latex: str | None = None) -> dict[str, DataFrame]:
    """summary, top, marginals, frontier and advice of a results table; the top five as LaTeX rows where a path is given."""
    df = files.read_results(spark, results)
    out = {
        "summary": report.summary(df, ["accuracy", "avg_f1_score", "training_time"]),
        "top": report.ranking(df, "avg_f1_score", "accuracy", "config_id", 10),
        "marginals": report.marginals(df, ["epochs", "batch_size", "learning_rate", "momentum"], "avg_f1_score"),
        "frontier": report.pareto(df, "training_time", "avg_f1_score", "config_id"),
        "advice": report.advice(df, "avg_f1_score", "training_time", "config_id", 0.975),
    }
    if latex:
        rows = report.latex_rows(report.ranking(df, "avg_f1_score", "accuracy", "config_id", 5))
        rows.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(latex)
    return out


def as_matrix(confusion: DataFrame, classes: int = metrics.CLASSES) -> np.ndarray:
    """Confusion counts as a matrix, actual by predicted."""
    out = np.zeros((classes, classes), int)
    for r in confusion.collect():
        out[r.actual, r.predicted] = r.n
    return out
