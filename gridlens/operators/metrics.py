"""Classification metrics from (actual, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CLASSES = 10


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """actual, predicted and n, for pairs that occur."""
    return df.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    """0 on an empty denominator."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_class(df: DataFrame, actual: str = "actual", predicted: str = "predicted", classes: int = CLASSES) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of every class 0 .. classes - 1, those without rows too.

    The confusion table is at most classes x classes rows; each of its cells counts for its
    actual and for its predicted class.
    """
    cells = confusion(df, actual, predicted)
    same = F.col("actual") == F.col("predicted")
    parts = F.explode(
        F.array(
            F.struct(F.col("actual").alias("class"), F.when(same, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(~same, F.col("n")).otherwise(0).alias("fn")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(~same, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
        )
    )
    counts = cells.select(parts.alias("p")).groupBy(F.col("p.class").alias("class")).agg(*[F.sum(f"p.{k}").alias(k) for k in ("tp", "fp", "fn")])
    spine = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    full = spine.join(counts, "class", "left").select("class", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return full.select("class", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def macro_f1(df: DataFrame, actual: str = "actual", predicted: str = "predicted", classes: int = CLASSES) -> DataFrame:
    """The mean of f1 over all classes."""
    return per_class(df, actual, predicted, classes).agg(F.avg("f1").alias("macro_f1"))


def accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def formatted(metrics: DataFrame) -> DataFrame:
    """One text line per class."""
    return metrics.select("class", F.format_string("class %d: precision %.4f recall %.4f f1 %.4f", "class", "precision", "recall", "f1").alias("line"))
