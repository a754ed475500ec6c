"""The driver's vectors as images, and conversions between arrays and long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.functions.elementwise import quantise

SIDE = 8


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and px: each vector of 64 numbers as an 8 x 8 image of 0..255."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select("vec_id", "label", F.transform("embedding", lambda v: quantise(v)).alias("px"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and logits: ten sums over each vector, of every tenth number from the first, the second and so on."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = F.size("embedding")

    def total(k):
        places = F.when(n > k, F.sequence(k, n - 1, F.lit(10))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get("embedding", i).cast("double"))

    return vectors.select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(9)), total).alias("logits"))


def to_long(df: DataFrame, key: list[str], px, width: int = SIDE, value: str = "v") -> DataFrame:
    """key, x, y and the value of every pixel."""
    rows = df.select(*key, F.posexplode(px).alias("_at", value))
    return rows.select(*key, (F.col("_at") % width).cast("int").alias("x"), F.floor(F.col("_at") / width).cast("int").alias("y"), value)


def to_arrays(df: DataFrame, key: list[str], value: str = "v") -> DataFrame:
    """Back from a long table: key and px in scan order."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    return df.groupBy(*key).agg(F.transform(cells, lambda c: c["v"]).alias("px"))
