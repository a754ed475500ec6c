"""Splits, shuffles, batches, unions and synthetic samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def positions(df: DataFrame, order: list[Column], name: str = "position", ranges: int | None = None) -> DataFrame:
    """A running number from 1 over all rows in the given order, by one shuffle and without one task that holds them all.

    Rows are dealt by ranges of the order (as many as shuffle partitions, unless told otherwise) and numbered inside
    their sorted range; ranges are lifted by the sizes of those before, which are one row a range. ``order`` should
    end in a key, so that ties are settled.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id has the partition above 33 bits and the row in it below
    numbered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_range", F.shiftright("_at", 33))
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(F.broadcast(before), "_range").withColumn(name, row + F.col("_before")).drop("_range", "_at", "_before")


def exact_split(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """part is 'train' for the first floor(n * share) rows of the order, else 'test'."""
    n = df.count()
    return positions(df, order).withColumn("part", F.when(F.col("position") <= math.floor(n * share), "train").otherwise("test"))


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """batch from 0; the last one may be short."""
    return positions(df, order).withColumn("batch", F.floor((F.col("position") - 1) / size))


def seeded_order(key: str, seed: int) -> list[Column]:
    """A shuffle that depends on the key and the seed alone, not on partitions."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(*seeded_order(key, seed))


def append(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows of both; columns go by name."""
    return df.unionByName(extra, allowMissingColumns=True)


def zip_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of one position side by side; fails if the two differ in number."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows on the left, {b} on the right")
    return left.join(right, key)


def uniform(key: Column | str, seed: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A number in [lo, hi) from a key and a seed."""
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key), F.lit(1 << 52)) / float(1 << 52)
    return F.lit(lo) + unit * (hi - lo)


def empty_samples(spark: SparkSession, n: int, size: int = 28, seed: int = 1) -> DataFrame:
    """sample_id, label 0 and pixels of blank cells: 70 % faint noise, 20 % stronger noise, 10 % a lit ground with one to three spots."""
    kind = uniform("id", seed)
    most = F.when(kind < 0.7, 0.05).when(kind < 0.9, 0.15).otherwise(0.1)
    ground = F.when(kind < 0.9, 0.0).otherwise(uniform("id", seed + 1, 0.0, 0.1))
    spots = F.when(kind < 0.9, 0).otherwise(F.floor(uniform("id", seed + 2, 1.0, 4.0)))

    def spot(k: int, i: Column) -> Column:
        at = F.floor(uniform(F.col("id") * 3 + k, seed + 3, 0.0, float(size * size)))
        return (F.lit(k) < spots) & (i == at)

    def pixel(i: Column) -> Column:
        noise = F.pmod(F.xxhash64(F.lit(seed + 4), F.col("id"), i), F.lit(1 << 52)) / float(1 << 52) * most
        return F.when(spot(0, i) | spot(1, i) | spot(2, i), 0.3).otherwise(F.least(F.lit(1.0), ground + noise)).cast("float")

    return spark.range(n).select(F.col("id").alias("sample_id"), F.lit(0).cast("short").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pixel).alias("pixels"))
