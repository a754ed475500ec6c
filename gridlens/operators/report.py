"""The hyper-parameter report: summary, ranking, marginal means, Pareto frontier, advice, LaTeX."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations with a config_id from 1, the first parameter slowest."""
    names = list(values)
    rows = [(k, *combo) for k, combo in enumerate(itertools.product(*values.values()), 1)]
    kinds = ["int" if isinstance(v[0], int) else "double" for v in values.values()]
    return spark.createDataFrame(rows, ", ".join(["config_id int", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """metric, min_value, max_value and mean_value of each column, in one pass."""
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_lo").alias("min_value"), F.col(f"{c}_hi").alias("max_value"), F.col(f"{c}_mean").alias("mean_value")) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def ranking(df: DataFrame, score: str, second: str, key: str, n: int = 10) -> DataFrame:
    """The n best by score, then by a second score, then by key, with their rank."""
    order = [F.desc(score), F.desc(second), F.col(key)]
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def marginals(df: DataFrame, parameters: list[str], score: str) -> DataFrame:
    """parameter, value (as text), mean_score, std_score (sample; null of one row) and n: one pass over all parameters by grouping sets."""
    sets = df.groupingSets([[F.col(p)] for p in parameters], *[F.col(p) for p in parameters])
    out = sets.agg(F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"), F.count(F.lit(1)).alias("n"), *[F.grouping(p).alias(f"_{p}") for p in parameters])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in parameters:
        name = F.when(F.col(f"_{p}") == 0, F.lit(p)).otherwise(name)
        value = F.when(F.col(f"_{p}") == 0, F.col(p).cast("string")).otherwise(value)
    return out.select(name.alias("parameter"), value.alias("value"), "mean_score", "std_score", "n")


def pareto(df: DataFrame, cost: str, score: str, key: str) -> DataFrame:
    """Rows that beat every cheaper row's score, by ascending cost (then higher score, then key), with speedup against the dearest of them.

    The running best needs one order over all rows. To keep that from one task, rows are cut to
    the best of each cost first, which is all that can stand on the frontier; of equal costs the higher
    score stands, of equal scores the lower key.
    """
    best = df.groupBy(cost).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))).alias("b"))
    thin = best.select(F.col(cost), F.col("b.s").alias(score), (-F.col("b.k")).alias(key))
    # ranges of cost: a row must beat the best of its own range so far, and that of all ranges before
    ranges = 64
    bounds = thin.agg(F.min(cost).alias("lo"), F.max(cost).alias("hi"))
    cut = F.least(F.lit(ranges - 1), F.floor((F.col(cost) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * ranges))
    dealt = thin.join(F.broadcast(bounds)).withColumn("part", F.coalesce(cut, F.lit(0)).cast("int")).drop("lo", "hi")
    inside = Window.partitionBy("part").orderBy(F.col(cost)).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("prev", F.max(score).over(inside)).where(F.col("prev").isNull() | (F.col(score) > F.col("prev")))
    tops = dealt.groupBy("part").agg(F.max(score).alias("top"))
    before = tops.select("part", F.max("top").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    kept = local.join(F.broadcast(before), "part").where(F.col("before").isNull() | (F.col(score) > F.col("before")))
    dearest = kept.agg(F.max(cost).alias("dearest"))
    return kept.join(F.broadcast(dearest)).select(key, cost, score, (F.col("dearest") / F.col(cost)).alias("speedup"))


def advice(df: DataFrame, score: str, cost: str, key: str, enough: float) -> DataFrame:
    """The best row, the cheapest row of a score above ``enough``, how many times cheaper that is and what score it gives up."""
    best = df.orderBy(F.desc(score), F.col(key)).limit(1).select(F.col(key).alias("best"), F.col(score).alias("best_score"), F.col(cost).alias("best_cost"))
    fast = df.where(F.col(score) > enough).orderBy(cost, key).limit(1).select(F.col(key).alias("fastest"), F.col(score).alias("fastest_score"), F.col(cost).alias("fastest_cost"))
    return best.join(fast).select("*", (F.col("best_cost") / F.col("fastest_cost")).alias("cost_ratio"), (F.col("best_score") - F.col("fastest_score")).alias("score_gap"))


def latex_rows(ranked: DataFrame) -> DataFrame:
    """rank and line: a table row per configuration, whole numbers with one decimal place."""
    return ranked.select("rank", F.format_string("%d & %.1f & %.1f & %.4f & %.2f & %.4f & %.4f \\\\", "rank", F.col("epochs").cast("double"), F.col("batch_size").cast("double"), "learning_rate", "momentum", "accuracy", "avg_f1_score").alias("line"))


def early_stop_runs(df: DataFrame, group: str, order: list[str], value: str, min_delta: float, patience: int) -> DataFrame:
    """group, step, value, improved and stale: steps since the last that beat the best before it by more than ``min_delta``; and stop, whether stale has reached ``patience``."""
    w = Window.partitionBy(group).orderBy(*order)
    steps = df.select(group, *order, value, F.row_number().over(w).alias("step"), F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("best"))
    improved = F.col("best").isNull() | (F.col(value) > F.col("best") + min_delta)
    marked = steps.withColumn("improved", improved)
    last = F.max(F.when(F.col("improved"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("stale", F.col("step") - last).withColumn("stop", F.col("stale") >= patience).select(group, *order, "step", "improved", "stale", "stop")
