"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this process has stored and not yet removed.
_kept: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder if all runs on one machine (which is also set for checkpoints); else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("gridlens.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="gridlens-")
        spark.conf.set("gridlens.shared.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridlens/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is; what is gone already doesn't matter."""
    _kept.pop(path, None)
    if spark.sparkContext._jvm is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for path, spark in list(_kept.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; then nothing can be done
            return


atexit.register(_clear)


def stored(df: DataFrame, name: str, even: bool = True) -> DataFrame:
    """Written to the shared folder and read again, so that a lost executor costs its tasks alone.

    ``even`` deals rows into few files of like size first, as a file costs more than its rows here. Shuffle files of the write go
    when it is done; the folder goes when ``dropped`` is called for it, or else with the driver.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _kept[path] = spark
    with fewer_shuffle_files(spark):
        (df.hint("rebalance") if even else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def dropped(*frames: DataFrame) -> None:
    """Removes what ``stored`` wrote for these, once nothing reads it any more."""
    for df in frames:
        if path := _paths.get(df):
            remove(df.sparkSession, path)


class transient:
    """Removes on leaving what was stored inside, but for the frames given to ``keep``.

    ``with transient(spark) as t: out = t.keep(stored(made(df), "out"))`` leaves ``out`` alone of all steps of ``made``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.before, self.held = spark, set(_kept), set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.add(_paths.get(df))
        return df

    def __enter__(self) -> transient:
        return self

    def __exit__(self, *_) -> None:
        for path in set(_kept) - self.before - self.held:
            remove(self.spark, path)


class fewer_shuffle_files:
    """While it lasts, shuffle files go with the query that wrote them, not when the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.was = spark, spark.conf.get(CLEANUP, None)

    def __enter__(self) -> None:
        self.spark.conf.set(CLEANUP, "true")

    def __exit__(self, *_) -> None:
        if self.was is None:
            self.spark.conf.unset(CLEANUP)
        else:
            self.spark.conf.set(CLEANUP, self.was)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows and bytes of an Arrow batch between Spark and Python, at most. Texts are long, and a batch lies in memory three times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to ``BATCH_ROWS`` and ``BATCH_BYTES``; plans read them when they run, so they stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).strip().lower()
        if not (now.removesuffix("b").isdigit() and 0 < int(now.removesuffix("b")) <= most):
            spark.conf.set(key, str(most))
