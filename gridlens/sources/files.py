"""Images, model weights, the results table, parameters, and writing whole files.

Files that are one cell of a DataFrame go out through the session's Hadoop file system, so the path may
be in any store.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as store
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlens.operators import nn

WEIGHTS_MAGIC = 0x434E4E57
METRICS = ("precision", "recall", "f1")
RESULTS_SCHEMA = "epochs int, batch_size int, learning_rate double, momentum double, accuracy double, avg_f1_score double, training_time double, " + ", ".join(f"{m}_{d} double" for d in range(10) for m in METRICS)


# -- images -----------------------------------------------------------------------------


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, channels and data (rows from the top, red first) of JPG, PNG and BMP files; unreadable ones are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    i = F.col("image")
    return raw.select(i["origin"].alias("origin"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), _red_first(i["data"], i["nChannels"]).alias("data"))


def _red_first(data: Column, channels: Column) -> Column:
    """Blue-green-red to red-green-blue (and alpha last); gray stays."""

    def turned(n: int) -> Column:
        digits = F.hex(data)
        pixels = F.transform(F.sequence(F.lit(0), (F.length(data) / n).cast("int") - 1), lambda k: F.concat(*[F.substring(digits, k * (2 * n) + 2 * c + 1, F.lit(2)) for c in (2, 1, 0, *range(3, n))]))
        return F.unhex(F.array_join(pixels, ""))

    return F.when(channels == 3, turned(3)).when(channels == 4, turned(4)).otherwise(data)


def as_array(row) -> np.ndarray:
    """A row of ``read_images`` as height x width (x channels)."""
    a = np.frombuffer(bytes(row["data"]), np.uint8)
    return a.reshape(row["height"], row["width"], row["channels"]) if row["channels"] > 1 else a.reshape(row["height"], row["width"])


def label_of(origin: Column) -> Column:
    """The digit in a name like digit_00012_label_7.png; null of other names."""
    return F.nullif(F.regexp_extract(origin, r"digit_\d+_label_(\d)", 1), F.lit("")).cast("short")


def write_files(df: DataFrame, folder: str, name: str = "file", body: str = "body") -> int:
    """Every row as a file of its own under a folder; the number of files.

    Spark has no sink for whole files. Where Arrow knows the folder's store (local, HDFS, S3, GCS), executors write their rows;
    elsewhere rows come to the driver one partition at a time and go out by the session's Hadoop file system. Each file is written
    under a temporary name and renamed, so none shows half written, and a task that runs twice does no harm.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    fs.mkdirs(root)
    uri = fs.makeQualified(root).toString()
    try:
        store.FileSystem.from_uri(uri)
    except (ValueError, OSError, pa.ArrowException):
        return _write_by_driver(df.select(name, body), jvm, fs, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = store.FileSystem.from_uri(uri)
        for batch in batches:
            for k in range(batch.num_rows):
                last, part = f"{at}/{batch.column(0)[k].as_py()}", f"{at}/_{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(batch.column(1)[k].as_buffer())
                files.move(part, last)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(F.col(name).cast("string"), F.col(body).cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _write_by_driver(df: DataFrame, jvm, fs, root) -> int:
    n = 0
    for row in df.toLocalIterator():
        last = jvm.org.apache.hadoop.fs.Path(root, row[0])
        part = jvm.org.apache.hadoop.fs.Path(root, f"_{row[0]}.part")
        out = fs.create(part, True)
        out.write(bytearray(row[1]))
        out.close()
        fs.delete(last, False)
        fs.rename(part, last)
        n += 1
    return n


def write_npy(df: DataFrame, path: str, value: str, order: list[Column], kind: str = "<i8") -> int:
    """One column in an order as a one-dimensional .npy file; the number of values, which may not be null.

    The format is a single file, so values pass the driver, a partition at a time.
    """
    spark = df.sparkSession
    n = df.count()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": kind, "fortran_order": False, "shape": (n,)})
    out = fs.create(at, True)
    out.write(bytearray(head.getvalue()))
    held: list = []
    for row in df.orderBy(*order).select(value).toLocalIterator():
        held.append(row[0])
        if len(held) == 1 << 16:
            out.write(bytearray(np.array(held, kind).tobytes()))
            held = []
    out.write(bytearray(np.array(held, kind).tobytes()))
    out.close()
    return n


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0) and value of a one-dimensional .npy file of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                values = np.load(io.BytesIO(body), allow_pickle=False).astype(np.int64)
                for lo in range(0, len(values), 1 << 16):
                    part = values[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["position", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "position long, value long")


# -- weights ----------------------------------------------------------------------------


def weights_bytes(m: nn.Model) -> bytes:
    """Magic, then the layers' weights and biases in order, as 32-bit floats in this machine's byte order."""
    return struct.pack("=I", WEIGHTS_MAGIC) + b"".join(np.ascontiguousarray(m.weights[k], np.float32).tobytes() for k in nn.NAMES)


def weights_from(body: bytes, like: nn.Model | None = None) -> nn.Model:
    """A model of the same shape as ``like`` (the usual one); fails on another magic or length."""
    m = (like or nn.Model()).copy()
    if len(body) < 4 or struct.unpack_from("=I", body)[0] != WEIGHTS_MAGIC:
        raise ValueError("not a weights file")
    if len(body) != 4 + 4 * m.size():
        raise ValueError(f"{len(body)} bytes, not {4 + 4 * m.size()}")
    stream = io.BytesIO(body[4:])
    for k in nn.NAMES:
        w = m.weights[k]
        m.weights[k] = np.frombuffer(stream.read(4 * w.size), np.float32).reshape(w.shape).copy()
    return m


def read_weights(spark: SparkSession, path: str, like: nn.Model | None = None) -> nn.Model:
    return weights_from(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]), like)


# -- results and parameters -------------------------------------------------------------


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The 37 columns of a grid search, with a config_id by line order within each file."""
    out = spark.read.schema(RESULTS_SCHEMA).csv(path, header=True)
    return out.withColumn("config_id", (F.monotonically_increasing_id() + 1).cast("long"))


def write_results(df: DataFrame, path: str) -> None:
    """As CSV with a header: four decimals, times with two."""
    names = [c.strip().split(" ")[0] for c in RESULTS_SCHEMA.split(",")]

    def cell(c: str) -> Column:
        if c in ("epochs", "batch_size"):
            return F.col(c)
        return F.format_string("%.2f" if c in ("momentum", "training_time") else "%.4f", F.col(c).cast("double")).alias(c)

    df.select(*[cell(c) for c in names]).write.mode("overwrite").csv(path, header=True)


def read_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    """KEY=value lines; blank lines, comments and other lines are skipped."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    pair = rows.select(F.regexp_extract("value", r"^\s*([A-Z_]+)\s*=", 1).alias("k"), F.expr("try_cast(regexp_extract(value, '=\\\\s*(-?[0-9.]+)', 1) AS double)").alias("v"))
    return {r.k: r.v for r in pair.where("k <> '' AND v IS NOT NULL").collect()}


def write_parameters(spark: SparkSession, path: str, values: dict[str, float], notes: list[str] = ()) -> None:
    lines = [f"# {n}" for n in notes] + [f"{k}={v}" for k, v in values.items()]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_puzzle(spark: SparkSession, path: str) -> str:
    """81 characters from a text of nine rows of digits and dots; other lines are skipped."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    rows = [x.replace(" ", "") for text in lines for x in text.splitlines()]
    rows = [x for x in rows if len(x) == 9 and all(c in ".0123456789" for c in x)]
    if len(rows) != 9:
        raise ValueError(f"{len(rows)} rows of a puzzle")
    return "".join(rows).replace("0", ".")


# -- folders of digits ------------------------------------------------------------------


def read_digit_folder(spark: SparkSession, path: str, side: int = 28) -> DataFrame:
    """origin, label (from the name) and pixels 0..1 of side x side, from images named digit_N_label_D.png; others and unreadable ones are left out."""
    from pyspark.sql import types as T

    from gridlens.operators import kernels as K

    photos = read_images(spark, path).withColumn("label", label_of(F.col("origin"))).where("label IS NOT NULL")
    made = T.StructType([T.StructField("origin", T.StringType()), T.StructField("label", T.ShortType()), T.StructField("pixels", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                img = as_array(row)
                img = K.gray(img) if img.ndim == 3 else img
                out.append((K.resize(img, side, side) / np.float32(255)).ravel().astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch["origin"], batch["label"], pa.array(out, pa.list_(pa.float32()))], names=made.names)

    return photos.select("origin", "label", "width", "height", "channels", "data").mapInArrow(run, made)


def digit_metadata(samples: DataFrame, font: str = "drawn") -> DataFrame:
    """filename, label and font of every sample, for ``write.csv(header=True)``."""
    return samples.select(F.element_at(F.split("origin", "/"), -1).alias("filename"), "label", F.lit(font).alias("font"))
