"""Digit sets: IDX pairs and framed files.

IDX: big-endian 32-bit magic (2051 images, 2049 labels), count, for images rows and columns, then bytes.
Framed: big-endian magic 0xDEADBEEF, count, width, height, then count times (label byte, pixels).
A file is one row of ``binaryFile``, which holds files of up to 2 GB; records become rows in slices.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

IDX_IMAGES, IDX_LABELS, FRAMED = 2051, 2049, 0xDEADBEEF
SAMPLES = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("label", T.ShortType()), T.StructField("pixels", T.ArrayType(T.FloatType()))])
_SLICE = 4096


def _records(body: bytes, magic: int, head: str) -> tuple[tuple[int, ...], np.ndarray]:
    if len(body) < struct.calcsize(head):
        raise ValueError("the file ends within its header")
    got, *rest = struct.unpack_from(head, body)
    if got != magic:
        raise ValueError(f"magic {got}, not {magic}")
    return tuple(rest), np.frombuffer(body, np.uint8)[struct.calcsize(head) :]


def _read(spark: SparkSession, path: str, cut, made: T.StructType) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from cut(name, body)

    return files.mapInArrow(run, made)


def idx_images(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0), width, height and pixels (bytes) of every image; fails on another magic or a short file."""
    made = T.StructType([T.StructField("position", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    def cut(name: str, body: bytes) -> Iterator[pa.RecordBatch]:
        (count, rows, cols), data = _records(body, IDX_IMAGES, ">IIII")
        if len(data) < count * rows * cols:
            raise ValueError(f"{name}: {len(data)} bytes for {count} images")
        size = rows * cols
        for lo in range(0, count, _SLICE):
            hi = min(count, lo + _SLICE)
            cells = [data[k * size : (k + 1) * size].tobytes() for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, hi), pa.int64()), pa.array([cols] * (hi - lo), pa.int32()), pa.array([rows] * (hi - lo), pa.int32()), pa.array(cells, pa.binary())], names=made.names)

    return _read(spark, path, cut, made)


def idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """position and label."""
    made = T.StructType([T.StructField("position", T.LongType()), T.StructField("label", T.ShortType())])

    def cut(name: str, body: bytes) -> Iterator[pa.RecordBatch]:
        (count,), data = _records(body, IDX_LABELS, ">II")
        if len(data) < count:
            raise ValueError(f"{name}: {len(data)} bytes for {count} labels")
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int64()), pa.array(data[:count].astype(np.int16))], names=made.names)

    return _read(spark, path, cut, made)


def unit_pixels(column) -> F.Column:
    """Bytes as numbers 0..1, without Python: a byte is two hex digits."""
    digits = F.hex(column)
    return F.when(F.length(column) == 0, F.array().cast("array<float>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: (F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0)).cast("float"))
    )


def read_idx(spark: SparkSession, images: str, labels: str, drop_zero: bool = True) -> DataFrame:
    """sample_id, label and pixels 0..1: images and labels joined by position; the two must agree in number. Label 0 is left out unless told otherwise."""
    a, b = idx_images(spark, images), idx_labels(spark, labels)
    if (n := a.select("position").count()) != (m := b.count()):
        raise ValueError(f"{n} images, {m} labels")
    out = a.join(b, "position").select(F.col("position").alias("sample_id"), "label", unit_pixels(F.col("pixels")).alias("pixels"))
    return out.where("label <> 0") if drop_zero else out


def read_framed(spark: SparkSession, path: str, drop_zero: bool = True) -> DataFrame:
    """sample_id (within a file), label and pixels 0..1; a path without files gives no rows."""

    def cut(name: str, body: bytes) -> Iterator[pa.RecordBatch]:
        (count, width, height), data = _records(body, FRAMED, ">IIII")
        size = width * height + 1
        if len(data) < count * size:
            raise ValueError(f"{name}: {len(data)} bytes for {count} records")
        cells = data[: count * size].reshape(count, size)
        for lo in range(0, count, _SLICE):
            part = cells[lo : lo + _SLICE]
            pixels = (part[:, 1:] / np.float32(255)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * (size - 1)), pa.array(pixels.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part[:, 0].astype(np.int16)), lists], names=SAMPLES.names)

    try:
        out = _read(spark, path, cut, SAMPLES)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = spark.createDataFrame([], SAMPLES)
    return out.where("label <> 0") if drop_zero else out


def framed_bytes(labels: np.ndarray, images: np.ndarray) -> bytes:
    """A framed file of images (n, height, width) of bytes."""
    n, h, w = images.shape
    body = np.concatenate([labels.astype(np.uint8)[:, None], images.astype(np.uint8).reshape(n, -1)], axis=1)
    return struct.pack(">IIII", FRAMED, n, w, h) + body.tobytes()


def idx_bytes(images: np.ndarray) -> bytes:
    n, h, w = images.shape
    return struct.pack(">IIII", IDX_IMAGES, n, h, w) + images.astype(np.uint8).tobytes()


def idx_label_bytes(labels: np.ndarray) -> bytes:
    return struct.pack(">II", IDX_LABELS, len(labels)) + labels.astype(np.uint8).tobytes()


def idx_cells(df: DataFrame, order: str, width: int, height: int) -> DataFrame:
    """file and body: ``images.idx`` and ``labels.idx`` of samples (label, pixels as bytes) in an order.

    The format is one file each, of up to 2 GB here, so one task packs them.
    """
    made = T.StructType([T.StructField("file", T.StringType()), T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, images = bytearray(), bytearray()
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(body) != width * height:
                    raise ValueError(f"{len(body)} pixels, not {width} x {height}")
                labels.append(label)
                images += body
        heads = struct.pack(">IIII", IDX_IMAGES, len(labels), height, width), struct.pack(">II", IDX_LABELS, len(labels))
        yield pa.RecordBatch.from_arrays([pa.array(["images.idx", "labels.idx"]), pa.array([heads[0] + bytes(images), heads[1] + bytes(labels)], pa.binary())], names=made.names)

    return df.repartition(1).sortWithinPartitions(order).select("label", "pixels").mapInArrow(run, made)


def framed_cells(df: DataFrame, width: int, height: int, per_file: int = 65536) -> DataFrame:
    """file and body: samples (label, pixels as bytes) packed into framed files of at most ``per_file`` records; no samples, no files."""
    made = T.StructType([T.StructField("file", T.StringType()), T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{k:05d}.bin"]), pa.array([struct.pack(">IIII", FRAMED, n, width, height) + b"".join(held)], pa.binary())], names=made.names)

        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(body) != width * height:
                    raise ValueError(f"{len(body)} pixels, not {width} x {height}")
                held.append(bytes([label]) + body)
                n += 1
                if n == per_file:
                    yield flush()
                    held, n, k = [], 0, k + 1
        if n:
            yield flush()

    return df.select("label", "pixels").mapInArrow(run, made)
