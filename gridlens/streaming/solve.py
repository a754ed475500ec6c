"""Photos dropped into a folder are solved as they come.

The same plan as the batch program, on a file stream: each photo is taken once, by the
checkpoint, and results go out as Parquet with their origin, so requests never share a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlens.operators import nn
from gridlens.plans.solver import RESULT, solve_photo
from gridlens.sources.png import decode_png

#: Photos of one trigger.
PER_TRIGGER = 64


def photo_stream(spark: SparkSession, folder: str, per_trigger: int = PER_TRIGGER) -> DataFrame:
    """path, modificationTime and content of new PNG files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", per_trigger).load(folder)


def solved(stream: DataFrame, m: nn.Model) -> DataFrame:
    """origin, status, corners, clues, solution and image; status 'unreadable' of files that are no 8-bit PNG."""
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path, body in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                photo = decode_png(body)
                out = {"origin": path} | ({"status": "unreadable"} if photo is None else solve_photo(photo, m))
                yield pa.RecordBatch.from_arrays([pa.array([out.get(n)], t) for n, t in zip(RESULT.names, kinds, strict=True)], names=RESULT.names)

    return stream.select("path", "content").mapInArrow(run, RESULT)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, m: nn.Model, once: bool = True) -> StreamingQuery:
    """Starts the stream; ``once`` takes what is there and ends."""
    writer = solved(photo_stream(spark, folder), m).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stage_log(spark: SparkSession, folder: str, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and mean value per window and type of an event stream of Parquet files (ts, event_type, value); late events are taken up to ``delay``."""
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(folder)
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
