"""A folder that the driver and all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs on one machine, else an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("gridlens.scratch.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="gridlens-")
        spark.conf.set("gridlens.scratch.dir", where)
    return f"{where.rstrip('/')}/gridlens/{name}-{uuid.uuid4().hex}"
