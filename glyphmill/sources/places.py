"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workfolder(spark: SparkSession) -> str:
    """A new folder under the shared one that the cluster names in ``spark.checkpoint.dir``, or that the session was
    given. Only on one machine, as in tests, a temporary folder is taken where neither is set; elsewhere that is a
    ``ValueError``, as executors would write to disks of their own."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="glyphmill-")
        context.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder once and read from there."""
    folder = workfolder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
