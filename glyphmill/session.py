"""Session settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold for any cluster. Partition counts are left to adaptive execution, which starts from a
#: cluster's own ``spark.sql.shuffle.partitions``.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.executorEnv.TOKENIZERS_PARALLELISM": "false",
}


def session(master: str | None = None, name: str = "glyphmill", **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; keywords are further settings with ``__`` for each dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
