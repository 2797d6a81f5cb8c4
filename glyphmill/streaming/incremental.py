"""Counts and vectors of a corpus that grows by files.

Counting keeps no state in the stream: each micro-batch writes its own partial counts under its number, written over
if the batch is repeated, so a restart counts nothing twice, and reading adds the partial counts up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import words
from ..operators.embed import Embedder
from ..operators.ngrams import count_ngrams, ngrams
from ..sources.corpus import spread


def documents(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder, or of those that a glob names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def count_stream(docs: DataFrame, folder: str, text_col: str = "text", longest: int = 5) -> StreamingQuery:
    """Start counting into ``folder/counts`` what there is, and stop; run it again for what came since."""

    def write(batch: DataFrame, number: int) -> None:
        own = spread(batch.select(text_col)).select(words(F.col(text_col)).alias("tokens"))
        count_ngrams(own, "tokens", longest).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def token_stream(docs: DataFrame, folder: str, text_col: str = "text") -> StreamingQuery:
    """Write the words of what there is into ``folder/tokens``, and stop; run it again for what came since. They are
    much smaller than the counts of all their n-grams, and what is counted from them is exact over all batches."""

    def write(batch: DataFrame, number: int) -> None:
        own = spread(batch.select(text_col)).select(words(F.col(text_col)).alias("tokens"))
        own.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/tokens/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """The counts over all batches so far: ``ngram``, ``n``, ``count``. Those of one batch alone are whole already."""
    parts = spark.read.parquet(f"{folder}/counts")
    if parts.select("batch").distinct().limit(2).count() < 2:
        return parts.select("ngram", "n", "count")
    return parts.groupBy("ngram").agg(F.max("n").alias("n"), F.sum("count").alias("count"))


def running_counts(docs: DataFrame, text_col: str = "text", longest: int = 5) -> DataFrame:
    """The counts as a streaming aggregate, for complete or update mode; its state holds every distinct n-gram, so a
    large corpus wants the RocksDB state store, or ``count_stream``."""
    found = ngrams(docs.select(words(F.col(text_col)).alias("tokens")), "tokens", longest)
    return found.groupBy("ngram", "n").agg(F.count(F.lit(1)).alias("count"))


def embed_stream(model: Embedder, docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Embed what there is into ``folder/vectors``, append mode, and stop; the checkpoint says which files are
    done."""
    rows = model.embed(docs, id_col, text_col)
    return rows.writeStream.format("parquet").option("path", f"{folder}/vectors").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
