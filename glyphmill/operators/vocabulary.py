"""Vocabulary and pseudo inverse frequency from an n-gram summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_vocabulary(summary: DataFrame, min_multiple: float = 10.0, most: int = 2_000_000) -> DataFrame:
    """``idx``, ``ngram``, ``n``, ``count`` and ``idf`` (single precision) of the n-grams that are kept.

    Kept are the ``most`` most frequent of those whose count is at least ``min_multiple`` times the smallest count of
    the summary. Entries are numbered from the rarest, of equal counts the last in the order of the key; the inverse
    frequency is the logarithm of the sum of all kept counts over the entry's. ``most`` bounds the one partition in
    which entries are numbered. A summary of which nothing is kept gives no rows.
    """
    if most < 1:
        raise ValueError("a vocabulary has at least one entry")
    least = summary.agg(F.min("count").alias("least"))  # one row
    kept = summary.crossJoin(F.broadcast(least)).where(F.col("count") >= F.col("least") * float(min_multiple)).drop("least")
    kept = kept.orderBy(F.col("count").desc(), "ngram").limit(most)
    rank = Window.orderBy("count", F.col("ngram").desc())
    every = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    idf = (F.log(F.sum("count").over(every).cast("double")) - F.log(F.col("count").cast("double"))).cast("float")
    return kept.select((F.row_number().over(rank) - 1).alias("idx"), "ngram", "n", "count", idf.alias("idf"))
