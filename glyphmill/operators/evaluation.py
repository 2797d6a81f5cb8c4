"""Evaluation: ranking measures, length statistics, quantisation cost, tolerance checks and classifiers."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import places

#: Ranges of scores that are ranked apart in ``auc``.
RANGES = 1024


def auc(scored: DataFrame, label: Column, score: Column, ranges: int = RANGES) -> DataFrame:
    """One row, ``auc``: the chance that a positive row scores above a negative one, ties at half. Null where either
    class has no row. Rows with a null label or score don't count.

    Equal scores are one row after a partial aggregate. Ranks come from the counts of ranges of scores and ranks
    within a range. The ranges lie between approximate quantiles of the distinct scores, so each has about as many as
    any other, however the scores are spread, and no task sorts all of them.
    """
    from pyspark.ml.feature import Bucketizer

    rows = scored.select(label.cast("int").alias("y"), score.cast("double").alias("s")).where("y IS NOT NULL AND s IS NOT NULL")
    per = places.stored(rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))  # scored once
    cuts = per.agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]
    placed = Bucketizer(splits=splits, inputCol="s", outputCol="r", handleInvalid="keep").transform(per)
    counts = placed.groupBy("r").agg(F.sum("neg").alias("n"))
    lower = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.select("r", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))  # at most a row a range
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("under", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(below), "r")
    sums = ranked.agg(F.sum(F.col("pos") * (F.col("below") + F.col("under") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select((F.col("u") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def gini(scored: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row, ``gini``: twice the area less one."""
    return auc(scored, label, score).select((F.col("auc") * 2 - 1).alias("gini"))


def binarize(score: Column, least: int = 3) -> Column:
    return score >= least


def describe_lengths(df: DataFrame, length: Column) -> DataFrame:
    """One row of count, mean, deviation, least, quartiles, most, and the sum in MiB. Quartiles are exact: the
    engine counts equal lengths, of which there are few."""
    n = df.select(length.alias("x"))
    q = lambda p: F.percentile("x", F.lit(p))
    return n.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("x").alias("max"), (F.sum("x") / F.lit(1048576.0)).alias("mib"))


def histogram(df: DataFrame, value: Column, bins: int = 100) -> DataFrame:
    """``bin`` and ``count`` of equal-width bins from the least to the largest value; empty bins have no row."""
    x = df.select(value.cast("double").alias("x")).where("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    return x.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def stored_mib(df: DataFrame, codes_col: str) -> DataFrame:
    """One row, ``mib``: a byte for each code."""
    return df.agg((F.sum(F.size(codes_col)) / F.lit(1048576.0)).alias("mib"))


def within(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def compare_vectors(left: DataFrame, right: DataFrame, id_col: str, vector_col: str, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """One row: ``rows`` that both have, ``different`` ones with a value beyond the tolerance or another length, and
    ``worst``, the largest difference."""
    both = left.select(id_col, F.col(vector_col).alias("a")).join(right.select(id_col, F.col(vector_col).alias("b")), id_col)
    gaps = F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    close = (F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", lambda x, y: within(x.cast("double"), y.cast("double"), rtol, atol)), lambda ok: F.coalesce(ok, F.lit(False)))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((~close).cast("bigint")), F.lit(0)).alias("different"), F.max(F.array_max(gaps)).alias("worst"))


@dataclass
class Result:
    name: str
    auc: float | None
    rows: int
    seconds: float
    scored: DataFrame

    @property
    def rows_per_second(self) -> float:
        return self.rows / max(self.seconds, 1e-9)


def classifier(kind: str, dims: int, seed: int = 42):
    """``logistic`` (almost unregularised), ``mlp`` (two hidden layers of 256), or ``bigrams`` (hashed word unigrams
    and bigrams, by their share of the text's as in an averaging classifier, with logistic regression: the baseline on
    plain text)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, SQLTransformer

    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000, regParam=1e-6)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[dims, 256, 256, 2], maxIter=30, blockSize=128, seed=seed)
    if kind == "bigrams":
        return Pipeline(stages=[
            NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
            HashingTF(inputCol="grams", outputCol="counts", numFeatures=1 << 18),
            IDF(inputCol="counts", outputCol="weighted", minDocFreq=2),
            Normalizer(inputCol="weighted", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=1e-4),
        ])
    raise ValueError(f"no classifier {kind!r}")


def evaluate(estimator, name: str, fit_on: DataFrame, held_out: DataFrame, id_col: str = "doc_id") -> Result:
    """Fit, score the held-out rows, time the scoring, and take the area under the curve."""
    from pyspark.ml.functions import vector_to_array

    model = estimator.fit(fit_on)
    scored = model.transform(held_out).select(id_col, "label", vector_to_array("probability")[1].alias("score"))
    began = time.perf_counter()
    rows = scored.where(F.col("score") >= 0).count()
    took = time.perf_counter() - began
    return Result(name, auc(scored, F.col("label"), F.col("score")).first()[0], rows, took, scored)


@contextmanager
def section(seconds: dict[str, float], name: str) -> Iterator[None]:
    """Add the time that the block takes to ``seconds[name]``, also if it raises."""
    began = time.perf_counter()
    try:
        yield
    finally:
        seconds[name] = seconds.get(name, 0.0) + time.perf_counter() - began
