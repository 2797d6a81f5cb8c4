import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import evaluation


def brute_auc(y, s):
    pairs = [(a > b) + (a == b) / 2 for a, ya in zip(s, y, strict=True) for b, yb in zip(s, y, strict=True) if ya == 1 and yb == 0]
    return sum(pairs) / len(pairs)


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_auc(spark, digits):
    rng = np.random.default_rng(digits)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.normal(size=200) + y * 0.7, digits)
    rows = [(int(a), float(b)) for a, b in zip(y, s, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0), (1, None)], "y int, s double")
    got = evaluation.auc(df, F.col("y"), F.col("s")).first().auc
    assert got == pytest.approx(brute_auc(y, s))
    assert evaluation.gini(df, F.col("y"), F.col("s")).first().gini == pytest.approx(2 * got - 1)


def test_auc_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluation.auc(df, F.col("y"), F.col("s")).first().auc is None
    assert evaluation.auc(df.limit(0), F.col("y"), F.col("s")).first().auc is None


def test_lengths(spark):
    x = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame([(v,) for v in x], "x bigint")
    got = evaluation.describe_lengths(df, F.col("x")).first()
    assert (got["count"], got.min, got.max) == (8, 1, 9) and got.q50 == np.median(x) and got["std"] == pytest.approx(np.std(x, ddof=1))
    bins = {r.bin: r["count"] for r in evaluation.histogram(df, F.col("x"), 4).collect()}
    assert bins == {k: int(c) for k, c in enumerate(np.histogram(x, 4)[0]) if c}
    assert {r.bin for r in evaluation.histogram(df.where("x = 1"), F.col("x"), 4).collect()} == {0}


def test_compare(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0])], "id int, v array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.0 + 1e-7]), (2, [1.0, 1.0]), (3, [0.1])], "id int, v array<double>")
    got = evaluation.compare_vectors(a, b, "id", "v").first()
    assert (got.rows, got.different) == (3, 2) and got.worst == pytest.approx(0.1)


@pytest.mark.parametrize("kind", ["logistic", "mlp", "bigrams"])
def test_classifiers_find_an_easy_class(spark, kind):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    if kind == "bigrams":
        rows = [(i, float(c), ["good" if c else "bad", *rng.choice(["a", "b", "c"], 4).tolist()]) for i, c in enumerate(y)]
        df = spark.createDataFrame(rows, "doc_id int, label double, words array<string>")
    else:
        rows = [(i, float(c), (rng.normal(size=4) + 3 * c).tolist()) for i, c in enumerate(y)]
        df = spark.createDataFrame(rows, "doc_id int, label double, v array<double>").withColumn("features", array_to_vector("v"))
    got = evaluation.evaluate(evaluation.classifier(kind, 4), kind, df.where("doc_id < 90"), df.where("doc_id >= 90"))
    assert got.auc > 0.95 and got.rows == 30 and got.rows_per_second > 0


def test_unknown_classifier():
    with pytest.raises(ValueError):
        evaluation.classifier("oracle", 1)


def test_auc_with_an_outlier_keeps_ranges_even(spark):
    """All scores but one lie in a millionth of their span."""
    rng = np.random.default_rng(4)
    s = np.append(rng.random(399) * 1e-6, 1.0)
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    assert evaluation.auc(df, F.col("y"), F.col("s"), ranges=16).first().auc == pytest.approx(brute_auc(y, s))
    cuts = df.agg(F.percentile_approx("s", [k / 16 for k in range(1, 16)], 160)).first()[0]
    assert max(np.histogram(s, [-1.0, *sorted(set(cuts)), 2.0])[0]) < 60


def test_sections_add_up():
    seconds = {}
    for _ in range(2):
        with evaluation.section(seconds, "a"):
            pass
    with pytest.raises(KeyError), evaluation.section(seconds, "b"):
        raise KeyError
    assert set(seconds) == {"a", "b"} and min(seconds.values()) >= 0
