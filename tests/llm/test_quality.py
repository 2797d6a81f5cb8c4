import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.llm import quality

SF = "/root/testdata/sf0.1"


def tokens(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", text or "")


def test_features_follow_tokens():
    texts = ["a b a", None, "", "Hi!! there %%%x", "é é é", "  \n", "the the cat"]
    ids, bounds = quality.features(pa.array(texts))
    assert np.diff(bounds).tolist() == [2 * len(tokens(t)) - 1 if tokens(t) else 0 for t in texts]
    known = {}
    for i, t in enumerate(texts):
        w = tokens(t)
        want = [(x,) for x in w] + [("same",) * 2 if a == b else (a, b) for a, b in zip(w, w[1:])]
        for key, got in zip(want, ids[bounds[i] : bounds[i + 1]].tolist()):
            assert known.setdefault(key, got) == got
    assert len(set(known.values())) == len(known)


def test_score_is_a_sparse_dot_product(spark):
    model = quality.train(["good day sir", "bad $$$ $$$"] * 12, [1, 0] * 12)
    text = "good $$$ sir bad"
    ids, _ = quality.features(pa.array([text]))
    z = model.bias + np.mean([float(model.weights[i]) for i in ids])
    got = quality.classify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert abs(got.score - 1 / (1 + np.exp(-z))) < 1e-5


def test_auc():
    assert quality.auc(np.array([0.1, 0.4, 0.4, 0.9]), np.array([0, 0, 1, 1])) == 0.875


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    small = labels.where("doc_id % 2 = 0")
    model = quality.fit_quality_model(docs, small, rows=1200)
    got = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "y"), "doc_id").select("score", "quality", "y").toPandas()
    assert quality.auc(got.score.to_numpy(), got.y.to_numpy()) > 0.97
    assert got.quality[got.y == 1].mean() > 0.97 and got.quality[got.y == 0].mean() < 0.15


def test_edge_rows(spark):
    model = quality.train(["good day sir", "bad $$$ $$$"] * 12, [1, 0] * 12)
    rows = [(1, None), (2, ""), (None, "good day"), (3, "good"), (3, "good"), (4, "good day sir " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS score", "9 AS quality")
    got = quality.classify(df, model).collect()
    assert len(got) == 6 and [r.score for r in got if r.doc_id in (1, 2)] == [0.0, 0.0]
    assert next(r for r in got if r.doc_id == 4).quality == 1
    assert quality.classify(df.limit(0), model).collect() == []
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.fit_quality_model(df, labels).auc == 0.5
    assert quality.fit_quality_model(df, labels.limit(0)).cutoff == 0.5


def test_labels_without_a_document_take_no_places(spark):
    rng = random.Random(1)
    good, bad = "a fine day for all", "$$$ buy !!! $$$"
    docs = spark.createDataFrame([(i * 5000, f"{(good, bad)[i % 2]} {rng.random()}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(200_000).selectExpr("id AS doc_id", "CAST((id div 5000) % 2 = 0 AS INT) AS quality")
    model = quality.fit_quality_model(docs, labels, rows=30)
    assert model.auc == 1.0 and np.count_nonzero(model.weights) > 3


def plain_ftrl(rows, labels, held, epochs, alpha, beta, l1, l2, seed):
    """FTRL-proximal one feature at a time, on dictionaries. ``rows`` are lists of buckets."""
    z, n = defaultdict(float), defaultdict(float)
    bias = "bias"

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    shares = [{**{b: c / len(r) for b, c in Counter(r).items()}, bias: 1.0} for r in rows]
    rng = np.random.default_rng(seed)
    fit = np.array([i for i in range(len(rows)) if not held[i]])
    for _ in range(epochs):
        for i in rng.permutation(fit):
            x = shares[i]
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in list(z)}, bias


def test_query_against_plain_training(spark):
    """The whole query: sample, features, training, cutoff and scores of every document."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    both = docs.join(labels, "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    bucket = lambda text: quality.features(pa.array([text]))[0].tolist()
    rows, y = [bucket(r.text) for r in both], [r.quality for r in both]
    held = [i % 5 == 4 and len(rows) >= 20 for i in range(len(rows))]
    w, bias = plain_ftrl(rows, y, held, quality.EPOCHS, quality.ALPHA, quality.BETA, quality.L1, quality.L2, 11)
    score = lambda own: 1 / (1 + math.exp(-w[bias] - sum(w.get(b, 0.0) for b in own) / len(own)))
    rest = [(score(rows[i]), y[i]) for i in range(len(rows)) if held[i]]
    marks = sorted({p for p, _ in rest})
    good, bad = sum(v for _, v in rest), sum(1 - v for _, v in rest)
    tries = [(a + b) / 2 for a, b in zip(marks, marks[1:])]
    cutoff = max(tries, key=lambda t: (sum(v for p, v in rest if p >= t) / good + sum(1 - v for p, v in rest if p < t) / bad, -t)) if tries and good and bad else 0.5
    got = {r.doc_id: r for r in quality.op4_quality_classifier(spark, sf).collect()}
    for r in docs.collect():
        own = bucket(r.text)
        want = score(own) if own else 0.0
        assert abs(got[r.doc_id].score - want) < 1e-5
        if abs(want - cutoff) > 1e-5:
            assert got[r.doc_id].quality == int(bool(own) and want >= cutoff)
    assert len(got) == docs.count()
