from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import langid

SF = "/root/testdata/sf0.01"


def brute_features(text, buckets, sizes):
    raw = [32] + [c if langid._LETTER[c] else 32 for c in (text or "").lower().encode()] + [32]
    out = []
    for size in sizes:
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            if 32 in w[1:-1] or (size == 2 and w == [32, 32]):
                continue
            h = size
            for c in w:
                h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(((h * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - (buckets.bit_length() - 1)))
    return sorted(out)


def test_features_against_brute_force():
    texts = ["The cat, sat!", None, "", "É ü", "a", "12 34", "x" * 50, " Zoë\nist"]
    ids, bounds = langid.features(pa.array(texts), 1 << 12, (2, 3, 4))
    for i, t in enumerate(texts):
        got = sorted(ids[bounds[i] : bounds[i + 1]].tolist())
        assert got == [] if not any(c.isalpha() for c in t or "") else got == brute_features(t, 1 << 12, (2, 3, 4))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_language_model(spark.read.parquet(f"{SF}/documents.parquet"), rows=600)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000")
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    n, right, taken = got.agg(F.count("*"), F.sum((F.col("language") == F.col("lang")).cast("int")), F.sum(F.col("accepted").cast("int"))).first()
    assert right / n > 0.99 and taken / n > 0.99


def test_unknown_text_is_rejected(spark, model):
    df = spark.createDataFrame([(1, "zzqx kkwv jjxq vvkz " * 20), (2, "12345 !!! 678")], "doc_id long, text string")
    assert [r.language for r in langid.identify(df, model).collect()] == ["und", "und"]


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "the and of"), (3, "the"), (3, "the"), (4, "the thing of and " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS language", "true AS accepted")
    got = langid.identify(df, model).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].language == by[2].language == "und" and by[1].confidence == 0.0 and not by[2].accepted
    assert by[4].language == "en" and len({(r.language, r.confidence) for r in got if r.doc_id == 3}) == 1
    assert langid.identify(df.limit(0), model).collect() == []


def test_degenerate_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string")
    assert langid.identify(one, langid.fit_language_model(empty)).first().language == "und"
    assert langid.identify(one, langid.fit_language_model(one)).first().language == "en"


def _features(text):
    return langid.features(pa.array([text]))[0].tolist()


def test_query_against_plain_training(spark):
    """The whole query: sample, minibatch SGD text by text, temperature, cutoff and the language of every document."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sample = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(langid.TRAIN_ROWS).collect()
    names = sorted({r.lang for r in sample})
    k, dim = len(names), langid.DIM
    counted = lambda text: tuple(map(np.array, zip(*sorted(Counter(_features(text)).items())))) or (np.zeros(0, int), np.zeros(0))
    rows, y = [counted(r.text) for r in sample], [names.index(r.lang) for r in sample]
    held = [i % 5 == 4 for i in range(len(rows))]
    rng = np.random.default_rng(7)
    fit = np.array([i for i in range(len(rows)) if not held[i] and len(rows[i][0])])
    emb = rng.uniform(-1 / dim, 1 / dim, (langid.BUCKETS, dim)).astype(np.float32).astype(np.float64)
    out, bias = np.zeros((dim, k)), np.zeros(k)
    each = -(-len(fit) // langid.BATCH)
    epochs = max(langid.EPOCHS, -(-langid.STEPS // each))
    step = 0

    def probabilities(z):
        e = np.exp(z - z.max())
        return e / e.sum()

    def vector(row):
        return row[1] / row[1].sum() @ emb[row[0]]

    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), langid.BATCH):
            own = order[lo : lo + langid.BATCH]
            lr = langid.RATE * (1 - step / (epochs * each))
            step += 1
            errors = []
            for i in own:
                v = vector(rows[i])
                errors.append((i, v, probabilities(v @ out + bias) - np.eye(k)[y[i]]))
            pulls = [(i, out @ d) for i, _, d in errors]
            for _, v, d in errors:
                out -= lr * np.outer(v, d) / len(own)
                bias -= lr * d / len(own)
            for i, g in pulls:
                emb[rows[i][0]] -= lr * 16 * np.outer(rows[i][1] / rows[i][1].sum(), g)
    logits = lambda row: vector(row) @ out + bias if len(row[0]) else bias
    rest = [(logits(rows[i]), y[i]) for i in range(len(rows)) if held[i]]
    miss = 1 / (len(rest) + 2)

    def loss(t):
        total = 0.0
        for z, label in rest:
            target = np.full(k, miss / (k - 1))
            target[label] = 1 - miss
            total -= (target * np.log(probabilities(z / t) + 1e-300)).sum()
        return total / len(rest)

    temperature = min(np.geomspace(0.02, 20, 80), key=loss)
    got = {r.doc_id: r for r in langid.op1_language_id(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        p = probabilities(logits(counted(r.text)) / temperature)
        assert abs(got[r.doc_id].confidence - p.max()) < 2e-3
        assert got[r.doc_id].language in (names[int(p.argmax())], langid.REJECTED)
        assert got[r.doc_id].accepted == (got[r.doc_id].language != langid.REJECTED)
    assert sum(r.accepted for r in got.values()) > 0.95 * len(got)
