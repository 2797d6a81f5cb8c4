"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits and runs of punctuation, case kept; features are their unigrams and bigrams,
hashed into buckets, a bigram of one token twice into a bucket of its own. A text's features are weighted by their
share of all its features, so its score is a sparse dot product: the mean of its features' weights.

FTRL-proximal keeps two numbers per bucket and gives sparse weights by its L1 term. It is trained in numpy on a
bounded sample of labelled rows; on a held-out part the cutoff is chosen that best separates the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import BROADCAST_ROWS, bounded_sample, lean, plain, table

BUCKETS = 1 << 18
#: Labelled rows that the model is trained on at most.
TRAIN_ROWS = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 0.0005, 0.001

_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_lo:_hi] = 1


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of all texts, flat and with bounds."""
    raw, offsets = tb.buffers(tb.filled(column))
    kind = _KIND[raw]
    n = len(kind)
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets[:-1]] = True
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    on = kind[start] > 0
    start, end = start[on], end[on]
    h = tb.span_hashes(raw, start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    one = (h >> shift).astype(np.int32)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = h[:-1][pair], h[1:][pair]
    with np.errstate(over="ignore"):
        two = tb.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    two[a == b] = np.uint64(1) << np.uint64(63)
    two = (two >> shift).astype(np.int32)
    ids, who = np.concatenate([one, two]), np.concatenate([doc, doc[:-1][pair]])
    by = np.argsort(who, kind="stable")
    return ids[by], np.searchsorted(who[by], np.arange(len(offsets)))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    cutoff: float
    auc: float


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve with ties at half."""
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = np.cumsum(counts) - (counts - 1) / 2
    good, bad = int(label.sum()), int((1 - label).sum())
    return float((rank[inverse][label == 1].sum() - good * (good + 1) / 2) / (good * bad)) if good and bad else 0.5


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 11) -> QualityModel:
    """Fit on four fifths of the rows, choose the cutoff on the rest. No rows give a model that scores all 0.5."""
    rows = []
    for part in tb.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]), most=1 << 18):
        ids, bounds = features(part.column("text"), buckets)
        for i in range(part.num_rows):
            u, c = np.unique(ids[bounds[i] : bounds[i + 1]], return_counts=True)
            rows.append((np.append(u, buckets), np.append(c / max(1, c.sum()), 1.0)))
    y = np.array(labels, np.float64)
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(texts), bool)
    z, n, w = np.zeros(buckets + 1), np.zeros(buckets + 1), np.zeros(buckets + 1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            u, x = rows[i]
            zu, nu = z[u], n[u]
            own = np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(nu)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(own @ x, -35, 35)))
            g = (p - y[i]) * x
            z[u] += g - (np.sqrt(nu + g * g) - np.sqrt(nu)) / alpha * own
            n[u] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rest = np.flatnonzero(held if held.any() else ~held)
    p = np.array([1 / (1 + np.exp(-np.clip(w[rows[i][0]] @ rows[i][1], -35, 35))) for i in rest])
    good, cutoff = y[rest], 0.5
    if len(set(good.tolist())) == 2:
        marks = np.unique(p)
        tries = (marks[1:] + marks[:-1]) / 2
        gain = [((p >= t) & (good == 1)).sum() / good.sum() + ((p < t) & (good == 0)).sum() / (1 - good).sum() for t in tries]
        if len(tries):
            cutoff = float(tries[int(np.argmax(gain))])
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), cutoff, auc(p, good) if len(rest) else 0.5)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: QualityModel = shared.value
    for batch in batches:
        for part in tb.slices(batch):
            ids, bounds = features(part.column("text"), len(model.weights))
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            z = np.full(len(n), model.bias)
            if len(some):
                z[some] += np.add.reduceat(model.weights[ids].astype(np.float64), bounds[:-1][some]) / n[some]
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            p[n == 0] = 0.0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.round(p, 6)), pa.array(((p >= model.cutoff) & (n > 0)).astype(np.int32))], names=["doc_id", "score", "quality"]
            )


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS, **kw) -> QualityModel:
    """Train on up to ``rows`` labelled documents with a text, those with the smallest hashes of the identifier.
    Labels are cut by hash before the join with the documents and more of them taken until there are enough documents,
    so labels without a document take no places. A document whose labels contradict each other is left out."""
    own = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    texts = plain(docs, id_col, text_col).where("text IS NOT NULL")
    got = bounded_sample(own, rows, lambda df, expected: texts.join(F.broadcast(df) if expected <= BROADCAST_ROWS else df, "doc_id"))
    return train([r.text for r in got], [int(r.label) for r in got], **kw)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (probability of good quality, 6 decimals) and ``quality`` (1 from the cutoff on, else 0),
    one row for each row that goes in.

    Whole texts are scored, very long ones too. Null and empty texts and those without a token score 0. Equal rows get equal results. An
    empty table gives no rows. Other columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lean(partial(_score, shared=shared)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, quality int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_quality_model(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
