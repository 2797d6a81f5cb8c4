"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

The features of a text are the byte n-grams of its words (lower-cased, with a boundary at either end), hashed into
buckets. The text's vector is the average of its buckets' embeddings, and a linear softmax gives the languages'
probabilities. Embeddings and softmax are trained together by minibatch stochastic gradient descent in numpy on a
bounded sample of labelled rows. On a held-out part of the sample a temperature is fitted, and the confidence below
which a text is rejected (``und``) is the lowest at which the accepted texts reach the precision asked for.

Scoring whole tables uses that averaging and softmax are linear up to the end: the product of embeddings and softmax
weights is one small table of logits per bucket, and a text's logits are the mean of its buckets' rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb
from .common import bounded_sample, lean, plain, table

BUCKETS, DIM, SIZES = 1 << 16, 16, (2, 3, 4)
#: Labelled rows that the model is trained and calibrated on at most.
TRAIN_ROWS = 3000
EPOCHS, BATCH, RATE, PRECISION = 12, 16, 0.5, 0.995
#: Steps at least; small samples get more epochs.
STEPS = 2000
REJECTED = "und"

_LETTER = np.zeros(256, bool)
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_lo:_hi] = True


def features(column: pa.Array, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, flat and with bounds. Bytes that aren't of letters are boundaries; an
    n-gram may begin or end with one and has none inside."""
    raw, offsets = tb.buffers(pc.utf8_lower(tb.filled(column)))
    n = len(raw)
    # every text gets a boundary before and after it
    at = np.arange(n) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    chars = np.full(n + len(offsets), 32, np.uint32)
    letter = _LETTER[raw]
    chars[at] = np.where(letter, raw, 32)
    gap = np.ones(len(chars), bool)
    gap[at] = ~letter
    flat, owner = [], []
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 1)
    with np.errstate(over="ignore"):
        for size in sizes:
            m = len(chars) - size + 1
            if m <= 0:
                continue
            ok = ~(gap[:m] & gap[1 : m + 1]) if size == 2 else np.ones(m, bool)
            for k in range(1, size - 1):
                ok &= ~gap[k : k + m]
            start = np.flatnonzero(ok)
            h = np.full(len(start), size, np.uint32)
            for k in range(size):
                h = (h ^ chars[start + k]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            flat.append((h >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32))
            owner.append(doc[np.minimum(start, len(doc) - 1)])
    if not flat:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    ids, who = np.concatenate(flat), np.concatenate(owner)
    by = np.argsort(who, kind="stable")
    return ids[by], np.searchsorted(who[by], np.arange(len(offsets)))


@dataclass
class LangModel:
    languages: list[str]
    table: np.ndarray  # logits per bucket and language
    bias: np.ndarray
    temperature: float
    cutoff: float
    buckets: int
    sizes: tuple[int, ...]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(
    texts: list[str],
    labels: list[str],
    buckets: int = BUCKETS,
    dim: int = DIM,
    sizes: tuple[int, ...] = SIZES,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    rate: float = RATE,
    precision: float = PRECISION,
    seed: int = 7,
) -> LangModel:
    """Fit embeddings and softmax by SGD with a linearly falling rate on four fifths of the rows; fit temperature
    and cutoff on the rest. One language alone is always predicted; no rows give a model that rejects all."""
    languages = sorted(set(labels))
    k = len(languages)
    if not k:
        return LangModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, np.inf, buckets, sizes)
    rng = np.random.default_rng(seed)
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    for part in tb.slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]), most=1 << 18):
        ids, bounds = features(part.column("text"), buckets, sizes)
        for i in range(part.num_rows):
            u, c = np.unique(ids[bounds[i] : bounds[i + 1]], return_counts=True)
            counts.append((u, (c / max(1, c.sum())).astype(np.float32)))
    y = np.array([languages.index(x) for x in labels])
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(texts), bool)
    fit = np.flatnonzero(~held & np.array([len(u) > 0 for u, _ in counts]))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    each = max(1, -(-len(fit) // batch))
    epochs = max(epochs, -(-STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        shuffled = rng.permutation(fit)
        for lo in range(0, len(fit), batch):
            some = shuffled[lo : lo + batch]
            lr = rate * (1 - step / steps)
            step += 1
            v = np.stack([w @ emb[u] for u, w in (counts[i] for i in some)])
            d = _softmax(v @ out + bias)
            d[np.arange(len(some)), y[some]] -= 1
            back = d @ out.T
            out -= lr * (v.T @ d) / len(some)
            bias -= lr * d.mean(0)
            for i, g in zip(some, back, strict=True):
                u, w = counts[i]
                emb[u] -= lr * 16 * w[:, None] * g  # a text's gradient is spread over its many buckets
    logits = emb @ out
    model = LangModel(languages, logits, bias, 1.0, 0.0, buckets, sizes)
    rest = np.flatnonzero(held if held.any() else ~held)
    z = np.stack([w @ logits[u] + bias if len(u) else bias for u, w in (counts[i] for i in rest)]).astype(np.float64)
    grid = np.geomspace(0.02, 20, 80)
    # Laplace's rule: even if all held-out texts are right, one more may be wrong, so confidence stays below 1
    miss = 1 / (len(rest) + 2)
    target = np.full((len(rest), k), miss / max(1, k - 1))
    target[np.arange(len(rest)), y[rest]] = 1 - miss if k > 1 else 1
    loss = [-(target * np.log(_softmax(z / t) + 1e-300)).sum(1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    sure, right = p.max(1), p.argmax(1) == y[rest]
    order = np.argsort(-sure, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(rest) + 1))
    model.cutoff = float(sure[order][good[-1]]) if len(good) else 1.0
    if len(good) == len(rest):  # all held-out texts may be accepted: reject what is clearly less sure than any of them
        model.cutoff = float(min(model.cutoff, 0.5 if k > 1 else 0.0))
    return model


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: LangModel = shared.value
    columns = [np.ascontiguousarray(model.table[:, k], np.float32) for k in range(len(model.languages))]
    names = np.array([*model.languages, REJECTED], object)
    for batch in batches:
        for part in tb.slices(batch):
            ids, bounds = features(part.column("text"), model.buckets, model.sizes)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            z = np.tile(model.bias.astype(np.float64), (len(n), 1))
            for k, own in enumerate(columns):
                if len(some):
                    z[some, k] += np.add.reduceat(own[ids].astype(np.float64), bounds[:-1][some]) / n[some]
            best, sure = np.full(len(n), len(model.languages)), np.zeros(len(n))
            if len(columns):
                p = _softmax(z / model.temperature)
                best, sure = p.argmax(1), p.max(1)
                sure[n == 0] = 0.0
            accepted = (sure >= model.cutoff) & (n > 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[np.where(accepted, best, len(model.languages))], pa.string()), pa.array(np.round(sure, 6)), pa.array(accepted)],
                names=["doc_id", "language", "confidence", "accepted"],
            )


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS, **kw) -> LangModel:
    """Train on at most ``rows`` labelled rows with a text, chosen by a hash of the identifier."""
    labelled = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[label_col].alias("label"))
    got = bounded_sample(labelled, rows, lambda df, _: df.where("doc_id IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL"))
    return train([r.text for r in got], [r.label for r in got], **kw)


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``language`` (``und`` if rejected), ``confidence`` (calibrated probability, 6 decimals) and
    ``accepted``, one row for each row that goes in.

    Whole texts are scored, very long ones too. Null texts, empty ones and those without a letter are rejected with confidence 0. Ties go
    to the language that is first in the alphabet. Equal rows get equal results. An empty table gives no rows. Other
    columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lean(partial(_score, shared=shared)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string, confidence double, accepted boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language_model(docs))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
