"""FNV-1a of the 1- to ``longest``-grams of words as token numbers, 32 bits of a word's md5, in Arrow stages.

A word is hashed once a block, an n-gram in numpy. For distinct n-grams rows go to buckets by the low half of their
hash, compressed, so that all that share it meet and each bucket is counted by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .frequent import BLOCK, BUCKET, _packed, _unpacked, lean

_PAD = np.uint32(0xFFFFFFFF)


def _grams(column: pa.Array, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the row of every n-gram, and the padded n-grams."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    own = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in coded.dictionary.to_pylist()], np.uint32)
    flat = own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else own
    doc = np.repeat(np.arange(len(column)), sizes)
    for n in range(1, longest + 1):
        m = len(flat) - n + 1
        start = np.flatnonzero(doc[:m] == doc[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
        rows = np.full((len(start), longest), _PAD, np.uint32)
        for k in range(n):
            rows[:, k] = flat[start + k]
        yield doc[start], rows


def _slices(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, lo = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _sums(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 1, BLOCK // 4):
        total = np.zeros((3, batch.num_rows), np.int64)
        for doc, rows in _grams(batch.column(1), longest):
            h = hashing.fnv1a_rows(rows)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            for k, part in enumerate((np.ones(len(h), np.int64), h & 0xFFFFFFFF, h >> 32)):
                below = np.concatenate([[0], np.cumsum(part)])
                total[k] += below[ends[1:]] - below[ends[:-1]]
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *[pa.array(t[some]) for t in total]], names=["doc_id", "n_hashes", "low_sum", "high_sum"])


def hash_sums(docs: DataFrame, longest: int = 3) -> DataFrame:
    """``doc_id``, ``n_hashes``, and the sums of the hashes' low and high halves, for documents (``doc_id``,
    ``tokens``) that have a word. A row a document is all that is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "tokens").mapInArrow(lean(_sums, longest=longest), f"doc_id {kind}, n_hashes bigint, low_sum bigint, high_sum bigint")
    return rows.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_hashes", "low_sum", "high_sum")])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in the order of the low half of their hash, and that half."""
    h = hashing.fnv1a_rows(rows).view(np.uint64)
    key = (h << np.uint64(32)) | (h >> np.uint64(32))
    place = np.argsort(key)
    key, rows = key[place], rows[place]
    other, new = np.zeros(len(key), bool), np.ones(len(key), bool)
    for c in rows.T:
        other[1:] |= c[1:] != c[:-1]
    new[1:] = key[1:] != key[:-1]
    if (other & ~new).any():  # different rows of one whole hash: sorted by themselves too
        place = np.lexsort((*rows.T, key))
        key, rows = key[place], rows[place]
        other[:] = False
        for c in rows.T:
            other[1:] |= c[1:] != c[:-1]
    new[1:] |= other[1:]
    return rows[new], (key[new] >> np.uint64(32))


def _placed(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 0, BLOCK // 2):
        grams = np.concatenate([rows for _, rows in _grams(batch.column(0), longest)])
        if not len(grams):
            continue
        rows, low = _distinct(grams)
        bucket = (low * np.uint64(buckets)) >> np.uint64(32)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        data = [_packed(list(rows[a:b].T)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "rows", "data"])


def _clashes(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    def count(parts: list) -> pa.RecordBatch:
        _, low = _distinct(np.concatenate([_unpacked(d, n, longest).T for n, d in parts]))
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, low[1:] != low[:-1])), len(low)))
        return pa.RecordBatch.from_arrays([pa.array([int((sizes > 1).sum())]), pa.array([int((sizes - 1).sum())])], names=["hashes", "grams"])

    bucket, parts = 0, []
    for batch in batches:
        for b, n, d in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if parts and b != bucket:
                yield count(parts)
                parts = []
            bucket = b
            parts.append((n, d))
    if parts:
        yield count(parts)


def clashes(docs: DataFrame, size: int, longest: int = 3) -> DataFrame:
    """``clashing_hashes`` and ``clashing_ngrams`` of the distinct n-grams of ``tokens`` by the low half of their
    hash, as ``ngrams.collisions`` has them; ``size`` is about how many n-grams there are."""
    buckets = max(1, size // BUCKET)
    rows = docs.select("tokens").mapInArrow(lean(_placed, longest=longest, buckets=buckets), "bucket int, rows int, data binary")
    met = rows.repartition(max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket").sortWithinPartitions("bucket")
    found = met.mapInArrow(lean(_clashes, longest=longest), "hashes bigint, grams bigint")
    zero = F.lit(0).cast("bigint")
    return found.agg(F.coalesce(F.sum("hashes"), zero).alias("clashing_hashes"), F.coalesce(F.sum("grams"), zero).alias("clashing_ngrams"))
