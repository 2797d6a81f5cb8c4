"""Suffix-array dedup: passages of at least ``length`` tokens that occur more than once in the corpus.

A window is ``length`` consecutive tokens of one text; it is repeated if the same tokens start at another place, in
the same or another text. The result is the union of all repeated windows.

Windows are sharded without losing one: each has a minimizer, the smallest hashed q-gram in it, equal windows have
equal minimizers, and consecutive windows with one minimizer form a segment. Minimizers that occur once are
dropped by a count, so only segments that may repeat are shuffled. Each shard's segments are then sorted as
suffixes by bucket-pointer refinement and neighbours in that order that share ``length`` tokens are repeated.

A minimizer of a passage that a third of all texts have would put its segments into one shard. The windows of
minimizers with more than ``HOT`` segments are counted by their 64-bit hashes instead, which adds up before the
shuffle, so no shard grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import BROADCAST_ROWS, lean, lookup, materialized, plain, semi, table, written
from .jaccard import _by_key

LENGTH, Q = 50, 8
#: Segments of one minimizer up to which they are sorted in one shard (about 370 bytes each).
HOT = 1 << 13
_PLACE = np.uint64((1 << 28) - 1)


def segments(tokens: tb.Tokens, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, first window and last window (token indices) of every segment, in order."""
    m = len(tokens.hash) - length + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none.astype(np.uint64), none, none
    g = tokens.hash[: len(tokens.hash) - q + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, q):
            g *= tb._GRAM
            g += tokens.hash[k : k + len(g)]
    g = tb.mix(g)
    low = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)  # the leftmost of equal ones is the smallest
    width, wide = 1, length - q + 1
    while width * 2 <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:m], low[wide - width : wide - width + m])
    window = np.flatnonzero(tokens.doc[:m] == tokens.doc[length - 1 :])
    if not len(window):
        return none.astype(np.uint64), none, none
    place = (low[window] & _PLACE).astype(np.int64)
    cut = np.flatnonzero((window[1:] != window[:-1] + 1) | (place[1:] != place[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(window) - 1]])
    return g[place[first]], window[first], window[last]


def _minimizers(batches: Iterator[pa.RecordBatch], length: int, q: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch):
            tokens = tb.tokenize(part.column("text"))
            key, first, _ = segments(tokens, length, q)
            if len(key):
                yield pa.RecordBatch.from_arrays([tb.signed(key), part.column("doc_id").take(pa.array(tokens.doc[first]))], names=["key", "doc_id"])


def _kept(part: pa.RecordBatch, tokens: tb.Tokens, length: int, q: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window, last window and text of the segments whose key is among the text's in ``column``."""
    key, first, last = segments(tokens, length, q)
    key = key.view(np.int64)
    doc = tokens.doc[first]
    bounds = np.searchsorted(doc, np.arange(tokens.texts + 1))
    keep = np.zeros(len(key), bool)
    keys = part.column(column)
    for i in np.unique(doc).tolist():
        own = slice(bounds[i], bounds[i + 1])
        keep[own] = np.isin(key[own], keys[i].values.to_numpy())
    return key[keep], first[keep], last[keep], doc[keep]


def _segments(batches: Iterator[pa.RecordBatch], length: int, q: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch):
            tokens = tb.tokenize(part.column("text"))
            key, first, last, doc = _kept(part, tokens, length, q, "some")
            if not len(key):
                continue
            small = (tokens.hash >> np.uint64(32)).astype(np.uint32)
            starts = tokens.bounds[:-1][doc]
            for lo in range(0, len(key), 1 << 13):
                hi = min(len(key), lo + (1 << 13))
                sizes = last[lo:hi] - first[lo:hi] + length
                ends = np.concatenate([[0], np.cumsum(sizes)])
                where = np.arange(ends[-1]) + np.repeat(first[lo:hi] - ends[:-1], sizes)
                text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(small[where].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[lo:hi]), part.column("doc_id").take(pa.array(doc[lo:hi])), pa.array((first[lo:hi] - starts[lo:hi]).astype(np.int32)), text],
                    names=["key", "doc_id", "start", "tokens"],
                )


def _windows(batches: Iterator[pa.RecordBatch], length: int, q: int, shared=None) -> Iterator[pa.RecordBatch]:
    """Hash and place of every window of the hot minimizers: those of a broadcast array, or of the text's ``many``."""
    for batch in batches:
        for part in tb.slices(batch):
            tokens = tb.tokenize(part.column("text"))
            if shared is None:
                key, first, last, doc = _kept(part, tokens, length, q, "many")
            else:
                key, first, last = segments(tokens, length, q)
                on = np.isin(key.view(np.int64), shared.value)
                key, first, last = key[on], first[on], last[on]
                doc = tokens.doc[first]
            if not len(key):
                continue
            sizes = last - first + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)
            of = np.repeat(doc, sizes)
            with np.errstate(over="ignore"):
                h = tokens.hash[at]
                for k in range(1, length):
                    h = h * tb._GRAM + tokens.hash[at + k]
            for lo in range(0, len(at), 1 << 16):
                own = slice(lo, lo + (1 << 16))
                start = (at[own] - tokens.bounds[:-1][of[own]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([tb.signed(tb.mix(h[own])), part.column("doc_id").take(pa.array(of[own])), pa.array(start)], names=["window", "doc_id", "lo"])


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` (non-negative integers) sorted by at least the first ``depth`` values from each place on.

    Bucket-pointer refinement: an initial sort on q-grams gives each place a pointer to its bucket. Buckets of more
    than one place are then sorted on the pointers of the places ``q`` further on, which gives new pointers; these
    are used at once by the buckets handled after them, and each round may look twice as far ahead as the one
    before, as the pointers tell apart twice as long prefixes. Beyond the end of the text the smallest value follows.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    bits = max(1, int(text.max() + 1).bit_length())
    q = max(1, min(63 // bits, depth))
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(q, np.int64)])
    bits = max(1, int(padded.max()).bit_length())
    q = max(1, min(63 // bits, depth))
    gram = np.zeros(n, np.int64)
    for k in range(q):
        gram = (gram << bits) | padded[k : k + n]
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    ends = np.concatenate([np.flatnonzero(ordered[1:] != ordered[:-1]), [n - 1]])
    pointer = np.empty(n + 1, np.int64)
    pointer[n] = -1
    pointer[order] = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    reach = q
    slots = np.arange(n)
    while reach < depth:
        own = pointer[order[slots]]
        many = np.zeros(len(slots), bool)
        many[1:] = own[1:] == own[:-1]
        many[:-1] |= many[1:]
        slots, own = slots[many], own[many]
        if not len(slots):
            break
        half = int(np.searchsorted(own, own[len(own) // 2]))  # whole buckets: the second part reuses the first's pointers
        for some in (slots[:half], slots[half:]):
            if not len(some):
                continue
            place = order[some]
            ahead = pointer[np.minimum(place + reach, n)] + 1
            pair = (pointer[place] << 32) | ahead
            by = np.argsort(pair, kind="stable")
            place, pair = place[by], pair[by]
            order[some] = place
            last = np.concatenate([np.flatnonzero(pair[1:] != pair[:-1]), [len(pair) - 1]])
            pointer[place] = np.repeat(some[last], np.diff(np.concatenate([[-1], last])))
        reach *= 2
    return order


def repeated(tokens: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """For segments of ``tokens`` with these bounds: whether the window that starts at each place lies in its
    segment and occurs more than once."""
    ids = np.unique(tokens, return_inverse=True)[1]
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(tokens) + len(sizes), np.int64)  # a 0 ends each segment
    at = np.arange(len(tokens)) + of
    text[at] = ids + 1
    whole = np.zeros(len(text), bool)
    whole[at] = np.arange(len(tokens)) <= bounds[1:][of] - length
    order = suffix_order(text, length)
    order = order[whole[order]]
    a, b = order[:-1], order[1:]
    with np.errstate(over="ignore"):
        power, inverse = tb._powers(len(text) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)])])
        same = (total[a + length] - total[a]) * inverse[a] == (total[b + length] - total[b]) * inverse[b]
    flags = np.zeros(len(text), bool)
    flags[a[same]] = True
    flags[b[same]] = True
    return flags[at]


def _shards(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of whole keys with about ``most`` tokens each."""
    for batch in _by_key(batches, 1 << 10):
        key, column = batch.column("key").to_numpy(), batch.column("tokens")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1] // 4
        cuts = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        lo, base = 0, int(ends[0])
        while lo < len(key):
            k = min(int(np.searchsorted(ends[cuts - 1], base + most)), len(cuts) - 1)
            hi = int(cuts[max(k, int(np.searchsorted(cuts, lo, side="right")))])
            yield batch.slice(lo, hi - lo)
            lo, base = hi, int(ends[hi - 1])


def narrow(ids: pa.Array) -> pa.Array:
    """Identifiers of the type that the engine gave."""
    kind = {pa.large_binary(): pa.binary(), pa.large_string(): pa.string()}.get(ids.type)
    return ids.cast(kind) if kind else ids


def _mark(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in _shards(batches):
        column = batch.column("tokens")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
        tokens = np.frombuffer(column.buffers()[2], np.uint32)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        flags = repeated(tokens, bounds, length)
        at = np.flatnonzero(flags)
        if not len(at):
            continue
        row = np.searchsorted(bounds, at, side="right") - 1
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
        start = batch.column("start").to_numpy()[row[first]]
        lo = start + at[first] - bounds[row[first]]
        yield pa.RecordBatch.from_arrays(
            [narrow(batch.column("doc_id").take(pa.array(row[first]))), pa.array(lo.astype(np.int32)), pa.array((lo + at[last] - at[first] + length).astype(np.int32))],
            names=["doc_id", "lo", "hi"],
        )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """Spans of tokens that are covered by repeated windows of ``length`` tokens: ``doc_id``, ``start_token``,
    ``end_token`` (exclusive), overlapping and touching windows merged.

    Tokens are those of ``textbuf``. Null and empty texts and texts of fewer than ``length`` tokens have no spans.
    Rows without identifier are left out. Rows that repeat an identifier count as separate texts, and their spans
    are merged under it. Very long texts are searched whole, and a passage may repeat within one. An empty table gives
    no rows. Other columns are ignored.
    """
    if not 1 <= q <= length:
        raise ValueError("q must be between 1 and length")
    docs = plain(docs, id_col, text_col).where("doc_id IS NOT NULL")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, delete = written(docs.mapInArrow(lean(partial(_minimizers, length=length, q=q)), f"key bigint, doc_id {kind}"))
    often = materialized(found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    mine = lookup(found, often, "key").where("times IS NOT NULL")
    is_hot = F.col("times") > hot
    keys = materialized(mine.groupBy("doc_id").agg(F.collect_set(F.when(~is_hot, F.col("key"))).alias("some"), F.collect_set(F.when(is_hot, F.col("key"))).alias("many")))
    delete()
    texts = semi(docs, keys.select("doc_id"), "doc_id").join(keys.hint("shuffle_hash"), "doc_id")
    parts = texts.select("doc_id", "text", "some").where(F.size("some") > 0).mapInArrow(lean(partial(_segments, length=length, q=q)), f"key bigint, doc_id {kind}, start int, tokens binary")
    marked = parts.repartition("key").sortWithinPartitions("key").mapInArrow(lean(partial(_mark, length=length)), f"doc_id {kind}, lo int, hi int")
    shared = often.where(is_hot).count()
    if shared:
        schema = f"window bigint, doc_id {kind}, lo int"
        if shared <= BROADCAST_ROWS:  # few keys, wherever they occur: their texts needn't be shuffled
            known = docs.sparkSession.sparkContext.broadcast(often.where(is_hot).select("key").toPandas()["key"].to_numpy())
            owners = keys.where(F.size("many") > 0).select("doc_id")
            near = semi(docs, owners, "doc_id") if owners.count() <= BROADCAST_ROWS else docs
            windows, forget = written(near.mapInArrow(lean(partial(_windows, length=length, q=q, shared=known)), schema))
        else:
            windows, forget = written(texts.select("doc_id", "text", "many").where(F.size("many") > 0).mapInArrow(lean(partial(_windows, length=length, q=q)), schema))
        again = materialized(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        spans = materialized(lookup(windows, again, "window").where("n IS NOT NULL").select("doc_id", "lo", (F.col("lo") + length).alias("hi")))
        forget()
        marked = marked.unionByName(spans)
    by = Window.partitionBy("doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = marked.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("lo").alias("start_token"), F.max("hi").alias("end_token")).drop("island")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES = {
    "op7_suffix_dedup": r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM tokens WHERE len(w) >= 50)
), hits AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), islands AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)
)
SELECT doc_id, CAST(min(i) - 1 AS INTEGER) AS start_token, CAST(max(i) + 49 AS INTEGER) AS end_token
FROM islands GROUP BY doc_id, island
"""
}
