"""Bag of n-grams and TF-IDF in relational form, and sparse rows.

``ngram_rows`` makes sparse rows of counts or weights from tokens in one Arrow stage; the relational forms are for what
is in tables already.

The vocabulary is the small side of the join. Its largest size is a parameter of ``select_vocabulary``; callers that
know it pass ``vocabulary_rows``, and up to ``BROADCAST_ROWS`` the n-grams of the corpus stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embed import Lookup, count_known
from .frequent import Files, lean, numbered, numbers, written
from .network import Sparse
from .ngrams import ngram_array

#: Vocabulary entries up to which it is broadcast (about 60 bytes each); a larger one is left to the planner.
BROADCAST_ROWS = 500_000
#: Entries up to which numbers alone (16 to 24 bytes an entry, so at most 48 MB) are broadcast.
HASHED_ROWS = 2_000_000
Stage = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bag_of_ngrams(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", longest: int = 5, separator: str = " ", vocabulary_rows: int | None = None) -> DataFrame:
    """``doc_id``, ``idx``, ``tf`` for the recognised n-grams of each document; a document without one has no row."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(ngram_array(F.col(tokens_col), longest, separator)).alias("ngram"))
    small = vocabulary.select("idx", "ngram")
    if vocabulary_rows is not None and vocabulary_rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    elif vocabulary_rows is not None and vocabulary_rows <= HASHED_ROWS:  # 128 bits of hashes stand for the n-grams
        marks = [F.xxhash64("ngram").alias("h"), F.xxhash64(F.lit(1), "ngram").alias("c")]
        both = found.select("doc_id", *marks).join(F.broadcast(small.select("idx", *marks)), ["h", "c"])
        return both.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("tf"))
    return found.join(small, "ngram").groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias("tf"))


def bag_of_tokens(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``doc_id``, ``token``, ``tf`` for all tokens. Tokens are counted where the document is; only documents that
    share an identifier are shuffled."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    schema = f"doc_id {own.schema[0].dataType.simpleString()}, token {own.schema[1].dataType.elementType.simpleString()}, tf bigint"
    count = lambda df: df.mapInArrow(lean(_tokens_counted), schema)
    again, same = repeated(own), F.col("doc_id").eqNullSafe(F.col("same"))
    if again.isEmpty():
        return count(own)
    sums = count(own.join(again, same, "left_semi")).groupBy("doc_id", "token").agg(F.sum("tf").alias("tf"))
    return count(own.join(again, same, "left_anti")).unionByName(sums)


def repeated(docs: DataFrame) -> DataFrame:
    """``same``: identifiers that more than one row has, stored."""
    return written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("same")))[0]


def _tokens_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            hi = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED_UP, side="right")))
            coded = batch.column(1).slice(at, hi - at).flatten().dictionary_encode(null_encoding="encode")
            wide = max(1, len(coded.dictionary))
            key = np.repeat(np.arange(at, hi), sizes[at:hi]) * wide + coded.indices.to_numpy(zero_copy_only=False)
            key, tf = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(key // wide)), coded.dictionary.take(pa.array(key % wide)), pa.array(tf.astype(np.int64))], names=["doc_id", "token", "tf"])
            at = hi


def with_empty(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sparse rows for every document, those without an entry with empty arrays."""
    own = docs.select(F.col(id_col).alias("doc_id"))
    return own.join(rows, "doc_id", "left").select("doc_id", F.coalesce("indices", F.array().cast("array<int>")).alias("indices"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))


def tfidf(bag: DataFrame, vocabulary: DataFrame, normalize: bool = True, vocabulary_rows: int | None = None) -> DataFrame:
    """``doc_id``, ``idx``, ``weight``: tf times idf in double, each document divided by its length.

    The document's norm is taken over an array of its entries, so one shuffle by document serves both.
    """
    small = vocabulary.select("idx", "idf")
    if vocabulary_rows is not None and vocabulary_rows <= HASHED_ROWS:
        small = F.broadcast(small)
    weighted = bag.join(small, "idx").select("doc_id", "idx", (F.col("tf") * F.col("idf").cast("double")).alias("w"))
    if not normalize:
        return weighted.withColumnRenamed("w", "weight")
    rows = weighted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("entries"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["w"] * e["w"])))
    entry = F.explode("entries").alias("e")
    return rows.select("doc_id", "norm", entry).select("doc_id", F.col("e.idx").alias("idx"), (F.col("e.w") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("weight"))


def to_rows(entries: DataFrame, value_col: str = "weight", width: int | None = None) -> DataFrame:
    """Entries ``(doc_id, idx, value)`` as sparse rows: ``doc_id``, ``indices`` (rising), ``values``, and with
    ``width`` the constant ``indices_range``."""
    packed = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col(value_col).cast("double").alias("v")))).alias("e"))
    out = packed.select("doc_id", F.col("e.i").alias("indices"), F.col("e.v").alias("values"))
    return out.withColumn("indices_range", F.lit(width)) if width is not None else out


def from_rows(rows: DataFrame, value_col: str = "weight") -> DataFrame:
    """Sparse rows as entries. Rows whose arrays differ in length raise when they are read."""
    same = F.assert_true(F.size("indices") == F.size("values"), F.lit("indices and values differ in length"))
    checked = rows.select("doc_id", F.coalesce(same.cast("string"), F.lit("")).alias("ok"), F.explode(F.arrays_zip("indices", "values")).alias("e"))
    return checked.where("ok = ''").select("doc_id", F.col("e.indices").alias("idx"), F.col("e.values").alias(value_col))


def one_range(rows: DataFrame) -> int:
    """The width that all rows share; ``ValueError`` if they don't share one."""
    got = [r[0] for r in rows.select("indices_range").distinct().limit(2).collect()]
    if len(got) != 1:
        raise ValueError("rows don't share one width")
    return got[0]


def project(entries: DataFrame, weights: DataFrame, dims: int, value_col: str = "weight", weight_rows: int | None = None) -> DataFrame:
    """Sparse times dense in relational form: ``doc_id`` and ``v array<double>``, where ``weights`` has ``idx`` and
    ``w`` (array of ``dims``). Each document's partial sums are one row of ``dims`` aggregates."""
    small = weights.select("idx", F.col("w").alias("row"))
    if weight_rows is not None and weight_rows <= BROADCAST_ROWS // 4:
        small = F.broadcast(small)
    joined = entries.select("doc_id", "idx", F.col(value_col).alias("x")).join(small, "idx")
    sums = joined.groupBy("doc_id").agg(*[F.sum(F.col("x") * F.col("row")[k].cast("double")).alias(f"s{k}") for k in range(dims)])
    return sums.select("doc_id", F.array(*[F.col(f"s{k}") for k in range(dims)]).alias("v"))


def dense_layer(v: Column, rows: list[list[float]]) -> Column:
    """Product of a vector with a small matrix given by rows."""
    times = lambda row: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[times(row) for row in rows])


#: Tokens that ``ngram_rows`` looks up and ``bag_of_tokens`` counts at once.
LOOKED_UP = 1 << 18


def _entries(table: pa.Table) -> tuple[pa.Array | None, Lookup, np.ndarray, np.ndarray]:
    """Words of a vocabulary, its n-grams as padded numbers of them, and its inverse frequencies, in order of idx. Where
    n-grams are numbers already there are no words."""
    idx, column = table.column("idx").to_numpy(), table.column("tokens" if "tokens" in table.column_names else "ngram")
    turn, words = np.argsort(idx, kind="stable"), None
    if not pa.types.is_list(column.type):
        lists = pc.split_pattern(column.combine_chunks(), " ") if table.num_rows else pa.array([], pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        words, column = coded.dictionary, pa.chunked_array([pa.ListArray.from_arrays(lists.offsets, coded.indices)])
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    rows, at = np.full((len(turn), max(1, pc.max(pc.list_value_length(column)).as_py() or 1)), np.iinfo(np.uint32).max, np.uint32), 0
    for lists in column.chunks:  # a chunk at a time: workers open this at once, and what it takes counts for each
        sizes = np.diff(lists.offsets.to_numpy())
        for k in range(rows.shape[1]):
            some = np.flatnonzero(sizes > k)
            rows[place[at + some], k] = lists.flatten().to_numpy(zero_copy_only=False)[lists.offsets.to_numpy()[some] - lists.offsets[0].as_py() + k]
        at += len(sizes)
    return words, Lookup(rows), rows, table.column("idf").to_numpy()[turn].astype(np.float64)


def _weighed(x: Sparse, idf: np.ndarray) -> np.ndarray:
    v = x.values * idf[x.columns]
    row = np.repeat(np.arange(x.rows), np.diff(x.bounds))
    norm = np.sqrt(np.bincount(row, v * v, x.rows))
    norm[norm == 0] = 1
    return v / norm[row]


def _row_batch(ids: pa.Array, x: Sparse, values: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(x.bounds.astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.columns.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float64)))]
    return pa.RecordBatch.from_arrays([ids, *lists], names=["doc_id", "indices", "values"])


def _looked_up(batches: Iterator[pa.RecordBatch], vocabulary: Files, weighted: bool, then: Stage | None = None) -> Iterator[pa.RecordBatch]:
    found = _counted(batches, vocabulary, weighted)
    yield from found if then is None else then(found)


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: Files, weighted: bool) -> Iterator[pa.RecordBatch]:
    words, lookup, rows, idf = vocabulary.open(_entries)
    for batch in batches:
        column, at = batch.column(1), 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        while at < len(column):
            hi = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED_UP, side="right")))
            flat, bounds = numbers(column.slice(at, hi - at), words)
            x = count_known(lookup, flat, bounds, len(rows), rows)
            yield _row_batch(batch.column(0).slice(at, hi - at), x, _weighed(x, idf) if weighted else x.values)
            at = hi


def _weights(batches: Iterator[pa.RecordBatch], vocabulary: Files, then: Stage | None = None) -> Iterator[pa.RecordBatch]:
    def weighed() -> Iterator[pa.RecordBatch]:
        _, _, rows, idf = vocabulary.open(_entries)
        for batch in batches:
            at = batch.column(1).offsets.to_numpy().astype(np.int64)
            x = Sparse(at - at[0], batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy(), len(rows))
            yield _row_batch(batch.column(0), x, _weighed(x, idf))

    yield from weighed() if then is None else then(weighed())


def ngram_rows(docs: DataFrame, vocabulary: DataFrame, weighted: bool = False, known: Files | None = None, then: Stage | None = None, made: str = "") -> DataFrame:
    """Sparse rows ``doc_id``, ``indices`` (rising), ``values``: counts of each document's entries, or TF-IDF at unit
    length. ``docs`` has ``doc_id`` and ``tokens``, which with ``known`` are numbers of its words. A document without an entry has empty arrays; documents of one
    identifier are one row. Only such documents are shuffled.

    The vocabulary is read by each worker from files; what is looked up by hash is compared with the n-gram itself.
    ``then`` is a stage over these rows that runs in the worker that makes them, so they don't go to the engine and on
    to another worker; ``made`` are the columns it makes beside ``doc_id``."""
    small = vocabulary.select("idx", "idf", "ngram")
    if known is not None:  # workers that look up hold no words
        small = small.select("idx", "idf", F.split("ngram", " ").alias("tokens")).mapInArrow(lean(numbered, words=known), "idx int, idf float, tokens array<int>")
    _, folder = written(small)
    entries = Files(docs.sparkSession, folder)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, indices array<int>, values array<double>"
    out = f"doc_id {kind}, {made}" if then is not None else schema
    look = lambda df, w, then=None: df.select("doc_id", "tokens").mapInArrow(lean(_looked_up, vocabulary=entries, weighted=w, then=then), schema if then is None else out)
    again = repeated(docs)
    if again.isEmpty():
        return look(docs, weighted, then)
    same = F.col("doc_id").eqNullSafe(F.col("same"))
    entry = F.explode(F.arrays_zip("indices", "values")).alias("e")
    found = look(docs.join(again, same, "left_semi"), False)
    sums = found.select("doc_id", entry).groupBy("doc_id", F.col("e.indices").alias("idx")).agg(F.sum("e.values").alias("tf"))
    rows = found.select("doc_id").distinct().alias("d").join(to_rows(sums, "tf").alias("r"), F.expr("d.doc_id <=> r.doc_id"), "left").select("d.doc_id", F.coalesce("indices", F.array().cast("array<int>")).alias("indices"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))
    if weighted:
        rows = rows.mapInArrow(lean(_weights, vocabulary=entries, then=then), out)
    elif then is not None:
        rows = rows.mapInArrow(lean(then), out)
    return look(docs.join(again, same, "left_anti"), weighted, then).unionByName(rows)


def _projected(batches: Iterator[pa.RecordBatch], column: Callable[[np.ndarray, int], np.ndarray], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column(1).offsets.to_numpy().astype(np.int64)
        idx, x = batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()
        row, some = np.repeat(np.arange(len(batch)), np.diff(at)), np.flatnonzero(np.diff(at))
        sums = np.stack([np.bincount(row, x * column(idx, k), len(batch))[some] for k in range(dims)], axis=1)
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * dims).astype(np.int32)), pa.array(sums.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], names=["doc_id", "v"])


def project_rows(docs: DataFrame, vocabulary: DataFrame, column: Callable[[np.ndarray, int], np.ndarray], dims: int, known: Files | None = None) -> DataFrame:
    """TF-IDF rows times a matrix given by a function of indices and column: ``doc_id`` and ``v array<double>`` of the
    documents that have an entry. The arguments are otherwise those of ``ngram_rows``; a row is multiplied in the
    worker that makes it."""
    return ngram_rows(docs, vocabulary, True, known, partial(_projected, column=column, dims=dims), "v array<double>")
