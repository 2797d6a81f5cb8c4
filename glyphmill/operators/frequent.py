"""The most frequent n-grams of a corpus, exact, with a shuffle of about the size of the corpus.

Every place of a text is one window of up to ``longest`` numbers, so all n-grams that start there travel as one row
instead of one row a length. Windows go to buckets by their first two numbers, sorted and compressed by column in
blocks of ``BLOCK`` places. A bucket has every window of an n-gram of two or more, so in sorted order the count of an
n-gram is the length of its run. Nothing depends on how large the corpus or its vocabulary is but the number of buckets.

Words have numbers by their rank in the corpus. Words that are too rare to be part of a kept n-gram end a window: an
n-gram is no more frequent than its words. For the same reason pairs of words are counted first, then n-grams of three
of which no pair is too rare, then longer ones of which no three are: only what is left of the windows is shuffled.
"""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import places

#: Places that are sorted at once, and windows of a bucket on average.
BLOCK, BUCKET = 1 << 20, 1 << 20
#: Places from which windows of a stored table are shuffled in rounds, and rounds at most, two of them for pairs and, if
#: windows are cut, two for threes and one for the rest: a round's shuffle is deleted before the next, so disk never has all of them.
ROUND, ROUNDS = 1 << 24, 6
#: Bits that stand for the n-grams of a length that are frequent enough, by hash, as a power of two, and parts they are
#: made in. N-grams that share a bit only leave windows longer than they need be.
GRAM_BITS, GRAM_PARTS = 26, 16
#: The number of a word that isn't in the dictionary; numbers in windows are one higher, 0 ends a window.
UNKNOWN = np.uint32(0xFFFFFFFE)


class Files:
    """Parquet files of a folder as each executor has them, in order, as one table kept by the worker."""

    def __init__(self, spark: SparkSession, folder: str):
        Path = spark._jvm.org.apache.hadoop.fs.Path
        at = Path(folder)
        names = sorted(s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
        self.names, self.key = [n for n in names if n.endswith(".parquet")], os.urandom(8).hex()
        for n in self.names:
            spark.sparkContext.addFile(f"{folder}/{n}")

    def open(self, make=lambda table: table):
        if self.key not in _open:
            _open.clear()
            _open[self.key] = make(self.table())
            trim()  # what making it took
        return _open[self.key]

    def table(self) -> pa.Table:
        return pa.concat_tables([pq.read_table(SparkFiles.get(n)) for n in self.names])


_open: dict = {}


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; afterwards what the worker kept and freed goes back to the system, as idle workers stay."""
    yield from batches
    _open.clear()
    trim()


def trim() -> None:
    """What this process freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(f, **fixed):
    """``f`` for ``mapInArrow`` with arguments, its memory given back at the end of a partition."""
    return partial(_lean, f=f, fixed=fixed)


def _lean(batches: Iterator[pa.RecordBatch], f, fixed: dict) -> Iterator[pa.RecordBatch]:
    return given_back(f(batches, **fixed))


#: The engine's own switch for deleting the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder; what was shuffled for it is deleted."""
    folder, conf = places.workfolder(df.sparkSession), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.parquet(folder), folder


def dropped(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def histogram(counts: DataFrame) -> list[tuple[int, int]]:
    """(count, n-grams that have it), from the largest: as many rows as there are different counts."""
    return sorted(((r[0], r[1]) for r in counts.groupBy("count").agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)


def least_kept(bars: list[tuple[int, int]], most: int) -> int:
    """The count of the entry in place ``most``, 1 if there are fewer."""
    seen = 0
    for count, rows in bars:
        seen += rows
        if seen >= most:
            return count
    return 1


@dataclass
class Dictionary:
    """Words in the order of their numbers. ``complete``: none was left out."""

    words: Files
    size: int
    places: int
    counts: DataFrame
    complete: bool


def dictionary(docs: DataFrame, tokens_col: str, most: int, min_multiple: float) -> Dictionary:
    """The words that kept n-grams can have. Where an n-gram that occurs once is known, the smallest count is 1 and
    words below ``min_multiple`` go; words below the count of the ``most``-th word go anyway."""
    counts, every = written(docs.select(F.explode_outer(tokens_col).alias("ngram")).where("ngram IS NOT NULL").groupBy("ngram").agg(F.count(F.lit(1)).alias("count")))
    bars = histogram(counts)
    least = least_kept(bars, most)
    if min_multiple > 1:
        least = max(least, math.ceil(min_multiple)) if bars and bars[-1][0] == 1 else 1
    kept, folder = written(counts.where(F.col("count") >= least).orderBy(F.col("count").desc(), "ngram"))
    dropped(docs.sparkSession, every)
    size = sum(n for c, n in bars if c >= least)
    return Dictionary(Files(docs.sparkSession, folder), size, sum(c * n for c, n in bars), kept, not bars or bars[-1][0] >= least)


def numbers(column: pa.Array, words: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """Flat numbers of an array column, ``UNKNOWN`` for other words, and the bounds of its rows."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    if words is None:
        own = flat.to_numpy(zero_copy_only=False).astype(np.uint32)
    else:
        coded = flat.dictionary_encode()
        own = pc.fill_null(pc.index_in(coded.dictionary, value_set=words).cast(pa.int64()), int(UNKNOWN)).to_numpy(zero_copy_only=False).astype(np.uint32)
        own = own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint32)
    return own, np.concatenate([[0], np.cumsum(sizes)])


def _words(table: pa.Table) -> pa.Array:
    return table.column("ngram").combine_chunks()


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their last column has ``most`` words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.list_value_length(batch.column(batch.num_columns - 1))).as_py() or 0
        if size >= most:
            yield from held if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def numbered(batches: Iterator[pa.RecordBatch], words: Files) -> Iterator[pa.RecordBatch]:
    """The last column's words as numbers, ``UNKNOWN`` as -2. Each lookup puts all known words in a table of hashes, so
    small batches are looked up together."""
    known = words.open(_words)
    for batch in gathered(batches, BLOCK):
        column, at = batch.column(batch.num_columns - 1), 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        while at < len(column):
            hi = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
            own, bounds = numbers(column.slice(at, hi - at), known)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*[c.slice(at, hi - at) for c in batch.columns[:-1]], lists], names=batch.schema.names)
            at = hi


def ordered(run: np.ndarray, columns: list[np.ndarray], bits: int) -> np.ndarray:
    """Places of the rows in the order of ``run`` and then of the columns, which have ``bits`` bits; as many columns at
    a time as 64 bits take."""
    place, number, k = np.arange(len(run)), run.astype(np.uint64), 0
    while k < len(columns) and len(run):
        m = min(len(columns) - k, max(1, (64 - max(1, int(number.max()).bit_length())) // bits))
        key = number
        for c in columns[k : k + m]:
            key = (key << np.uint64(bits)) | c[place].astype(np.uint64)
        turn = np.argsort(key)
        key, place = key[turn], place[turn]
        number = np.zeros(len(key), np.uint64)
        np.cumsum(key[1:] != key[:-1], out=number[1:])
        k += m
    return place


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams of two and more numbers as they are in windows."""
    h = _mixed((columns[0].astype(np.uint64) << np.uint64(32)) | columns[1])
    for c in columns[2:]:
        h = _mixed(h + c * np.uint64(0x9E3779B97F4A7C15))
    return h


def _set(found: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    bits[found] = True
    return np.packbits(bits, bitorder="little")


def _gram_places(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Bits of packed keys of ``n`` numbers, by part."""
    within = np.uint64(GRAM_BITS - GRAM_PARTS.bit_length() + 1)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(-1, n).astype(np.uint64) + np.uint64(1)
        bit = np.unique(_hashed(list(flat.T)) >> np.uint64(64 - GRAM_BITS))
        part, edges = np.unique(bit >> within, return_index=True)
        own = (bit & ((np.uint64(1) << within) - np.uint64(1))).astype(np.uint32)
        data = [x.tobytes() for x in np.split(own, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(data[: len(part)], pa.binary())], names=["part", "data"])


def _gram_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, found = (1 << GRAM_BITS) // GRAM_PARTS, {}
    for batch in batches:
        for part, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            bits = _set(np.frombuffer(data, np.uint32), size)
            found[part] = found[part] | bits if part in found else bits
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], names=["part", "data"])


def gram_bits(grams: DataFrame, n: int) -> bytes:
    """2**``GRAM_BITS`` bits, those of the packed ``key`` of ``n`` words set; what the driver gets is as large for any
    number of n-grams."""
    parts = grams.select("key").mapInArrow(partial(_gram_places, n=n), "part int, data binary").repartition(GRAM_PARTS, "part").mapInArrow(_gram_parts, "part int, data binary")
    found = {r.part: bytes(r.data) for r in parts.collect()}
    none = bytes((1 << GRAM_BITS) // GRAM_PARTS // 8)
    return b"".join(found.get(k, none) for k in range(GRAM_PARTS))


def _packed(columns: list[np.ndarray]) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(c, np.uint32).tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=rows * columns * 4, codec="zstd", asbytes=True), np.uint32).reshape(columns, rows)


def _blocks(batches: Iterator[pa.RecordBatch], words: pa.Array | None, block: int) -> Iterator[np.ndarray]:
    """Numbers plus one, with a 0 for each other word and after each text, a block at a time. Texts aren't split."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(0)
        at = 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        while at < len(column):
            hi = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
            own, bounds = numbers(column.slice(at, hi - at), words)
            at = hi
            out = np.zeros(len(own) + len(bounds) - 1, np.uint32)
            out[np.arange(len(own)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = np.where(own == UNKNOWN, 0, own + 1)
            held.append(out)
            size += len(out)
            if size >= block:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _each(on: np.ndarray, run: int) -> np.ndarray:
    """Where ``run`` places in a row are on."""
    out = on.copy()
    for k in range(1, run):
        out[:-k] &= on[k:]
        out[-k:] = False
    return out


def _windows(batches: Iterator[pa.RecordBatch], words: Files | None, longest: int, buckets: int, bits: int, unigrams: bool, block: int, prepare=None, lowest: int = 0, highest: int | None = None, shortest: int = 2, grams=None) -> Iterator[pa.RecordBatch]:
    """Blocks of the windows of ``shortest`` and more numbers, of buckets from ``lowest`` to below ``highest``. With
    ``grams`` (a length below ``shortest``, broadcast bits) a window ends before an n-gram of it whose bit isn't set."""

    def out(rows: list) -> pa.RecordBatch:
        bucket, size, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "rows", "data"])

    known = words.open(_words) if words is not None else None
    if prepare is not None:
        batches = (pa.RecordBatch.from_arrays([b.column(b.num_columns - 1)], names=["tokens"]) for b in prepare(batches))
    for flat in _blocks(batches, known, block):
        rows = []
        if unigrams:
            own, times = np.unique(flat[flat > 0], return_counts=True)
            if len(own):
                rows.append((-1, len(own), _packed([own, times])))
        width, seen = grams or (2, None)
        goes_on = _each((flat[:-1] > 0) & (flat[1:] > 0), width - 1)  # the places of n-grams of this length
        if seen is not None:
            at, bits_set = np.flatnonzero(goes_on), np.frombuffer(seen.value, np.uint8)
            bit = _hashed([flat[at + k] for k in range(width)]) >> np.uint64(64 - GRAM_BITS)
            goes_on[at] = (bits_set[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            del at, bit
        start = np.flatnonzero(_each(goes_on, shortest - width + 1)) if longest >= shortest else flat[:0]
        if len(start):
            h = _hashed([flat[start + k] for k in range(shortest)])
            bucket = ((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
            del h
            if highest is not None:
                own = (bucket >= lowest) & (bucket < highest)
                start, bucket = start[own], bucket[own]
        if len(start):
            long, goes_on = np.concatenate([flat, np.zeros(longest, np.uint32)]), np.concatenate([goes_on, np.zeros(longest, bool)])
            columns = [long[start + k] for k in range(shortest)]
            for k in range(shortest, longest):
                columns.append(np.where((columns[-1] > 0) & goes_on[start + k - width + 1], long[start + k], 0).astype(np.uint32))
            place = ordered(bucket, columns, bits)
            bucket, columns = bucket[place], [c[place] for c in columns]
            new = np.append(True, bucket[1:] != bucket[:-1])
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)  # equal windows of a block are one row with their number
            times = np.diff(np.append(first, len(bucket)))
            bucket, columns = bucket[first], [*[c[first] for c in columns], times]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows.append((int(bucket[lo]), hi - lo, _packed([c[lo:hi] for c in columns])))
        if rows:
            yield out(rows)


def _counted(parts: list[tuple[int, bytes]], bucket: int, longest: int, bits: int, least: int, multiple: float, most: int, shortest: int = 2) -> Iterator[pa.RecordBatch]:
    """Counts of a bucket: its smallest as a row without key, and those that can be kept in the whole."""
    wide = 2 if bucket < 0 else longest + 1
    columns = list(np.concatenate([_unpacked(d, n, wide) for n, d in parts], axis=1))
    times = columns.pop().astype(np.int64)
    if bucket < 0:
        own, at = np.unique(columns[0], return_inverse=True)
        found = [(1, [own], np.bincount(at, times).astype(np.int64))]
    else:
        place = ordered(np.zeros(len(times), np.uint64), columns, bits)
        columns = [c[place] for c in columns]
        below = np.concatenate([[0], np.cumsum(times[place])])
        new, found = np.zeros(len(place), bool), []
        new[0] = True
        for n, c in enumerate(columns, 1):
            new[1:] |= c[1:] != c[:-1]
            if n >= shortest:
                first = np.flatnonzero(new)
                counts = below[np.append(first[1:], len(place))] - below[first]
                some = c[first] > 0
                if some.any():
                    found.append((n, [x[first[some]] for x in columns[:n]], counts[some]))
    smallest = min(int(c.min()) for _, _, c in found)
    if multiple > 1 and smallest == 1:
        least = max(least, math.ceil(multiple))
    every = np.concatenate([c for _, _, c in found])
    if len(every) > most:
        least = max(least, int(np.partition(every, len(every) - most)[len(every) - most]))
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int32()), pa.array([smallest], pa.int64())], names=["key", "n", "count"])
    for n, words, counts in found:
        keep = np.flatnonzero(counts >= least)
        for lo in range(0, len(keep), 1 << 18):
            at = keep[lo : lo + (1 << 18)]
            raw = (np.stack([w[at] for w in words], axis=1) - np.uint32(1)).astype(">u4").tobytes()
            ends = (np.arange(len(at) + 1) * 4 * n).astype(np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(at), n, np.int32)), pa.array(counts[at])], names=["key", "n", "count"])


def _reduced(batches: Iterator[pa.RecordBatch], longest: int, bits: int, least: int, multiple: float, most: int, shortest: int) -> Iterator[pa.RecordBatch]:
    bucket, parts = 0, []
    for batch in batches:
        for b, n, d in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if parts and b != bucket:
                yield from _counted(parts, bucket, longest, bits, least, multiple, most, shortest)
                parts = []
            bucket = b
            parts.append((n, d))
    if parts:
        yield from _counted(parts, bucket, longest, bits, least, multiple, most, shortest)


def _decoded(batches: Iterator[pa.RecordBatch], words: Files) -> Iterator[pa.RecordBatch]:
    known = words.open(_words)
    for batch in batches:
        keys, out = batch.column(0), []
        flat = np.frombuffer(b"".join(keys.to_pylist()), ">u4").astype(np.int64)
        sizes = batch.column(1).to_numpy().astype(np.int64)
        own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), known.take(pa.array(flat)))
        out = pc.binary_join(own, " ")
        yield pa.RecordBatch.from_arrays([out, batch.column(1), batch.column(2)], names=["ngram", "n", "count"])


@dataclass
class Frequent:
    """``rows`` (``ngram``, ``n``, ``count``): every n-gram that is as frequent as the last one kept, so those of equal
    count may be more than are wanted. ``bars``: how many of them have each count, from the largest. ``numbered``: the
    documents with numbers of ``words``, if they were to be kept."""

    rows: DataFrame
    bars: list[tuple[int, int]]
    most: int
    folders: tuple[str, ...] = ()
    numbered: DataFrame | None = None
    words: Files | None = None

    def top(self) -> DataFrame:
        return self.rows.orderBy(F.col("count").desc(), "ngram").limit(self.most)

    def vocabulary(self, last: bool = False) -> DataFrame:
        """``idx``, ``ngram``, ``n``, ``count``, ``idf`` as ``vocabulary.select_vocabulary`` numbers them, written to
        the shared folder. Rows are sorted by ranges and numbered within them, so no task sorts all. ``last``:
        nothing else reads ``rows``, so what they are read from is deleted."""
        spark = self.rows.sparkSession
        every = sum(n for _, n in self.bars)
        more = max(0, every - self.most)  # the first of the rising order, all of the least count, go
        total = sum(c * n for c, n in self.bars) - more * (self.bars[-1][0] if self.bars else 0)
        place = F.monotonically_increasing_id()
        ranged = self.rows.orderBy("count", F.col("ngram").desc())
        rows, _ = written(ranged.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND((1 << 33) - 1)))
        if last:
            dropped(spark, *self.folders)
        sizes = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).collect())
        before, seen = [], 0
        for part, n in sizes:
            before.append((part, seen - more))
            seen += n
        offsets = spark.createDataFrame(before, "part bigint, before bigint")
        idf = (F.log(F.lit(float(total or 1))) - F.log(F.col("count").cast("double"))).cast("float")
        return rows.join(F.broadcast(offsets), "part").select((F.col("at") + F.col("before")).cast("int").alias("idx"), "ngram", "n", "count", idf.alias("idf")).where("idx >= 0")


def _counts(tokens: DataFrame, words: Files | None, longest: int, most: int, min_multiple: float, least: int, size: int, bits: int, unigrams: bool, block: int, prepare=None, rounds: int = 1, shortest: int = 2, grams=None, earlier: DataFrame | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Counts, a table for each round, and their folders. What a round finds, and the ``count`` of what was found
    ``earlier``, bounds what later ones can keep."""
    spark, buckets = tokens.sparkSession, max(1, size // BUCKET)
    rounds = min(rounds, buckets)
    found, folders = [], []
    for k in range(rounds):
        lowest, highest = (buckets * k // rounds, buckets * (k + 1) // rounds) if rounds > 1 else (0, None)
        blobs = tokens.mapInArrow(lean(_windows, words=words, longest=longest, buckets=buckets, bits=bits, unigrams=unigrams, block=block, prepare=prepare, lowest=lowest, highest=highest, shortest=shortest, grams=grams), "bucket int, rows int, data binary")
        parts = max((highest or buckets) - lowest, int(spark.conf.get("spark.sql.shuffle.partitions")))
        placed = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket")
        rows, folder = written(placed.mapInArrow(lean(_reduced, longest=longest, bits=bits, least=least, multiple=min_multiple, most=most, shortest=shortest), "key binary, n int, count bigint"))
        found.append(rows)
        folders.append(folder)
        if k + 1 < rounds:
            so_far = [r.where("n > 1").select("count") for r in found] + ([] if earlier is None else [earlier])
            least = max(least, least_kept(histogram(reduce(DataFrame.unionByName, so_far)), most))
    return reduce(DataFrame.unionByName, found), tuple(folders)


def _longer(own: DataFrame, known: Dictionary, longest: int, most: int, min_multiple: float, block: int) -> tuple[DataFrame, tuple[str, ...]]:
    """Counts of n-grams of two and more words, by length: two, three, the others.

    An n-gram below the count of the ``most``-th found so far, or below ``min_multiple`` where one that occurs once is
    known, isn't part of a kept one. Where the smallest count may be that of a longer n-gram and make a difference, no
    window is cut."""
    spark, wide = own.sparkSession, max(1, (known.size + 1).bit_length())
    smallest = known.counts.agg(F.min("count")).first()[0] or 1
    least, smallest = (1, smallest) if known.complete else (smallest, 1)
    found, folders, counts = [], (), known.counts.select("count")
    shortest, size, grams, cut = 2, known.places, None, True
    while shortest <= longest:
        upto = shortest if shortest < 4 and cut else longest
        rounds = max(1, min(2 if shortest < 4 and cut else 1 if cut else ROUNDS - 2, size // ROUND))
        rows, there = _counts(own, None, upto, most, min_multiple, least, size, wide, False, block, rounds=rounds, shortest=shortest, grams=grams, earlier=counts)
        found.append(rows)
        folders += there
        if grams is not None:
            grams[1].destroy()
        if upto == longest:
            break
        counts = counts.unionByName(rows.where("n > 1").select("count"))
        least = max(least, least_kept(histogram(counts), most))
        smallest = min([smallest] + [r[0] for r in rows.where("n = 0").agg(F.min("count")).collect() if r[0] is not None])
        if min_multiple > 1 and smallest == 1:
            least = max(least, math.ceil(min_multiple))
        cut = least > 1 and (shortest > 2 or min_multiple <= 1 or smallest == 1 or least >= smallest * min_multiple)
        if cut:
            kept = rows.where((F.col("n") == shortest) & (F.col("count") >= least))
            grams, size = (shortest, spark.sparkContext.broadcast(gram_bits(kept, shortest))), kept.agg(F.sum("count")).first()[0] or 0
        shortest += 1
    if not found:
        return _counts(own, None, 1, most, min_multiple, least, size, wide, False, block)
    return reduce(DataFrame.unionByName, found), folders


def frequent_words(docs: DataFrame, tokens_col: str = "tokens", longest: int = 5, most: int = 2_000_000, min_multiple: float = 1.0, block: int = BLOCK, keep: tuple[str, ...] = ()) -> Frequent:
    """The ``most`` most frequent n-grams of words joined by a space, of those whose count is at least
    ``min_multiple`` times the smallest. ``docs`` is read twice, to number its words and to store them as numbers. With
    columns to ``keep`` the numbers stay, beside those columns, as ``numbered``."""
    own = docs.select(*keep, F.col(tokens_col).alias("tokens"))
    known = dictionary(own, "tokens", most, min_multiple)
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    rows, stored = written(own.mapInArrow(lean(numbered, words=known.words), schema))
    counts, folders = _longer(rows.select("tokens"), known, longest, most, min_multiple, block)
    if not keep:
        dropped(docs.sparkSession, stored)
    smallest = [r[0] for r in counts.where("n = 0").agg(F.min("count")).collect() + ([] if not known.complete else known.counts.agg(F.min("count")).collect()) if r[0] is not None]
    floor = (1 if not known.complete else min(smallest, default=1)) * min_multiple if min_multiple > 1 else 1.0
    both = counts.where(F.col("n") > 1).select("count").unionByName(known.counts.select("count")).where(F.col("count") >= floor)
    bars = histogram(both)
    last = max(floor, least_kept(bars, most))
    longer = counts.where((F.col("n") > 1) & (F.col("count") >= last)).mapInArrow(lean(_decoded, words=known.words), "ngram string, n int, count bigint")
    every = longer.unionByName(known.counts.where(F.col("count") >= last).select("ngram", F.lit(1).alias("n"), "count"))
    return Frequent(every, [(c, n) for c, n in bars if c >= last], most, folders, rows if keep else None, known.words)


def frequent_tokens(docs: DataFrame, tokens_col: str = "tokens", longest: int = 5, most: int = 2_000_000, min_multiple: float = 1.0, size: int = BUCKET, bits: int = 32, block: int = BLOCK, prepare=None) -> Frequent:
    """The same for token numbers below 2**32 - 2, of ``bits`` bits with 1 added; ``ngram`` is an ``array<bigint>``.
    ``docs`` is read once; ``size`` is about how many tokens there are, for the number of buckets. With ``prepare`` the
    column is what that stage, run in the same worker, makes the last column of its batches from."""
    from .ngrams import unpacked

    counts, folders = _counts(docs.select(tokens_col), None, longest, most, min_multiple, 1, size, bits, True, block, prepare)
    smallest = counts.where("n = 0").agg(F.min("count")).first()[0] or 1
    floor = smallest * min_multiple if min_multiple > 1 else 1.0
    real = counts.where((F.col("n") > 0) & (F.col("count") >= floor))
    bars = histogram(real)
    last = max(floor, least_kept(bars, most))
    rows = real.where(F.col("count") >= last).select(unpacked("key").alias("ngram"), "n", "count")
    return Frequent(rows, [(c, n) for c, n in bars if c >= last], most, folders)
