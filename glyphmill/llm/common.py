"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row may be broadcast (8 to 32 bytes a row); beyond it the same join is
#: shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names in ``spark.checkpoint.dir``, or that the
    session was given. Only on one machine, as in tests, a temporary folder is chosen where neither is set."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="glyphmill-")
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows as Parquet in the shared folder, which takes less room than a checkpoint for a long table of numbers,
    and a function that deletes them once what needs them is itself materialised."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def delete() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.parquet(folder), delete


def semi(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", most: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join of wide rows with a set of keys that has been materialised.

    ``keys`` has the one column ``on``, without repeats. Its rows are counted: up to ``most`` it is broadcast and
    the wide rows stay where they are; beyond that both sides are shuffled on the key and the keys build the hash
    tables.
    """
    hint = "broadcast" if keys.count() <= most else "shuffle_hash"
    return df.join(keys.hint(hint), on, how)


def lookup(df: DataFrame, values: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a narrow materialised table that has each key once. Up to ``most`` rows it is broadcast; beyond
    that the join is sorted and shuffled, so that adaptive execution can split a key that many rows of ``df`` share."""
    return df.join(values.hint("broadcast" if values.count() <= most else "merge"), on, "left")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """128 bits of a hash over all columns, as a struct, equal for rows that are equal as a whole."""
    own = []
    for name, kind in df.dtypes:
        c = F.col("`" + name.replace("`", "``") + "`")
        own += [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c, c.isNull()]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"))


#: Rows in a batch of wide rows. Texts have kilobytes each, so the engine's 10,000 rows are tens of megabytes, several
#: times over in the JVM and in Python.
ARROW_ROWS = 2000


def lean(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = ARROW_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow stage with batches of at most ``rows`` rows, whatever the session's batch size, and with memory that
    it no longer needs given back when a partition ends: workers live on through the stages of a job."""
    return partial(_lean, stage=stage, rows=rows)


def _lean(batches: Iterator[pa.RecordBatch], stage, rows: int) -> Iterator[pa.RecordBatch]:
    try:
        yield from stage(batch.slice(lo, rows) for batch in batches for lo in range(0, batch.num_rows, rows))
    finally:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # a C library that has no such function
    _trim = None


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that a text operator reads, as ``doc_id`` and ``text``; other columns don't come along."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def bounded_sample(source: DataFrame, rows: int, finish: Callable[[DataFrame, int], DataFrame] = lambda df, expected: df) -> list[Row]:
    """At most ``rows`` rows of ``finish(source, expected)``, those with the smallest hashes of ``doc_id``, in that
    order; of equal identifiers those with the smallest other columns.

    Only the rows of ``source`` whose hash is below a bound are looked at: the bound is set by the number of rows so
    that twice as many rows as wanted are expected below it, and raised eightfold where ``finish`` (filters, joins)
    leaves fewer than wanted. ``finish`` is told how many rows of ``source`` to expect. So a large table is counted, which needs no column, and read once, and never more than
    ``rows`` rows reach the driver, however often an identifier is repeated.
    """
    total = source.count()
    share = 2 * rows / max(1, total)
    while True:
        below = source if share >= 1 else source.where(F.xxhash64("doc_id") < F.lit(int((2 * share - 1) * (1 << 63))))
        got = finish(below, int(min(1.0, share) * total) + 1)
        best = got.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", *got.columns).limit(rows).drop("__h").collect()
        if len(best) == rows or share >= 1:
            return best
        share *= 8
