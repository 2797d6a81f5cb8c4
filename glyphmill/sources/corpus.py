"""A corpus of many Parquet files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _scheme(path: str) -> str:
    kind = urlparse(path).scheme
    return "s3" if kind in ("s3", "s3a", "s3n") else "" if kind == "file" else kind


@dataclass(frozen=True)
class Corpus:
    """Files in a fixed order, all in one kind of file system. Paths may be globs and any URI the engine reads."""

    spark: SparkSession
    paths: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.paths:
            raise ValueError("a corpus has at least one path")
        if len({_scheme(p) for p in self.paths}) > 1:
            raise ValueError("the paths are in different kinds of file system")

    @staticmethod
    def of(spark: SparkSession, *paths: str) -> Corpus:
        return Corpus(spark, tuple(paths))

    def read(self, *columns: str) -> DataFrame:
        """The rows; only the named columns are read from the files."""
        df = self.spark.read.parquet(*[p.replace("s3://", "s3a://", 1) for p in self.paths])
        return df.select(*columns) if columns else df

    def pairs(self, id_col: str = "id", text_col: str = "text") -> DataFrame:
        return self.read(id_col, text_col)

    def file_rows(self) -> DataFrame:
        """``path`` and ``rows`` of each file that has any; no column is decoded."""
        return self.read().groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))

    def __len__(self) -> int:
        return self.read().count()

    @property
    def fingerprint(self) -> str:
        """Four hexadecimal digits that depend on the list of paths."""
        return hashlib.sha256("\n".join(self.paths).encode()).hexdigest()[:4]

    def files(self) -> list[str]:
        """The files behind the paths, sorted."""
        return sorted(self.read().inputFiles())

    def batches(self, size: int = 4096, seed: int | None = None, columns: Sequence[str] | None = None, most: int | None = None) -> Iterator[pa.RecordBatch]:
        """Record batches of at most ``size`` rows for a consumer on this machine, file by file; with a seed the files
        come in an order that depends on it. A file is read a row group at a time, ``columns`` alone, and reading ends
        after ``most`` rows."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files = self.files()
        if seed is not None:
            files.sort(key=lambda f: hashlib.md5(f"{seed}|{f}".encode()).hexdigest())
        for f in files:
            if most is not None and most <= 0:
                return
            where, path = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", re.sub("^s3[an]:", "s3:", f)))
            with where.open_input_file(unquote(path) if f.startswith("file:") else path) as source:
                for batch in pq.ParquetFile(source).iter_batches(size, columns=list(columns) if columns else None):
                    if most is not None:
                        batch = batch.slice(0, most)
                        most -= batch.num_rows
                    if batch.num_rows:
                        yield batch
                    if most is not None and most <= 0:
                        return

    def tokens(self, state: str, text_col: str = "text", most: int | None = None, size: int = 4096) -> Iterator[np.ndarray]:
        """Token numbers of one document after another for a consumer on this machine; ends after ``most`` documents
        without reading further row groups. Null texts are left out."""
        from ..functions import subword

        tokenizer = subword.load(state)
        for batch in self.batches(size, columns=[text_col]):
            texts = [t for t in batch.column(0).to_pylist() if t is not None][:most]
            flat, bounds = subword.encode(tokenizer, texts)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                yield flat[lo:hi]
            if most is not None:
                most -= len(texts)
                if most <= 0:
                    return


#: Bytes a core up to which ``spread`` moves rows.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table is of fewer files than there are cores and small.

    A file of one row group is read by one task, whatever its size, and the operators here spend far more time on a
    row than a shuffle of it. A table of many files, or of more than ``SPREAD_BYTES`` a core, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first rows that the engine finds, exactly ``n`` where there are as many."""
    return df.limit(n)


def read_arrow_file(spark: SparkSession, path: str) -> DataFrame:
    """A table of an Arrow IPC file that the driver can read."""
    with pa.memory_map(path) as source:
        return spark.createDataFrame(pa.ipc.open_file(source).read_all())


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """``label`` and ``text`` of a label file."""
    from ..functions.text import parse_label

    line = F.col("value")
    head = F.substring_index(line, " ", 1)
    return spark.read.text(path).select(parse_label(head).alias("label"), F.expr("substring(value, length(substring_index(value, ' ', 1)) + 2)").alias("text"))


def source_file() -> Column:
    """Name of the file that a row was read from."""
    return F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
