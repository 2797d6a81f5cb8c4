"""Writers of vectors, label files and sparse rows, and restarting where an earlier run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import label_line


def write_codes(df: DataFrame, path: str, limit: float, id_col: str = "document_id", vector_col: str = "embedding", dims: int | None = None, by: tuple[str, ...] = ()) -> None:
    """Quantised vectors as Parquet: the identifier, ``embedding array<smallint>`` and the columns ``by``, which make
    the folders. With ``dims`` a vector of another size raises."""
    v = F.col(vector_col)
    if dims is not None:
        v = F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.lit(f"a vector doesn't have {dims} values")))
    df.select(F.col(id_col).alias("document_id"), V.quantize(v, limit).alias("embedding"), *by).write.mode("append").partitionBy(*by).parquet(path)


def write_vectors(df: DataFrame, path: str, id_col: str = "document_id", vector_col: str = "embedding", limit: float | None = None) -> None:
    """Float vectors as Parquet. With ``limit`` they pass through 8-bit codes first, so a column has 256 values and
    the files' dictionaries make it a quarter of the size."""
    v = F.col(vector_col) if limit is None else V.dequantize(V.quantize(F.col(vector_col), limit), limit)
    df.select(F.col(id_col).alias("document_id"), v.alias("embedding")).write.parquet(path)


def pending(inputs: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """Rows of the input units ``by`` (such as files) that ``done`` has none of."""
    return inputs.join(done.select(by).distinct(), by, "left_anti")


def check_complete(inputs: DataFrame, done: DataFrame, by: str) -> DataFrame:
    """Units that ``done`` has with another number of rows than the input: the unit, ``rows_in``, ``rows_done``. A
    restart should stop if there are any."""
    a = inputs.groupBy(by).agg(F.count(F.lit(1)).alias("rows_in"))
    b = done.groupBy(by).agg(F.count(F.lit(1)).alias("rows_done"))
    return b.join(a, by, "left").where("rows_in IS NULL OR rows_in <> rows_done").select(by, "rows_in", "rows_done")


def resume(spark: SparkSession, inputs: DataFrame, path: str, by: str, step) -> None:
    """Apply ``step`` to the units that the table at ``path`` lacks, and append the result, which keeps ``by``.
    ``ValueError`` if a unit that is there has another number of rows than its input."""
    try:
        done = spark.read.parquet(path).select(by)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        step(inputs).write.partitionBy(by).parquet(path)
        return
    wrong = check_complete(inputs, done, by).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0][0]} has {wrong[0].rows_done} rows; its input has {wrong[0].rows_in}")
    step(pending(inputs, done, by)).write.mode("append").partitionBy(by).parquet(path)


def write_label_lines(df: DataFrame, path: str, label_col: str = "label", text_col: str = "text") -> None:
    df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(label_line(F.col(label_col), F.col(text_col)).alias("value")).write.text(path)
