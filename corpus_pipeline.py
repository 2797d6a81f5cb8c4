"""From raw documents to piece numbers: a chain of five operators, each on what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last
with the columns of ``documents``. ``run`` applies them, writing each result as Parquet and reading it again.

1. quality_rules: documents that a rule rejects go.
2. near_duplicates: of each class of near duplicates the document with the smallest identifier stays.
3. decontaminate: documents that hold a benchmark item go.
4. secrets: secrets in the text are replaced by their kind, and ``n_chars`` follows.
5. sentencepiece: the n best segmentations of each text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import jaccard, pieces, rules, secretscan, tiling
from glyphmill.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects. Null and empty texts and those of white space alone go; repeated rows and
    rows without identifier are judged like others; very long texts are judged whole. An empty table stays empty."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest identifier (rows without one come last).
    Rows that are repeated whole leave one. Null and empty texts match nothing and stay, as do other texts under the
    identifier of a copy. Very long texts are compared whole. An empty table stays empty."""
    return jaccard.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the table ``benchmark``. Null and empty texts stay; repeated rows are judged
    alike; very long texts are searched whole. An empty table on either side removes nothing."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by their kind and ``n_chars`` brought up to date. Null and
    empty texts and texts without a secret stay as they are; repeated rows change alike; very long texts are searched
    whole. An empty table stays empty."""
    return secretscan.redact(docs, "text", "n_chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The n best segmentations of each document, one row for each row: nulls for a null text, no pieces for an empty
    one. Of equally scored segmentations the choice is fixed (``pieces.encode``). Very long texts are encoded whole.
    An empty table gives no rows."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: Greedy tiling, redaction and segmentation can't be put in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the ``documents`` of ``sf_dir``. Between stages the documents are written to
    the shared folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor repeats one stage. What a
    stage has read is deleted once its own result is written; only the last stage's input stays, as the result is
    computed from it when it is asked for."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(out), out
    return STAGES[-1][1](spark, docs, sf_dir)
