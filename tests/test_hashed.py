"""Hashes in Arrow stages against the Column expression, and scores of empty texts."""

from pyspark.sql import functions as F

from glyphmill.functions import hashing
from glyphmill.operators import evaluation, hashed
from glyphmill.plans import queries


def test_hash_sums_and_clashes(spark):
    import hashlib

    docs = [["a", "b", "a", "b", "é"], [], None, ["a"], ["b", "a"]]
    frame = spark.createDataFrame([(i // 2, d) for i, d in enumerate(docs)], "doc_id bigint, tokens array<string>")
    number = lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
    want, distinct = {}, set()
    for i, d in enumerate(docs):
        for n in (1, 2, 3):
            for k in range(len(d or []) - n + 1):
                g = tuple(number(w) for w in d[k : k + n])
                h = int(hashing.fnv1a_rows(hashing.pad_rows([g], 3))[0])
                a = want.setdefault(i // 2, [0, 0, 0])
                a[0], a[1], a[2] = a[0] + 1, a[1] + (h & 0xFFFFFFFF), a[2] + (h >> 32)
                distinct.add(g)
    assert {r[0]: list(r)[1:] for r in hashed.hash_sums(frame).collect()} == want
    assert tuple(hashed.clashes(frame, 10).first()) == (0, 0)


def test_clashes_count_distinct_rows(monkeypatch):
    import numpy as np

    monkeypatch.setattr(hashing, "fnv1a_rows", lambda rows: (rows[:, 0] % 3).astype(np.int64))
    rows, low = hashed._distinct(np.array([[1, 5], [4, 5], [1, 5], [2, 2], [4, 5], [1, 6]], np.uint32))
    assert sorted(map(tuple, rows.tolist())) == [(1, 5), (1, 6), (2, 2), (4, 5)] and low.tolist() == [1, 1, 1, 2]


def test_scores_of_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, "a,"), (3, "ab"), (4, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id bigint, quality bigint").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES["auc"](spark, str(tmp_path)).first()[0] == 1.0


def test_scores_are_joined_without_texts(spark, tmp_path):
    spark.createDataFrame([(i, "a," * (i % 5) + "b") for i in range(40)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 2)) for i in range(40)], "doc_id bigint, quality bigint").write.parquet(f"{tmp_path}/labels.parquet")
    plan = queries._scored(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "text" not in plan[0] and "replace" in plan[1].lower()
    assert queries.QUERIES["gini"](spark, str(tmp_path)).first()[0] == 1.0
