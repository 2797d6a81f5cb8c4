import random

import duckdb
import pytest

import corpus_pipeline
from glyphmill.llm import rules

from .test_jaccard import brute as brute_pairs
from .test_secretscan import brute as brute_secrets
from .test_tiling import brute as brute_tiling


def expected(docs, items):
    """doc_id and final text of what stays."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    good = {r[0] for r in con.sql(rules.ORACLES["op8_quality_rules"]).fetchall()}
    kept = [(d, t) for d, t in docs if d in good]
    root = {d: d for d, _ in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(kept, 3, 0.5):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    kept = [(d, t) for d, t in kept if find(d) == d]
    bad = {d for d, *_ in brute_tiling(kept, items, 5, 0.6)}
    out = {}
    for d, t in kept:
        if d not in bad:
            for a, b, kind, _ in reversed(brute_secrets(t)):
                t = f"{t[:a]}<{kind}>{t[b:]}"
            out[d] = t
    return out


def _write(spark, folder, docs, items):
    rows = [(d, t, "en", "src0", len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def _decoded(spark, out):
    from glyphmill.llm import pieces

    return {r.doc_id: r.text for r in pieces.decode(out).collect()}


def test_fixture_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "ra"]) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(4)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(20, 90))]
        if d % 9 == 1:
            w[5:5] = items[d % 4][1].split()
        if d % 7 == 2:
            w[3:3] = ["token", "=", '"04dbebab91ab85687d33eeaaf9ac699e1188f962"', "card", "4111111111111111"]
        if d % 11 == 3:
            w = [x + "###" for x in w]
        docs.append((d, " ".join(w)))
    for d in range(80, 95):
        w = docs[rng.randrange(80)][1].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((d, " ".join(w)))
    _write(spark, tmp_path, docs, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    want = expected(docs, items)
    assert 0 < len(want) < 75
    assert _decoded(spark, out) == want


def test_small_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert _decoded(spark, corpus_pipeline.run(spark, sf)) == expected(docs, items)


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", None, None, 0), (3, "some words here", "en", "a", 15), (3, "some words here", "en", "a", 15), (None, "other words", "en", "b", 11)]])
def test_edge_rows(spark, tmp_path, rows):
    """Stages are called on a table with extra columns, nulls in all columns and repeated rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS fp", "'x' AS kind")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(str(r.doc_id) for r in docs.collect()) == (["3", "None"] if rows else [])
