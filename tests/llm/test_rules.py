from functools import reduce

import duckdb
from pyspark.sql import functions as F

from glyphmill.llm import rules

SF = "/root/testdata/sf0.001"
SPACE = "[ \\t\\n\\r\\f]+"


def words(text):
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _share(part, whole):
    return part / F.greatest(whole, F.lit(1))


def column_rules(text):
    """The rules as columns of the engine, written apart from the batch form."""
    length, w = F.length(text), words(text)
    n = F.size(w)
    letters = length - F.length(F.regexp_replace(text, "\\p{L}", ""))
    upper = length - F.length(F.regexp_replace(text, "\\p{Lu}", ""))
    sentences = F.filter(F.split(text, "[.!?\\n]+[ \\t]*"), lambda s: s != "")
    same = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x))
    return {
        "no_words": n < 1,
        "word_length": (F.length(F.regexp_replace(text, SPACE, "")) / F.greatest(n, F.lit(1)) > rules.MAX_WORD) | ((n > 3) & (F.length(F.regexp_replace(text, SPACE, "")) / F.greatest(n, F.lit(1)) < rules.MIN_WORD)),
        "symbols": _share(length - F.length(F.translate(text, rules._SYMBOL, "")), length) > rules.SYMBOLS,
        "tables": _share(length - F.length(F.translate(text, "|", "")), n) > rules.PIPES,
        "upper_case": (letters >= 20) & (_share(upper, letters) > rules.UPPER),
        "repeated_words": (n >= 10) & (_share(same, n) > rules.REPEATS),
        "repeated_sentences": (F.size(sentences) >= 5) & (1 - F.size(F.array_distinct(sentences)) / F.greatest(F.size(sentences), F.lit(1)) > rules.SENTENCES),
    }


def test_order():
    assert rules.order_rules({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (0.01, 0.0), "d": (1.0, 0.1)}) == ["b", "a", "d", "c"]


def test_whole_table_against_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = reduce(lambda a, b: a | b, column_rules(F.col("text")).values())
    want = sorted(r.doc_id for r in docs.where(~bad).collect())
    assert want == sorted(r.doc_id for r in rules.keep_good(docs).collect())
    assert 0 < len(want) < docs.count()


def test_estimates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    got = rules.estimate_batches([r.text for r in docs.collect()])
    for name, rule in column_rules(F.col("text")).items():
        assert got[name][0] > 0 and abs(got[name][1] - docs.where(rule).count() / docs.count()) < 1e-9


def test_query_and_sql_agree_on_nulls(spark, tmp_path):
    rows = [(1, "some plain words"), (None, "other plain words"), (2, None), (None, None), (1, "some plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in rules.op8_quality_rules(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.sql(rules.ORACLES["op8_quality_rules"]).fetchall(), key=str) == [(1, 3), (1, 3), (None, 3)]


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.sql(rules.ORACLES["op8_quality_rules"]).fetchall()) == sorted(tuple(r) for r in rules.op8_quality_rules(spark, SF).collect())


def test_keeps_clean_and_drops_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = rules.keep_good(docs).select("doc_id", F.lit(1).alias("kept"))
    got = {r.quality: r.share for r in labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert got[1] > 0.995 and got[0] < 0.1


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Of."), (None, "plain words here"), (5, "same text"), (5, "same text"), (6, "go " * 100_000), (7, "$$$ %%% &&&"), (8, "a | b | c | d"), (9, "fine words " + "and more of them, then others. " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS reason")
    got = rules.keep_good(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["4", "5", "5", "9", "None"]
    assert rules.keep_good(df.limit(0)).collect() == []


def test_batches_and_columns_agree(spark):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    bits = ["a", "Ab", "ÄÖ", "straße", "Ω", "漢字", "𐐀", "|", "#", " ", "  ", "\t", "\n", "\f", "\r", ". ", "!? ", ".\t \n", "word word", "THE END", "é", " ", "."]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for name, rule in column_rules(F.coalesce("text", F.lit(""))).items():
        want = [r[0] for r in df.orderBy("doc_id").select(rule).collect()]
        got = rules.RULES[name](rules.Texts.of(pa.array(texts, pa.string())))
        assert got.tolist() == want, name
    whole = rules.Texts.of(pa.array(texts, pa.string()))
    on = [3, 50, 51, 400]
    assert rules.RULES["upper_case"](whole.select(on)).tolist() == rules.RULES["upper_case"](whole)[on].tolist()


def test_every_order_gives_the_same_survivors():
    import itertools

    import pyarrow as pa

    texts = pa.array([None, "", "fine words here.", "### $$$ ###", "A | B | C | D", "SHOUTING ALL THE TIME HERE NOW", "no no no no no no no no no no no", "Same. " * 9], pa.string())
    got = {tuple(rules.survivors(texts, list(o))[0].tolist()) for o in itertools.permutations(sorted(rules.RULES))}
    assert got == {(2,)}
