import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.text import words
from glyphmill.operators.ngrams import count_ngrams
from glyphmill.sources import corpus, places, sinks
from glyphmill.streaming import incremental

from .test_models import tiny


@pytest.fixture
def files(tmp_path):
    for k in range(3):
        pq.write_table(pa.table({"doc_id": [10 * k + i for i in range(k + 1)], "text": [f"word{k} and word{i}" for i in range(k + 1)], "other": [0] * (k + 1)}), tmp_path / f"part{k}.parquet")
    return tmp_path


def test_corpus(spark, files):
    c = corpus.Corpus.of(spark, *[str(files / f"part{k}.parquet") for k in range(3)])
    assert len(c) == 6
    assert {os.path.basename(r.path): r.rows for r in c.file_rows().collect()} == {f"part{k}.parquet": k + 1 for k in range(3)}
    assert [os.path.basename(f) for f in c.files()] == [f"part{k}.parquet" for k in range(3)]
    assert len(c.fingerprint) == 4 and c.fingerprint != corpus.Corpus.of(spark, str(files)).fingerprint
    plain, one, same = (list(c.batches(2, s)) for s in (None, 1, 1))
    assert sum(b.num_rows for b in plain) == 6 and max(b.num_rows for b in plain) == 2 and one == same
    assert plain[0].column("doc_id")[0].as_py() == 0
    assert c.pairs("doc_id", "text").columns == ["doc_id", "text"]
    assert corpus.limited(c.read("text"), 4).count() == 4
    plan = c.read("text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    for bad in ((), ("s3://a/b", "/tmp/c")):
        with pytest.raises(ValueError):
            corpus.Corpus.of(spark, *bad)


def test_arrow_file(spark, tmp_path):
    t = pa.table({"text": ["a", "b"], "y": [0, 1]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert [tuple(r) for r in corpus.read_arrow_file(spark, str(tmp_path / "x.arrow")).collect()] == [("a", 0), ("b", 1)]


def test_label_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "Some\nText  here"), (0, "b"), (None, "c")], "label int, text string")
    sinks.write_label_lines(df, str(tmp_path / "l"))
    got = sorted(map(tuple, corpus.read_label_lines(spark, str(tmp_path / "l")).collect()))
    assert got == [(0, "b"), (1, "some <new_line> text here")]


def test_codes_and_vectors(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(str(i), rng.uniform(-0.4, 0.4, 32).tolist()) for i in range(400)], "document_id string, embedding array<float>")
    sinks.write_codes(df, str(tmp_path / "q"), 0.5, dims=32)
    assert spark.read.parquet(str(tmp_path / "q")).schema.simpleString() == "struct<document_id:string,embedding:array<smallint>>"
    with pytest.raises(Exception, match="31 values"):
        sinks.write_codes(df, str(tmp_path / "r"), 0.5, dims=31)
    big = df.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.rand(1).cast("float") - 0.5)).coalesce(1)
    sinks.write_vectors(big, str(tmp_path / "plain"))
    sinks.write_vectors(big, str(tmp_path / "coded"), limit=0.5)
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / p).glob("*.parquet"))
    assert size("coded") < 0.5 * size("plain")


def test_resume(spark, files, tmp_path):
    docs = spark.read.parquet(str(files / "part*.parquet")).withColumn("source_file", corpus.source_file())
    out, step = str(tmp_path / "done"), lambda df: df.select("doc_id", "source_file")
    sinks.resume(spark, docs.where("source_file <> 'part2.parquet'"), out, "source_file", step)
    assert spark.read.parquet(out).count() == 3
    sinks.resume(spark, docs, out, "source_file", step)
    sinks.resume(spark, docs, out, "source_file", step)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [0, 10, 11, 20, 21, 22]
    assert sinks.check_complete(docs, spark.read.parquet(out), "source_file").count() == 0
    with pytest.raises(ValueError, match="part2"):
        sinks.resume(spark, docs.where("doc_id <> 21"), out, "source_file", step)


def test_stream_counts_as_batch(spark, files, tmp_path):
    docs = spark.read.parquet(str(files / "part*.parquet"))
    folder = str(tmp_path / "work")

    def run():
        incremental.count_stream(incremental.documents(spark, str(files / "part*.parquet"), docs.schema, 1), folder).awaitTermination()
        return sorted(map(tuple, incremental.counted(spark, folder).collect()))

    want = lambda: sorted(map(tuple, count_ngrams(spark.read.parquet(str(files / "part*.parquet")).select(words(F.col("text")).alias("tokens"))).collect()))
    assert run() == want() and len(os.listdir(f"{folder}/counts")) == 3
    assert run() == want()
    pq.write_table(pa.table({"doc_id": [99], "text": ["word1 comes late"], "other": [0]}), files / "part9.parquet")
    assert run() == want()


def test_running_counts(spark, files):
    docs = incremental.documents(spark, str(files / "part*.parquet"), spark.read.parquet(str(files / "part*.parquet")).schema)
    q = incremental.running_counts(docs).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ngram: r["count"] for r in spark.table("running").collect()}
    assert got["and"] == 6 and got["word2 and"] == 3


def test_stream_embed(spark, files, tmp_path):
    docs = spark.read.parquet(str(files / "part*.parquet"))
    model = tiny()
    incremental.embed_stream(model, incremental.documents(spark, str(files / "part*.parquet"), docs.schema), str(tmp_path / "v")).awaitTermination()
    got = {r.doc_id: r.embedding for r in spark.read.parquet(str(tmp_path / "v/vectors")).collect()}
    assert got == {r.doc_id: r.embedding for r in model.embed(docs).collect()}


def test_workfolder(spark):
    assert places.workfolder(spark) != places.workfolder(spark)


def test_spread(spark, files, monkeypatch):
    one = spark.read.parquet(str(files / "part2.parquet"))
    assert corpus.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, corpus.spread(one).collect())) == sorted(map(tuple, one.collect()))
    monkeypatch.setattr(corpus, "SPREAD_BYTES", 1)
    assert corpus.spread(one) is one


def test_row_groups_stream_and_stop(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from glyphmill.functions import subword
    from glyphmill.plans.queries import TOKENIZER
    from glyphmill.sources.corpus import Corpus

    for k in range(3):
        rows = {"id": [f"{k}-{i}" for i in range(10)], "text": [f"text {k} {i}" if i else None for i in range(10)]}
        pq.write_table(pa.table(rows), tmp_path / f"a b{k}.parquet", row_group_size=4)
    corpus = Corpus.of(spark, str(tmp_path))
    got = list(corpus.batches(3, columns=["id"]))
    assert max(b.num_rows for b in got) <= 3 and [b.schema.names for b in got][0] == ["id"]
    assert [x for b in got for x in b.column(0).to_pylist()] == [f"{k}-{i}" for k in range(3) for i in range(10)]
    assert [x for b in corpus.batches(4, most=13) for x in b.column(0).to_pylist()] == [f"{k}-{i}" for k in range(3) for i in range(10)][:13]
    assert list(corpus.batches(most=0)) == []
    a, b = ([x for b in corpus.batches(4, seed=s) for x in b.column(0).to_pylist()] for s in (1, 1))
    assert a == b and sorted(a) == sorted(f"{k}-{i}" for k in range(3) for i in range(10))
    state = subword.read_state(TOKENIZER)
    tokens = [t.tolist() for t in corpus.tokens(state, most=11)]
    texts = [f"text {k} {i}" for k in range(3) for i in range(1, 10)]
    flat, bounds = subword.encode(subword.load(state), texts[:11])
    assert tokens == [flat[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:])]
