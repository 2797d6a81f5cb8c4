import json
import os

import numpy as np
import pyarrow as pa
import pytest

from glyphmill import cli
from glyphmill.functions import subword
from glyphmill.operators import embed, features, network, ngrams
from glyphmill.operators.network import Network, Sparse
from glyphmill.sources import arrays, models

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
STATE = subword.read_state(TOKENIZER)


def tiny(seed=0):
    own = subword.load(STATE)
    ids = own.encode("the river rose over the river bank", add_special_tokens=False).ids
    grams = sorted({tuple(ids[i : i + n]) for n in (1, 2, 3) for i in range(len(ids) - n + 1)})
    rows = np.full((len(grams), 3), np.iinfo(np.uint32).max, np.uint32)
    for i, g in enumerate(grams):
        rows[i, : len(g)] = g
    rng = np.random.default_rng(seed)
    return embed.Embedder(STATE, rows, rng.uniform(0.5, 3, len(grams)).astype(np.float32), Network.random([len(grams), 6, 4], seed=seed))


TEXTS = ["The river rose", "over the bank the river", "", None, "xylophone 99", "the the the river river rose " * 50]


def brute(model, texts):
    own = subword.load(STATE)
    at = {tuple(int(t) for t in g if t != np.iinfo(np.uint32).max): i for i, g in enumerate(model.ngrams)}
    x = np.zeros((len(texts), len(at)))
    for d, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        for n in range(1, 4):
            for i in range(len(ids) - n + 1):
                if (k := at.get(tuple(ids[i : i + n]))) is not None:
                    x[d, k] += 1
    counts = x.copy()
    x *= model.idf
    norm = lambda v: v / np.where((n := np.sqrt((v * v).sum(1, keepdims=True))) == 0, 1, n)
    h = norm(x)
    for w in model.network.layers[:-1]:
        h = norm(np.maximum(h @ w.T, 0))
    return counts, norm(x), norm(h @ model.network.layers[-1].T)


def test_embedder_against_brute_force(spark):
    model = tiny()
    counts, weights, want = brute(model, TEXTS)
    assert (model.counts(TEXTS).dense() == counts).all()
    assert np.allclose(model.weights(model.counts(TEXTS)).dense(), weights, rtol=1e-5)
    assert np.allclose(model(TEXTS), want, rtol=1e-4, atol=1e-6)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.embedding for r in model.embed(df).collect()}
    assert got[3] is None and got[2] == [0.0] * 4 and got[4] == [0.0] * 4
    for i in (0, 1, 2, 4, 5):
        assert np.allclose(got[i], want[i], rtol=1e-4, atol=1e-6)
    rows = {r.doc_id: r for r in model.features(df).collect()}
    assert len(rows) == len(TEXTS)
    for i in range(len(TEXTS)):
        dense = np.zeros(weights.shape[1])
        dense[rows[i].indices] = rows[i]["values"]
        assert np.allclose(dense, weights[i], rtol=1e-5)
    assert model.embed(df.limit(0)).collect() == []


def test_large_models_go_as_files(spark, monkeypatch):
    monkeypatch.setattr(embed, "BROADCAST_BYTES", 10)
    model = tiny()
    df = spark.createDataFrame([(0, TEXTS[0]), (1, TEXTS[1])], "doc_id bigint, text string")
    got = {r.doc_id: r.embedding for r in model.embed(df).collect()}
    assert np.allclose([got[0], got[1]], model(TEXTS[:2]), rtol=1e-4, atol=1e-6)


def test_relational_projection_agrees_with_the_kernel(spark):
    model = tiny()
    x = model.weights(model.counts(TEXTS))
    entries = spark.createDataFrame([(int(r), int(c), float(v)) for r in range(x.rows) for c, v in zip(x.columns[x.bounds[r] : x.bounds[r + 1]], x.values[x.bounds[r] : x.bounds[r + 1]], strict=True)], "doc_id bigint, idx int, weight double")
    weights = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(model.network.first())], "idx int, w array<float>")
    got = {r.doc_id: r.v for r in features.project(entries, weights, 6).collect()}
    want = network.sparse_times_dense(x, model.network.first())
    for d, v in got.items():
        assert np.allclose(v, want[d], rtol=1e-4, atol=1e-6)
    assert (want[[2, 3, 4]] == 0).all()


def test_sparse_kernels():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(50, 30)) * (rng.random((50, 30)) < 0.1)
    dense[[0, 7, 49]] = 0
    a, b, d = Sparse.of(dense), rng.normal(size=(30, 5)), rng.normal(size=(50, 5))
    assert np.allclose(network.sparse_times_dense(a, b), dense @ b)
    columns, rows = network.transposed_times(a, d)
    full = np.zeros((30, 5))
    full[columns] = rows
    assert np.allclose(full, dense.T @ d)
    old, network.GATHER = network.GATHER, 20
    try:
        assert np.allclose(network.sparse_times_dense(a, b), dense @ b)
    finally:
        network.GATHER = old


def test_lookup_keeps_the_last_of_equal_ngrams():
    rows = np.array([[1, 2], [3, 4], [1, 2]], np.uint32)
    model = embed.Lookup(rows)
    x = embed.count_known(model, np.array([1, 2, 3, 4]), np.array([0, 4]), 3)
    assert x.columns.tolist() == [1, 2] and x.values.tolist() == [1, 1]
    assert embed.count_known(embed.Lookup(np.zeros((0, 2), np.uint32)), np.array([1]), np.array([0, 1]), 0).rows == 1


def test_network_shapes():
    net = Network.random([5, 3, 2])
    assert net.input_dim == 5 and net.output_dim == 2 and net.dims == (5, 3)
    edge = np.sqrt(6 / 5)
    assert (net.layers[0] == np.random.default_rng(0).uniform(-edge, edge, (3, 5)).astype(np.float32)).all()
    for bad in ([np.zeros((2, 3))], [np.zeros((2, 3)), np.zeros((4, 5))]):
        with pytest.raises(ValueError):
            Network(bad)
    with pytest.raises(ValueError):
        embed.Embedder(STATE, np.zeros((2, 1), np.uint32), np.zeros(3, np.float32), net)


def test_save_and_load(tmp_path):
    model, path = tiny(), str(tmp_path / "m.npz")
    models.save(model, path)
    got = models.load(path)
    assert got.tokenizer == model.tokenizer and (got.ngrams == model.ngrams).all() and (got.idf == model.idf).all()
    assert all((a == b).all() for a, b in zip(got.network.layers, model.network.layers, strict=True))
    assert (got.max_ngram_length, got.embedding_dim) == (3, 4)
    with np.load(path) as f:
        data = dict(f)
    assert (data["ngram_hash_to_ngram_idx_keys"] == model.hashes()).all()
    np.savez(path, **(data | {"version": np.int64(999), "stray": np.zeros(1)}))
    with pytest.raises(NotImplementedError, match="999.*1"):
        models.load(path)


def test_export_and_verify(tmp_path):
    model, archive, folder = tiny(), str(tmp_path / "m.npz"), str(tmp_path / "out")
    models.save(model, archive)
    assert cli.main(["export", "--checkpoint", archive, "--output-dir", folder]) == 0
    assert cli.main(["verify", "--checkpoint", archive, "--export-dir", folder]) == 0
    got = models.import_folder(folder)
    assert (got.ngrams == model.ngrams).all() and np.array_equal(got(TEXTS), model(TEXTS))
    models.export(tiny(seed=3), folder)
    assert cli.main(["verify", "--checkpoint", archive, "--export-dir", folder]) == 1
    with open(os.path.join(folder, "config.json")) as f:
        config = json.load(f)
    with open(os.path.join(folder, "config.json"), "w") as f:
        json.dump(config | {"embedding_dim": 9}, f)
    with pytest.raises(ValueError, match="embedding_dim"):
        models.import_folder(folder)
    bad = models.state(model) | {"embedder.version": np.array([2])}
    with pytest.raises(NotImplementedError):
        models.from_state(bad)


def test_summaries(spark, tmp_path):
    docs = spark.createDataFrame([([1, 2, 1],), ([2, 2],)], "tokens array<bigint>")
    counts, totals = ngrams.count_token_ngrams(docs, longest=2), ngrams.totals(docs, longest=2)
    models.save_summary(counts, totals, str(tmp_path / "s"))
    back, total = models.load_summary(spark, str(tmp_path / "s"))
    want = sorted((r.ngram, r.n, r["count"]) for r in counts.collect())
    assert sorted((r.ngram, r.n, r["count"]) for r in back.collect()) == want and total.first().total == 8
    models.summary_to_archive(back, 8, str(tmp_path / "s.npz"), 2)
    again, seen = models.summary_from_archive(spark, str(tmp_path / "s.npz"))
    assert sorted((r.ngram, r.n, r["count"]) for r in again.collect()) == want and seen == 8
    with np.load(tmp_path / "s.npz") as f:
        assert (np.diff(f["approximate_counts"]) >= 0).all()


def test_initialize(spark):
    rows = [([1, 2], 2, 10), ([3, 4], 2, 25), ([5, 6], 2, 50), ([7, 8], 2, 100)]
    summary = spark.createDataFrame(rows, "ngram array<bigint>, n int, count bigint")
    model = embed.initialize(summary, STATE, [5, 4], 2.0, 10, seed=42)
    assert model.ngrams.tolist() == [[3, 4], [5, 6], [7, 8]] and [w.shape for w in model.network.layers] == [(5, 3), (4, 5)]
    assert (model.idf > 0).all() and model.idf[0] > model.idf[-1]
    with pytest.raises(ValueError):
        embed.initialize(summary, STATE, [5, 4], 100.0, 10)
    assert model.with_network(Network.random([3, 2, 7])).embedding_dim == 7


def test_arrays(tmp_path):
    for x in (np.arange(6, dtype=np.float32).reshape(2, 3), np.ones((1, 2), np.int32), np.ones((10, 128)), np.ones((3, 1), np.int64)):
        column = arrays.to_fixed_lists(x)
        assert np.array_equal(arrays.from_lists(column), x) and arrays.from_lists(column).dtype == x.dtype
        assert np.array_equal(arrays.from_lists(pa.chunked_array([column, column])), np.concatenate([x, x]))
    with pytest.raises(ValueError):
        arrays.from_lists(pa.array([[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError):
        arrays.to_fixed_lists(np.zeros(3))
    s = Sparse.of(np.array([[0, 1, 0], [2, 0, 3]], np.float32))
    arrays.save_sparse(str(tmp_path / "x.npz"), s)
    assert np.array_equal(arrays.load_sparse(str(tmp_path / "x.npz")).dense(), s.dense())
    np.savez(tmp_path / "y.npz", data=s.values, indices=s.columns, indptr=s.bounds, shape=np.array([2, 3]))
    assert np.array_equal(arrays.load_sparse(str(tmp_path / "y.npz")).dense(), s.dense())
    batch = arrays.sparse_to_batch(s)
    assert np.array_equal(arrays.sparse_from_batch(batch).dense(), s.dense())
    assert np.array_equal(arrays.sparse_from_batch(batch.slice(1)).dense(), s.dense()[1:])
    m = {12345: 100, 67890: 200, 123: 50}
    assert arrays.unpack_map(*arrays.pack_map(m)) == m
    with pytest.raises(ValueError):
        arrays.unpack_map(np.zeros(1), np.zeros(2))


def test_teacher(spark):
    from glyphmill.operators import teacher

    class Fake:
        def states(self, texts):
            s = np.zeros((len(texts), 3, 4), np.float32)
            s[:, 1] = [[len(t), 1, 2, 3] for t in texts]
            return s, np.array([[0, 1, 1]] * len(texts))

    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.embedding for r in teacher.embed_with(df, Fake, is_query=True, short=2).collect()}
    assert np.allclose(got[1], np.array([10, 1]) / np.sqrt(101)) and np.allclose(got[2], np.array([7, 1]) / np.sqrt(50))
    codes = {r.doc_id: r.embedding for r in teacher.embed_with(df, Fake, limit=0.3).collect()}
    v = np.array([3, 1, 2, 3]) / np.sqrt(23)
    assert codes[1] == teacher.quantize(v, 0.3).tolist() and max(codes[1]) == 255
    assert np.allclose(teacher.dequantize(np.array([0, 255]), 0.3), [-0.3, 0.3])


def test_pad_is_kept_for_wide_ngrams():
    wide = np.array([[5, np.iinfo(np.uint32).max], [np.iinfo(np.int64).max, 1]], np.int64)
    assert models._as_uint32(wide).tolist() == [[5, 2**32 - 1], [2**32 - 1, 1]]


def test_kernels_agree():
    from glyphmill.operators import network

    rng = np.random.default_rng(0)
    dense = rng.normal(size=(70, 40)) * (rng.random((70, 40)) < 0.2)
    dense[[0, 33, 69]] = 0
    got = network.compare_kernels(network.Sparse.of(dense.astype(np.float32)), rng.normal(size=(40, 19)).astype(np.float32), batches=(16, 64, 100), runs=1)
    assert len(got) == 3 * len(network.KERNELS) and all(r["close"] and r["seconds"] > 0 for r in got)
    assert np.allclose(network.by_dense(network.Sparse.of(dense), np.eye(40)), dense)
    assert network.compare_kernels(network.Sparse.of(np.zeros((0, 4))), np.zeros((4, 2)), runs=1)[0]["close"]
