import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import hashing, subword, text, vectors

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_text_functions(spark):
    rows = [(1, "A\r\nb  C \n"), (2, None), (3, ""), (4, "Zürich 12")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in df.select("id", text.words(F.col("text")).alias("w"), text.normalize_line(F.col("text")).alias("n"), text.byte_length(F.col("text")).alias("b")).collect()}
    assert got[1].w == ["a", "b", "c"] and got[1].n == "a <new_line> b c <new_line>"
    assert got[2].w is None and got[2].n is None and got[2].b is None
    assert got[3].w == [] and got[3].n == "" and got[3].b == 0
    assert got[4].w == ["zürich", "12"] and got[4].b == 10


def test_labels_and_limits(spark):
    df = spark.createDataFrame([("__label__3", "x_scale_0dot3"), ("3", "x"), ("__label__x", "scale_2"), (None, None)], "l string, p string")
    got = [tuple(r) for r in df.select(text.parse_label(F.col("l")), text.limit_from_path(F.col("p"))).collect()]
    assert got == [(3, 0.3), (None, None), (None, 2.0), (None, None)]


def test_vectors(spark):
    v = [[3.0, -4.0, 0.0], [0.0, 0.0, 0.0], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v array<float>")
    got = df.orderBy("id").select(vectors.l2_normalize(F.col("v")).alias("n"), vectors.relu(F.col("v")).alias("r"), vectors.truncate_and_normalize(F.col("v"), 1).alias("t")).collect()
    assert got[0].n == [0.6, -0.8, 0.0] and got[0].r == [3.0, 0.0, 0.0] and got[0].t == [1.0]
    assert got[1].n == [0.0, 0.0, 0.0] and got[1].t == [0.0]
    assert got[2].n is None and got[2].r is None


def test_quantize_is_numpys(spark):
    limit = 0.5
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(-0.7, 0.7, (40, 16)), [(np.arange(16) + 0.5) / 255 - 0.5]]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<float>")
    df = df.select("id", vectors.quantize(F.col("v"), limit).alias("q")).withColumn("d", vectors.dequantize(F.col("q"), limit))
    got = df.orderBy("id").collect()
    want = np.rint(np.clip(limit + x.astype(np.float64), 0, 2 * limit) / (2 * limit / 255)).astype(int)
    assert (np.array([r.q for r in got]) == want).all()
    back = np.float32(-limit) + np.float32(2 * limit / 255) * want.astype(np.float32)
    assert (np.array([r.d for r in got], np.float32) == back).all()
    inside = np.abs(x) <= limit
    assert np.abs(back - x)[inside].max() <= limit / 255 + 1e-6


def test_first_unmasked(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0, 1]), ([1.0, 2.0], [0, 0])], "s array<double>, m array<int>")
    assert [r[0] for r in df.select(vectors.first_unmasked(F.col("s"), F.col("m"))).collect()] == [2.0, None]


@pytest.mark.parametrize(("width", "dtype"), [(4, np.uint32), (2, np.uint16), (8, np.int64)])
def test_fnv(spark, width, dtype):
    top = min(np.iinfo(dtype).max, 1 << 62)
    grams = [[1], [1, 2, 3], [top - 1, 0, 5], [7, 7]]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "id int, g array<bigint>")
    rows = hashing.pad_rows(grams, 3, dtype)
    want = [fnv(r.tobytes()) for r in rows]
    assert [r[0] for r in df.orderBy("id").select(hashing.fnv1a(F.col("g"), 3, width)).collect()] == want
    assert hashing.fnv1a_rows(rows).tolist() == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 2), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fnv_numpy(grams):
    rows = hashing.pad_rows(grams, 4)
    assert hashing.fnv1a_rows(rows).tolist() == [fnv(r.tobytes()) for r in rows]


def test_subword_tokens(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    rows = [(1, "Hello there, world!", "x"), (2, None, "y"), (3, "", "z"), (4, "<|endoftext|> is text here", "w")]
    df = spark.createDataFrame(rows, "id int, text string, other string")
    got = {r.id: r for r in subword.tokenize(df, subword.read_state(TOKENIZER)).collect()}
    for i, t, other in rows:
        assert got[i].tokens == (None if t is None else own.encode(t, add_special_tokens=False).ids) and got[i].other == other
    total = subword.token_totals(subword.tokenize(df, subword.read_state(TOKENIZER))).first()
    assert total.docs == 2 and total.tokens == sum(len(r.tokens or []) for r in got.values())
    assert subword.tokenize(df.limit(0), subword.read_state(TOKENIZER)).collect() == []


def test_tokenizer_state_must_be_one():
    with pytest.raises(ValueError):
        subword.load("{}")


def test_norm_is_bound_once(spark):
    plan = spark.range(1).select(vectors.l2_normalize(F.array(F.lit(1.0), F.lit(2.0))).alias("v")).first()
    assert math.isclose(plan.v[0], 1 / math.sqrt(5))


def test_words_that_recur_are_encoded_as_whole_texts_are():
    import pyarrow.parquet as pq

    own = subword.load(subword.read_state(TOKENIZER))
    assert subword.splits_at_space(own.to_str())
    assert not subword.splits_at_space(subword.read_state("/opt/tokenizers/byte_bpe_50k.json"))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    texts += [None, "", " ", "\n\n", "a b\tc  d\r\n", "é ́x", "don't 'S", "<|endoftext|> <|end oftext|>", " x\x1cy", "ΑΣ ΣΑΣ", "x" * 5000]
    for _ in range(2):
        flat, bounds = subword.encode(own, texts)
        whole, ends = subword.encode_whole(own, texts)
        assert (bounds == ends).all() and (flat == whole).all()
    words = subword.Words(own)
    old, subword.MEMORY = subword.MEMORY, 5
    try:
        for t in texts[:20]:
            assert words([t])[0].tolist() == own.encode(t, add_special_tokens=False).ids
    finally:
        subword.MEMORY = old
