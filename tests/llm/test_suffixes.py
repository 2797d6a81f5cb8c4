import random
import re
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import suffixes


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def brute(rows, length):
    at = Counter()
    for _, t in rows:
        w = words(t)
        at.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = set()
    for d, t in rows:
        w = words(t)
        spans = []
        for i in range(len(w) - length + 1):
            if at[tuple(w[i : i + length])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out |= {(d, a, b) for a, b in spans}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 3 if seed % 2 else 400, 700)
    text[300:400] = text[:100]
    depth = 60
    order = suffixes.suffix_order(text, depth).tolist()
    keys = [tuple(text[i : i + depth].tolist()) for i in order]
    assert sorted(order) == list(range(700)) and keys == sorted(keys)


@pytest.mark.parametrize("length,q,hot", [(6, 2, suffixes.HOT), (9, 4, 3), (9, 4, 0), (50, 8, suffixes.HOT)])
def test_against_brute_force(spark, length, q, hot):
    rng = random.Random(length)
    passages = [[f"p{k}x{rng.randrange(9)}" for _ in range(length + rng.randrange(20))] for k in range(5)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += [f"w{rng.randrange(4 if d % 7 == 0 else 3000)}" for _ in range(rng.randrange(40))]
            if rng.random() < 0.5:
                p = rng.choice(passages)
                w += p[rng.randrange(3) :]
        rows.append((d, " ".join(w)))
    rows.append((60, "go " * 200))
    got = {tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), length=length, q=q, hot=hot).collect()}
    assert got == brute(rows, length) and got


def test_edge_rows(spark):
    p = " ".join(f"t{i}" for i in range(60))
    huge = " ".join(f"h{i}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, p), (4, "start, " + p.upper() + "!"), (None, p), (5, "..."), (6, huge), (7, p), (7, p), (8, "tail " + huge)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS hot", "'x' AS lo")
    got = sorted(tuple(r) for r in suffixes.repeated_passages(df).collect())
    assert got == [(3, 0, 60), (4, 1, 61), (6, 0, 150_000), (7, 0, 60), (8, 1, 150_001)]
    assert suffixes.repeated_passages(df.limit(0)).collect() == []


def test_string_identifiers(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("a", words), ("b", "x " + words)], "doc_id string, text string")
    assert sorted(map(tuple, suffixes.repeated_passages(df).collect())) == [("a", 0, 60), ("b", 1, 61)]


def test_a_passage_that_half_of_the_texts_have(spark):
    """Its minimizers have hundreds of segments, each with other words around it."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    own = lambda: [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
    rows = [(d, " ".join([*own(), *(passage if d % 2 else []), *own()])) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 50)
    for hot in (20, suffixes.HOT):
        assert {tuple(r) for r in suffixes.repeated_passages(df, hot=hot).collect()} == want
    assert len(want) == 200


def test_many_hot_minimizers(spark, monkeypatch):
    """More hot minimizers than are broadcast: the same spans."""
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 0)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join([*[f"w{rng.randrange(10**6)}" for _ in range(20)], *(passage if d % 3 else [])])) for d in range(60)]
    got = {tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=3).collect()}
    assert got == brute(rows, 50) and len(got) == 40
