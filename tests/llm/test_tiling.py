import random
import re
import time

import pytest

from glyphmill.llm import tiling

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def brute_tiles(item, text, k):
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best, found = k, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best or (n == best and not found):
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = b[j : j + best] = [True] * best
                out.append((i, j, best))


def brute(docs, items, k, share):
    out = set()
    for d, t in docs:
        for i, s in items:
            x, y = words(s), words(t)
            if len(x) >= k and any(tuple(x[p : p + k]) in {tuple(y[q : q + k]) for q in range(len(y))} for p in range(len(x))):
                got = brute_tiles(x, y, k)
                n = sum(m for _, _, m in got)
                if n >= share * len(x) and n:
                    out.add((d, i, round(n / len(x), 6), len(got), max(m for _, _, m in got)))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tiles(seed):
    rng = random.Random(seed)
    item = [rng.randrange(1, 4) for _ in range(40)]
    text = [rng.randrange(1, 4) for _ in range(60)] + item[20:35] + [9] + item[:12]
    assert tiling.tiles(item, text, 3) == brute_tiles(item, text, 3)


@pytest.mark.parametrize("item,text", [([1] * 200, [1] * 8000), ([1, 2] * 100, [1, 2] * 5000), ([1] * 2000, [1] * 2000), ([1] * 7, [1] * 6 + [2] + [1] * 7)], ids=["equal", "pairs", "long", "short"])
def test_tied_tokens_take_seconds(item, text):
    began = time.perf_counter()
    got = tiling.tiles(item, text, 5)
    assert time.perf_counter() - began < 5
    assert sum(n for _, _, n in got) == len(item)
    assert tiling.tiles(item[:30], text[:50], 5) == brute_tiles(item[:30], text[:50], 5)


@pytest.mark.parametrize("seed", range(30))
def test_tied_tiles(seed):
    rng = random.Random(seed)
    item, text = ([rng.choice([1, 1, 1, 2]) for _ in range(rng.randrange(5, 30))] for _ in "ab")
    assert tiling.tiles(item, text, 2) == brute_tiles(item, text, 2)


def test_filter_has_every_seed(spark):
    rng = random.Random(4)
    seeds = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)]
    for bits in (8, 18, 20):
        flags = tiling.seed_filter(spark.createDataFrame([(x,) for x in seeds], "seed long").repartition(5), bits)
        on = {i for i in range(1 << bits) if flags[i >> 3] >> (7 - (i & 7)) & 1}
        assert on == {(x & (1 << 64) - 1) >> (64 - bits) for x in seeds}
    assert not tiling.seed_filter(spark.createDataFrame([], "seed long"), 18).any()


def _corpus():
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randrange(3, 50)))) for i in range(15)]
    docs = []
    for d in range(60):
        w = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(60))]
        if d % 2:
            p = rng.choice(items)[1].split()
            cut = rng.randrange(len(p))
            w[10:10] = p[cut:] + ["zz"] * (d % 3) + p[:cut]
        docs.append((d, " ".join(w)))
    return docs, items


def test_both_ways_against_brute_force(spark):
    docs, items = _corpus()
    want = brute(docs, items, 5, 0.6)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 0):
        got = {tuple(r) for r in tiling.contaminated(a, b, broadcast_chars=chars).collect()}
        assert got == want
    assert any(n > 1 for _, _, _, n, _ in want)


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {tuple(r) for r in tiling.op2_decontaminate(spark, SF).collect()}
    assert got == brute(docs, items, tiling.MIN_MATCH, tiling.COVERAGE) and got


@pytest.mark.parametrize("chars", [10**6, 0])
def test_edge_rows(spark, chars):
    item = " ".join(f"q{i}" for i in range(20))
    turned = " ".join([f"q{i}" for i in range(10, 20)] + ["and"] + [f"q{i}" for i in range(10)])
    huge = " ".join(f"h{i}" for i in range(150_000)) + " " + item
    rows = [(1, None), (2, ""), (3, item.upper()), (4, turned), (None, item), (5, "q1 q2 q3 q4 q5 q6"), (6, huge), (7, item), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS item_text", "3 AS seed")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "q1 q2")], "item_id long, text string").selectExpr("*", "0 AS doc_id")
    got = sorted(tuple(r) for r in tiling.contaminated(docs, bench, broadcast_chars=chars).collect())
    assert got == [(3, 1, 1.0, 1, 20), (4, 1, 1.0, 2, 10), (6, 1, 1.0, 1, 20), (7, 1, 1.0, 1, 20), (7, 1, 1.0, 1, 20)]
    assert tiling.contaminated(docs.limit(0), bench, broadcast_chars=chars).collect() == []
    assert tiling.contaminated(docs, bench.limit(0), broadcast_chars=chars).collect() == []
    left = tiling.decontaminate(docs, bench, broadcast_chars=chars)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "5"]  # the row without identifier holds the item
    more = spark.createDataFrame([(3, "a clean text of the same number"), (3, item), (None, "clean"), (8, None)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in tiling.decontaminate(more, bench, broadcast_chars=chars).collect()}
    assert kept == {(3, "a clean text of the same number"), (None, "clean"), (8, None)}
