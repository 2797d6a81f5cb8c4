import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import jaccard

SF = "/root/testdata/sf0.001"


def grams(text, n):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, threshold):
    sets = [(i, grams(t, n)) for i, t in rows if i is not None]
    out = {}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if i != j and a and b and (s := len(a & b) / len(a | b)) >= threshold:
                out[min(i, j), max(i, j)] = round(s, 6)
    return out


def test_band_plan_reaches_recall():
    for threshold in (0.3, 0.5, 0.8):
        bands, rows = jaccard.band_plan(threshold, 0.95)
        assert 1 - (1 - threshold**rows) ** bands >= 0.95


def classes(ids, pairs):
    """Smallest identifier of each one's connected component, and its number of partners."""
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def pairs_of(spark, df, **kw):
    """All pairs of documents from the pairs of representatives and the membership."""
    pairs, members = jaccard.representative_pairs(df, **kw)
    by = {}
    for r in members.collect():
        by.setdefault(r.fp, []).append(r.doc_id)
    out = {}
    for own in by.values():
        out.update({(a, b): 1.0 for a in own for b in own if a < b})
    for r in pairs.collect():
        out.update({(min(a, b), max(a, b)): r.jaccard for a in by[r.a] for b in by[r.b]})
    return out


def found_of(df, **kw):
    return {r.doc_id: (r.class_id, r.links) for r in jaccard.jaccard_join(df, **kw).collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 3, 0.5)
    got = pairs_of(spark, docs)
    assert len(want) > 3
    assert all(abs(want[k] - v) < 1e-4 for k, v in got.items())
    assert len(got) >= 0.95 * len(want)
    rows_out = jaccard.op9_jaccard_join(spark, SF).collect()
    assert len(rows_out) == len(rows)
    assert {r.doc_id: (r.class_id, r.links) for r in rows_out} == classes([i for i, _ in rows], got)


def families(seed=3, count=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for f in range(count):
        base = [rng.choice(words) for _ in range(80)]
        for k in range(rng.choice([1, 2, 7])):
            own = [w if rng.random() > 0.03 * k else rng.choice(words) for w in base]
            rows.append((len(rows), " ".join(own)))
            if k == 1:
                rows.append((len(rows), " ".join(own).upper()))
    return rows


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_families(spark, block):
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 0.5)
    got = pairs_of(spark, df, block=block)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 10
    assert found_of(df, block=block) == classes([i for i, _ in rows], got)


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.5 to 0.55: the share that the banding promises, with the error of 400 draws."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(400):
        base = [rng.choice(words) for _ in range(120)]
        at = rng.randrange(35, 41)
        own = [*base[:-at], *[rng.choice(words) for _ in range(at)]]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(own))]
    want = []
    for a in range(0, 800, 2):
        x, y = grams(rows[a][1], 3), grams(rows[a + 1][1], 3)
        if 0.5 <= len(x & y) / len(x | y) < 0.55:
            want.append((a, a + 1))
    got = pairs_of(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(want) > 100 and len([k for k in want if k in got]) >= 0.95 * len(want) - 3 * (0.05 * 0.95 * len(want)) ** 0.5


def test_first_band_and_keys_agree():
    """Values that agree in an earlier band give the same key there, whatever the 32-bit minima were."""
    import numpy as np

    rng = np.random.default_rng(0)
    sig = rng.integers(0, 3, (400, 12)).astype(np.uint16)
    keys = jaccard.band_keys(sig, 4, 3)
    for a, b in rng.integers(0, 400, (500, 2)):
        assert ((sig[a] == sig[b]).reshape(4, 3).all(1) == (keys[a] == keys[b])).all()
    assert ((keys & np.uint64(127)) == np.arange(4)).all()


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
def test_blocks_in_batches_of_any_size(cut):
    import pyarrow as pa

    rng = random.Random(cut)
    key = sorted(k for k in range(60) for _ in range(rng.choice([1, 1, 2, 3, 40])))
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(range(len(key)))], names=["key", "fp"])
    batches = (whole.slice(lo, cut) for lo in range(0, len(key), cut))
    got = [tuple(r.values()) for b in jaccard._numbered(batches, 4) for r in b.to_pylist()]
    first = {k: key.index(k) for k in set(key)}
    assert got == [(k, i, (i - first[k]) // 4) for i, k in enumerate(key) if key.count(k) > 1]


def test_hot_bucket(spark):
    """Half of the rows are different texts that share most of their n-grams, so buckets hold half of the table, and
    a quarter are copies of one text."""
    rng = random.Random(8)
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(300)] + [(300 + i, "one and the same text for all of them") for i in range(150)]
    rows += [(450 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for i in range(150)]
    rng.shuffle(rows)
    got = found_of(spark.createDataFrame(rows, "doc_id long, text string"), block=64)
    assert all(got[i] == (0, 299) for i in range(300)) and all(got[i] == (300, 149) for i in range(300, 450)) and all(got[i] == (i, 0) for i in range(450, 600))


def test_edge_rows(spark):
    long = " ".join(f"x{i % 997}" for i in range(200_000))
    rows = [(1, None, 5), (2, "", 5), (3, "a b", 5), (4, "A, b!", 5), (5, "a b c", 5), (None, "a b", 5), (6, "... !!", 5), (7, long, None), (8, long + " end", 5), (9, "a b", 5), (9, "a b", 5), (None, "alone", 1), (5, "others", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("fp", F.lit(1)).withColumn("keys", F.lit("k")).withColumn("row", F.lit("r"))
    got = sorted(((r.doc_id, r.class_id, r.links) for r in jaccard.jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 4), (4, 3, 4), (5, 5, 0), (None, 3, 4), (6, 6, 0), (7, 7, 1), (8, 7, 1), (9, 3, 4), (9, 3, 4), (None, None, 0), (5, 5, 0)], key=str)
    assert jaccard.jaccard_join(df.limit(0)).collect() == []
    kept = jaccard.without_near_duplicates(df)
    assert kept.schema == df.schema and jaccard.without_near_duplicates(df.limit(0)).collect() == []
    assert sorted((str(r.doc_id), (r.text or "")[:6]) for r in kept.collect()) == [("1", ""), ("2", ""), ("3", "a b"), ("5", "a b c"), ("5", "others"), ("6", "... !!"), ("7", "x0 x1 "), ("None", "alone")]


def test_repeated_rows_leave_one(spark):
    rows = [(1, "one two three four", {"a": 1})] * 5 + [(None, "five six seven", None)] * 3 + [(2, "eight nine ten", None), (2, "eleven twelve more", None), (3, "ONE two three, four", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    kept = jaccard.without_near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "one two three four"), ("2", "eight nine ten"), ("2", "eleven twelve more"), ("None", "five six seven")]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 6), (6, 7), (7, 8), (3, 9)], [(i, i + 1) for i in range(1, 40)], [(4, 4)], []])
def test_components(spark, edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_a_key_of_more_than_two_gigabytes_stays_whole():
    import numpy as np
    import pyarrow as pa

    rows, size = 900, 1_000_000
    offsets = pa.py_buffer((np.arange(rows + 1) * size).astype(np.int32).tobytes())
    grams = pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(bytes(rows * size))])
    batch = pa.RecordBatch.from_arrays([pa.array([7] * rows), grams], names=["key", "grams"])
    assert [b.num_rows for b in jaccard._by_key(iter([batch] * 3))] == [3 * rows]
