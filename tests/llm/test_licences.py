import random
import time

import numpy as np
import pytest

from glyphmill.llm import licences

SF = "/root/testdata/sf0.001"


def end_errors(pattern, text):
    """Least errors of a match of the pattern that ends after each character, by the plain table of distances."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(len(chars) + 1)
    row = np.zeros(len(chars) + 1, np.int32)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (chars != ord(c)))
        row = np.minimum.accumulate(new - at) + at
    return row


def brute(text, own):
    """All spans within the bound; of overlapping ones of a notice the fewest errors, the first end, the longest."""
    low = licences.folded(text or "")
    found = []
    for n in own:
        spans = []
        for end in np.flatnonzero(end_errors(n.text, low)[1:] <= n.errors) + 1:
            for start in range(max(0, end - len(n.text) - n.errors), end - len(n.text) + n.errors + 1):
                if start >= 0 and (e := distance(low[start:end], n.text)) <= n.errors:
                    spans.append((e, int(end), start))
        taken = []
        for e, end, start in sorted(spans):
            if all(end <= a or start >= b for a, b, _ in taken):
                taken.append((start, end, e))
        found += [(*m, n) for m in taken]
    out = []
    for a, b, n, notice in sorted(found, key=lambda x: (x[2] / len(x[3].text), x[0] - x[1], x[0], x[3].name)):
        if all(b <= x or a >= y for x, y, _, _ in out):
            out.append((a, b, n, notice.name))
    return sorted(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_edited_notices_against_brute_force(seed):
    rng = random.Random(seed)
    own = licences.notices()
    finder = licences.Finder(own)
    planted, text = [], "start of text. "
    for n in rng.sample(own, 8):
        t = list(n.text if rng.random() < 0.5 else n.text.upper())
        for _ in range(rng.randrange(n.errors + 1)):
            k = rng.randrange(len(t))
            rng.choice([lambda: t.pop(k), lambda: t.insert(k, "z"), lambda: t.__setitem__(k, "#")])()
        planted.append((len(text), n))
        text += "".join(t) + " thing and other words of text. "
    got = finder(text)
    assert got == brute(text, own)
    by = {n.name: n for n in own}
    for a, b, errors, name in got:
        assert distance(text[a:b].lower(), by[name].text) == errors <= by[name].errors
    for at, n in planted:
        assert any(a < at + len(n.text) and b > at for a, b, _, _ in got)


def test_too_many_errors():
    assert licences.Finder()("a11 r1ghts r3s3rv3d") == []


def test_whole_table_against_brute_force(spark):
    """All texts and all notices."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    own = licences.notices()
    got = {}
    for r in licences.op10_license_scan(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.errors, r.license))
    assert got
    for r in docs:
        assert sorted(got.get(r.doc_id, [])) == brute(r.text, own)


def test_edge_rows(spark):
    line, huge = "All rights reserved.", "word " * 100_000
    rows = [(1, None), (2, ""), (3, line), (None, line), (4, line), (4, line), (5, huge + "Released under the MIT licence"), (6, line + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license", "0 AS errors")
    got = [(r.doc_id, r.license, r.start, r.errors) for r in licences.find_notices(df).collect()]
    a = "All-Rights-Reserved"
    assert sorted(got, key=str) == sorted([(3, a, 0, 0), (None, a, 0, 0), (4, a, 0, 0), (4, a, 0, 0), (5, "MIT", 500_000, 1), (6, a, 0, 0), (6, a, 20, 0)], key=str)
    assert licences.find_notices(df.limit(0)).collect() == []


@pytest.mark.parametrize("errors", [0, 4, 7, 10])
def test_long_notices_with_many_errors(errors):
    """The notices that are allowed most errors, edited up to the bound and wrapped in comments."""
    rng = random.Random(errors)
    for name in ("BSD", "ISC", "MIT-text", "Unlicense"):
        own = [n for n in licences.notices() if n.name == name]
        t = list(own[0].text)
        for k in rng.sample(range(2, len(t) - 2), min(errors, own[0].errors)):
            t[k] = "#"
        text = "x y z " + "".join(t) + " q r"
        assert licences.Finder(own)(text) == brute(text, own) == [(6, 6 + len(t), min(errors, own[0].errors), name)]
    wrapped = " * redistribution and use in source and binary forms, with\n * or without modification, are permitted"
    assert [x[3] for x in licences.Finder()(wrapped)] == ["BSD"]


@pytest.mark.parametrize("text", ["all rights reserved " * 5000, "licensed under " * 6000, "redistribution and use in " * 4000, "all rights reserved" * 3000])
def test_repeated_pieces_take_seconds(text):
    finder = licences.Finder()
    began = time.perf_counter()
    finder(text)
    assert time.perf_counter() - began < 20
    assert finder(text[:400]) == brute(text[:400], licences.notices())


def test_own_notices(spark):
    df = spark.createDataFrame([(1, "This is Our Own Notice, kept."), (2, "nothing")], "doc_id long, text string")
    got = licences.find_notices(df, texts={"own": "our own notice"}, per_error=7).collect()
    assert [(r.doc_id, r.license, r.start, r.end, r.errors) for r in got] == [(1, "own", 8, 22, 0)]
