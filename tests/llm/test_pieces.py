import random
import time

import numpy as np
import pytest

from glyphmill.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def brute(model, text, n):
    """Scores of the n best segmentations, from all of them."""
    memo = {0: [0.0]}
    for e in range(1, len(text) + 1):
        memo[e] = []
        for s in range(e):
            i = model.usable.get(text[s:e], -1)
            if i >= 0 or e - s == 1:
                memo[e] += [v + (model.score[i] if i >= 0 else model.unk_score) for v in memo[s]]
    return sorted(memo[len(text)], reverse=True)[:n]


def score_of(model, ids):
    total, k = 0.0, 0
    while k < len(ids):
        if model.is_byte[ids[k]]:
            first = int(model.pieces[ids[k]][3:5], 16)
            k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total += model.unk_score
        else:
            total += model.score[ids[k]]
            k += 1
    return total


TEXTS = ["Hello world", "a", " a  b ", "x\ny", "\n\n z", "thhaheti, ing.", "é ü 你 𓀀", "  ", "\n", "tab\there", "mm" * 6, "the\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_nbest_against_all_segmentations(model, text):
    for n in (1, 3, 6):
        ids, bounds, scores, others = pieces.Encoder(model, n)([text])
        want = brute(model, pieces.SPACE + text.replace(" ", pieces.SPACE), n)
        assert scores[0] == want
        paths = [ids.tolist()]
        for o in others[0]:
            p = ids.tolist()
            for e in sorted(o["edits"], key=lambda e: -e["start"]):
                p[e["start"] : e["end"]] = e["ids"]
            paths.append(p)
        assert [score_of(model, p) for p in paths] == scores[0]
        assert len({tuple(p) for p in paths}) == len(paths)
        raw, ends = pieces.Decoder(model)(ids, bounds)
        assert raw.tobytes() == (" " + text).encode()


def test_viterbi_agrees_with_search(model):
    rng = random.Random(1)
    chunks = ["▁" + "".join(rng.choice("thenaiorsé,.Q") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    ids, bounds, score, gap = pieces.best_paths(model, chunks)
    for k, c in enumerate(chunks):
        two = pieces.nbest(model, c, 2)
        assert two[0][0] == score[k] and two[0][0] - two[1][0] == gap[k]
        path, s, g = pieces.long_path(model, c)
        assert (path, s, g) == (ids[bounds[k] : bounds[k + 1]].tolist(), score[k], gap[k])


@pytest.mark.parametrize("unit", ["-", "a", "=", " ", "ab", "你"])
def test_short_runs_against_all_segmentations(model, unit):
    for size in range(1, 15):
        text = (unit * size)[:14]
        _, _, scores, others = pieces.Encoder(model, 5)([text])
        want = brute(model, pieces.SPACE + text.replace(" ", pieces.SPACE), 5)
        assert scores[0] == pytest.approx(want, abs=1e-6) and len(others[0]) == len(scores[0]) - 1


@pytest.mark.parametrize("text", ["-" * 100_000, " " * 100_000, "ab" * 50_000, "\n" * 50_000, "=-" * 400 + " x"], ids=["dashes", "blanks", "letters", "breaks", "mixed"])
def test_long_runs_take_seconds(model, text):
    began = time.perf_counter()
    ids, bounds, scores, others = pieces.Encoder(model, 4)([text])
    assert time.perf_counter() - began < 30
    many = 1 if text[0] == "\n" else 4  # a line break has no other segmentation
    assert len(scores[0]) == many and scores[0] == sorted(scores[0], reverse=True)
    raw, _ = pieces.Decoder(model)(ids, bounds)
    assert raw.tobytes() == (" " + text).encode()
    paths = {tuple(ids.tolist())}
    for o in others[0]:
        p = ids.tolist()
        for e in sorted(o["edits"], key=lambda e: -e["start"]):
            p[e["start"] : e["end"]] = e["ids"]
        paths.add(tuple(p))
        assert pieces.Decoder(model)(np.array(p), np.array([0, len(p)]))[0].tobytes() == (" " + text).encode()
    assert len(paths) == many


def by_sums(model, text, n):
    """Scores of the n best segmentations by keeping n for every place of the whole text."""
    best = [[0.0]]
    for e in range(1, len(text) + 1):
        own = []
        for s in range(max(0, e - model.longest), e):
            i = model.usable.get(text[s:e], -1)
            if i >= 0 or e - s == 1:
                own += [v + (model.score[i] if i >= 0 else model.unk_score) for v in best[s]]
        best.append(sorted(own, reverse=True)[:n])
    return best[-1]


def test_whole_table_scores_against_brute_force(spark, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op6_sentencepiece(spark, SF).collect():
        t = texts[r.doc_id]
        assert r.scores == pytest.approx(by_sums(model, pieces.SPACE + t.replace(" ", pieces.SPACE), pieces.NBEST), rel=1e-12)
        for score, p in zip(r.scores, [r.ids, *[_edited(r.ids, o.edits) for o in r.alternatives]], strict=True):
            assert score_of(model, p) == pytest.approx(score, rel=1e-12)


def _edited(ids, edits):
    out = list(ids)
    for e in sorted(edits, key=lambda e: -e.start):
        out[e.start : e.end] = e.ids
    return out


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pieces.op6_sentencepiece(spark, SF)
    assert out.where("round_trip").count() == out.count() == docs.count()
    back = pieces.decode(out)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0
    assert out.where("size(scores) <> size(alternatives) + 1 OR size(ids) <> n_pieces").count() == 0


def test_edge_rows(spark):
    huge = "ab" * 2000 + " " + "word " * 30_000
    rows = [(1, None), (2, ""), (3, "a▁b"), (None, "hi"), (4, "same"), (4, "same"), (5, huge)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS scores")
    got = {(r.doc_id, r.round_trip): r for r in pieces.encode(df).collect()}
    assert got[1, None].ids is None and got[1, None].n_pieces is None and got[1, None].scores is None
    assert got[2, True].ids == [] and got[2, True].scores == [] and got[2, True].n_pieces == 0
    assert got[3, False].ids and got[None, True].ids and got[5, True].n_pieces > 30_000
    assert pieces.encode(df).where("doc_id = 4").distinct().count() == 1
    text = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df)).collect()}
    assert text[1] is None and text[2] == "" and text[3] == "a b" and text[5] == huge
    assert pieces.encode(df.limit(0)).collect() == []
