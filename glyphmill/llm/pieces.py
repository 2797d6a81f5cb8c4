"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A model file gives pieces and scores. A text's lattice has an edge for every occurrence of a piece, and for every
character that no piece has an edge scored below all pieces, which becomes the bytes of that character. The score of
a segmentation is the sum of its pieces' scores.

Forward Viterbi gives the best score from the start to every place. These are exact heuristics for A-star from the
end of the text: the estimate of a partial path is the true score of its best completion, so complete paths come
out in order of their scores and nothing else is expanded.

No piece spans the place before a space or line break, so a text's lattice is a chain of chunks, each a run of
spaces with the word after it or a line break with what follows. Chunks recur, so the Viterbi pass runs once for all
chunks of a slice that weren't met before, vectorised over all of them, and also keeps the gap to each chunk's second
best path. The N best segmentations of a text differ from the best only in the N - 1 chunks with the smallest gaps:
changing another chunk costs at least as much as each of N - 1 single changes. So one A-star runs backwards over the
chain of those chunks, all others being passed on their best path.

Since the heuristic is exact, the first branch of an expansion continues the path that is expanded and every other
branch is another path whose final score is known at once. Branches that don't beat the N best known so far are
dropped, and of equal scores the search follows the branch it made last, so a run of equal characters, with its
exponential number of equally good paths, takes a number of steps proportional to its length.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb
from .common import lean, plain, table

MODEL, NBEST = "/opt/tokenizers/piece_bpe_32k.model", 4
SPACE = "▁"
#: Chunks that a worker remembers before it starts anew.
MEMORY = 300_000
#: Characters above which a chunk is handled on its own.
LONG = 64
_CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


@dataclass
class Model:
    """Pieces, their scores, byte pieces by value, and hash tables of the pieces and of all their prefixes."""

    pieces: list[str]
    score: np.ndarray
    is_byte: np.ndarray
    usable: dict[str, int]
    byte_id: list[int]
    unk: int
    unk_score: float
    longest: int
    chained: bool
    prefix_hash: np.ndarray
    prefix_piece: np.ndarray
    slot: np.ndarray
    rest: np.ndarray
    rest_at: np.ndarray


def load(path: str = MODEL) -> Model:
    """Read a model file. Only models that leave text as it is but for spaces and put one space before it are
    supported; for others the file's normaliser would have to run first."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rule = proto.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
        raise ValueError("the model normalises text in a way that isn't supported")
    kinds = [p.type for p in proto.pieces]
    pieces = [p.piece for p in proto.pieces]
    score = np.array([p.score for p in proto.pieces], np.float64)
    usable = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (1, 4)}
    byte_id = [-1] * 256
    for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
        if k == 6:
            byte_id[int(p[3:5], 16)] = i
    if -1 in byte_id:
        raise ValueError("the model has no byte pieces, so it can't encode every text")
    prefixes: dict[str, int] = {}
    for p, i in usable.items():
        for k in range(1, len(p)):
            prefixes.setdefault(p[:k], -1)
        prefixes[p] = i
    keys = sorted(prefixes, key=len)
    hashes = np.zeros(len(keys), np.uint64)
    sizes = np.array([len(k) for k in keys])
    chars = np.zeros((len(keys), int(sizes.max())), np.uint64)
    chars[np.arange(chars.shape[1]) < sizes[:, None]] = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
    with np.errstate(over="ignore"):
        for c in range(chars.shape[1]):
            on = sizes > c
            hashes[on] = tb.mix(hashes[on] * _P + chars[on, c])
    order = np.argsort(hashes)
    hashes, piece = hashes[order], np.array([prefixes[k] for k in keys], np.int64)[order]
    at = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
    slot = np.full(1 << _SLOTS, -1, np.int32)
    slot[at[::-1]] = np.arange(len(hashes))[::-1]  # the first of those that share a slot
    more = np.flatnonzero(slot[at] != np.arange(len(hashes)))
    return Model(
        pieces=pieces,
        score=score,
        is_byte=np.array([k == 6 for k in kinds]),
        usable=usable,
        byte_id=byte_id,
        unk=-1,
        unk_score=float(min(score[i] for i in usable.values()) - 10),
        longest=max(map(len, usable)),
        chained=not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in usable),
        prefix_hash=hashes,
        prefix_piece=piece,
        slot=slot,
        rest=hashes[more],
        rest_at=more,
    )


_models: dict[str, Model] = {}


def cached(path: str) -> Model:
    if path not in _models:
        _models[path] = load(path)
    return _models[path]


def _find(model: Model, h: np.ndarray) -> np.ndarray:
    """Place of each hash among the prefixes, -1 where it is none."""
    at = model.slot[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)].astype(np.int64)
    missed = np.flatnonzero((at >= 0) & (model.prefix_hash[at] != h))
    if len(missed):
        k = np.searchsorted(model.rest, h[missed])
        k[k == len(model.rest)] = 0
        at[missed] = np.where(model.rest[k] == h[missed], model.rest_at[k], -1) if len(model.rest) else -1
    return at


def lattice(model: Model, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and piece of all edges for code points of many chunks; ``end`` is each character's chunk end.
    Piece -1 marks a character that no piece has."""
    starts, sizes, ids = [], [], []
    at = np.arange(len(chars))
    with np.errstate(over="ignore"):
        h = tb.mix(chars.astype(np.uint64))
        for size in range(1, model.longest + 1):
            place = _find(model, h)
            piece = np.where(place >= 0, model.prefix_piece[place], -1)
            take = piece >= 0
            if size == 1:
                take = np.ones(len(at), bool)
            starts.append(at[take])
            sizes.append(np.full(int(take.sum()), size, np.int64))
            ids.append(piece[take])
            on = np.flatnonzero((place >= 0) & (at + size < end[at]))
            if not len(on):
                break
            at = at[on]
            h = tb.mix(h[on] * _P + chars[at + size].astype(np.uint64))
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)


def best_paths(model: Model, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward Viterbi over all chunks at once (with spaces as U+2581): pieces of each chunk's best path, flat and
    with bounds, its score, and the gap to the second best (infinite if there is none). Of equal scores the path
    whose last piece is shortest wins, at every place."""
    sizes = np.array([len(c) for c in chunks], np.int64)
    chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(chunks)), sizes)
    start, size, piece = lattice(model, chars, first[1:][of])
    score = np.where(piece >= 0, model.score[piece], model.unk_score)
    # a node for every place of every chunk, its start included
    base = first[:-1] + np.arange(len(chunks))
    node = start + of[start]
    best, second = np.full(len(chars) + len(chunks), -np.inf), np.full(len(chars) + len(chunks), -np.inf)
    back, via = np.zeros(len(best), np.int64), np.full(len(best), -2, np.int64)
    best[base] = 0.0
    step = (start - first[:-1][of[start]] + size) * (model.longest + 1) + size  # by end, then by length
    order = np.argsort(step, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(step[order])) + 1, [len(order)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        e = order[lo:hi]
        n, n2 = node[e], node[e] + size[e]
        one, two = best[n] + score[e], second[n] + score[e]
        had, had2 = best[n2], second[n2]
        better = one > had
        best[n2] = np.where(better, one, had)
        second[n2] = np.where(better, np.maximum(had, two), np.maximum(had2, one))
        back[n2] = np.where(better, size[e], back[n2])
        via[n2] = np.where(better, piece[e], via[n2])
    last = base + sizes
    taken, owner = [], []
    cur, live = last.copy(), np.flatnonzero(sizes > 0)
    while len(live):
        c = cur[live]
        taken.append(via[c])
        owner.append(live)
        cur[live] = c - back[c]
        live = live[cur[live] > base[live]]
    ids = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    who = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    by = np.lexsort((-np.arange(len(ids)), who))  # each chunk's pieces, last found first
    return ids[by], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(chunks)))]), best[last], best[last] - second[last]


def long_path(model: Model, text: str) -> tuple[list[int], float, float]:
    """What ``best_paths`` gives for one chunk, for chunks too long to be handled in step with others."""
    size = len(text)
    best, second = array("d", [0.0]) + array("d", [-np.inf]) * size, array("d", [-np.inf]) * (size + 1)
    back: list[tuple[int, int]] = [(0, 0)] * (size + 1)
    for e in range(1, size + 1):
        for s in range(e - 1, max(-1, e - model.longest - 1), -1):
            i = model.usable.get(text[s:e], -1)
            if i < 0 and e - s > 1:
                continue
            v = model.unk_score if i < 0 else float(model.score[i])
            one, two = best[s] + v, second[s] + v
            if one > best[e]:
                best[e], second[e], back[e] = one, max(best[e], two), (s, i)
            elif one > second[e]:
                second[e] = one
    out, e = [], size
    while e:
        e, i = back[e]
        out.append(i)
    return out[::-1], best[size], best[size] - second[size]


class Lattice:
    """A chunk's lattice (spaces as U+2581) with its forward Viterbi scores. The edges that end at a place are looked
    up when they are asked for; in chunks of up to ``LONG`` characters they are remembered."""

    def __init__(self, model: Model, text: str):
        self.model, self.text, self.size = model, text, len(text)
        self.known: dict[int, list[tuple[int, int, float]]] = {}
        self.alpha = alpha = array("d", bytes(8))
        for e in range(1, self.size + 1):
            alpha.append(max(alpha[s] + v for s, _, v in self.into(e)))

    def into(self, e: int) -> list[tuple[int, int, float]]:
        """Start, piece and score of the edges that end at ``e``, shortest first."""
        got = self.known.get(e)
        if got is None:
            text, model, usable = self.text, self.model, self.model.usable
            got = []
            for s in range(e - 1, max(-1, e - model.longest - 1), -1):
                i = usable.get(text[s:e], -1)
                if i >= 0:
                    got.append((s, i, float(model.score[i])))
                elif e - s == 1:
                    got.append((s, -1, model.unk_score))
            if self.size <= LONG:
                self.known[e] = got
        return got


def search(chain: list[Lattice], n: int) -> list[tuple[float, list[list[tuple[int, int, int]]]]]:
    """The n best paths through a chain of lattices by A-star from its end, best first: score, and the edges (start,
    end, piece) in each lattice. Of equal scores the path whose pieces from the end are shortest comes first; which of
    further equal ones are given is settled by the order of the search, the same for the same chain."""
    before = [0.0]
    for one in chain[:-1]:
        before.append(before[-1] + one.alpha[one.size])
    total = before[-1] + chain[-1].alpha[chain[-1].size]
    known = [total]  # scores of the n best paths met so far, a heap
    heap: list = [(-total, 0, len(chain) - 1, chain[-1].size, 0.0, None)]
    tick, out = 0, []
    while heap and len(out) < n:
        _, _, k, at, done, path = heapq.heappop(heap)
        if not at and k:
            k -= 1
            at = chain[k].size
        if not at:
            edges: list[list[tuple[int, int, int]]] = [[] for _ in chain]
            while path is not None:
                own, edge, path = path
                edges[own].append(edge)
            out.append((done, edges))
            continue
        alpha, base = chain[k].alpha, before[k] + done
        into = chain[k].into(at)
        first = 0
        for c in range(1, len(into)):
            if alpha[into[c][0]] + into[c][2] > alpha[into[first][0]] + into[first][2]:
                first = c
        for c in [*range(len(into) - 1, first, -1), *range(first - 1, -1, -1), first]:
            s, i, v = into[c]
            value = base + alpha[s] + v
            if c != first:
                if len(known) < n:
                    heapq.heappush(known, value)
                elif value > known[0]:
                    heapq.heapreplace(known, value)
                else:
                    continue
            tick -= 1
            heapq.heappush(heap, (-value, tick, k, s, done + v, (k, (s, at, i), path)))
    return out


def nbest(model: Model, text: str, n: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """The n best segmentations of a text (spaces as U+2581) as one lattice: score and edges, best first."""
    return [(v, edges[0]) for v, edges in search([Lattice(model, text)], n)]


def expand(model: Model, text: str, edges: list[tuple[int, int, int]]) -> list[int]:
    """Piece numbers of a path; a character that no piece has becomes its bytes."""
    out: list[int] = []
    for s, e, i in edges:
        out += [i] if i >= 0 else [model.byte_id[b] for b in text[s:e].encode()]
    return out


class Encoder:
    """Encodes texts, remembering the chunks it has met."""

    def __init__(self, model: Model, n: int):
        self.model, self.n = model, n
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.score, self.gap = np.zeros(1 << 12), np.zeros(1 << 12)

    def _room(self, chunks: int, ids: int) -> None:
        if self.used + ids > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + ids))
        if len(self.number) + chunks > len(self.start):
            size = max(2 * len(self.start), len(self.number) + chunks)
            self.start, self.count, self.score, self.gap = (np.resize(x, size) for x in (self.start, self.count, self.score, self.gap))

    def keys(self, text: str) -> list[str]:
        """The chunks of a text. One that begins with a space is given without it, the first with the space that is
        put before the text."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if not self.model.chained:
            return [text]
        got = text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")
        if "" in got:
            got = [c[1:] if c[0] == " " else c for c in _CHUNK.findall(" " + text)]
        elif got[0][0] == "\n":
            got.insert(0, "")
        return got

    def _learn(self, keys: list[str]) -> None:
        for lo in range(0, len(keys), 1 << 15):
            some = keys[lo : lo + (1 << 15)]
            whole = [k if k[:1] == "\n" and self.model.chained else SPACE + k.replace(" ", SPACE) for k in some]
            long = [k for k, w in enumerate(whole) if len(w) > LONG]
            ids, bounds, score, gap = best_paths(self.model, [w if len(w) <= LONG else SPACE for w in whole])
            if long:
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for k in long:
                    path, score[k], gap[k] = long_path(self.model, whole[k])
                    own[k] = np.array(path, np.int64)
                ids, bounds = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            if (ids < 0).any():  # characters that no piece has become their bytes
                unknown = np.flatnonzero(ids < 0)
                raw: list[list[int]] = []
                for k in np.unique(np.searchsorted(bounds, unknown, side="right") - 1).tolist():
                    at = 0
                    for i in ids[bounds[k] : bounds[k + 1]].tolist():
                        if i < 0:
                            raw.append([self.model.byte_id[b] for b in whole[k][at].encode()])
                        at += len(self.model.pieces[i]) if i >= 0 else 1
                times = np.ones(len(ids), np.int64)
                times[unknown] = [len(x) for x in raw]
                ends = np.concatenate([[0], np.cumsum(times)])
                known = ids >= 0
                ids, bounds = np.repeat(ids, times), ends[bounds]
                ids[np.repeat(~known, times)] = [b for x in raw for b in x]
            self._room(len(some), len(ids))
            base = len(self.number)
            self.number.update(zip(some, range(base, base + len(some)), strict=True))
            own = slice(base, base + len(some))
            self.start[own], self.count[own] = bounds[:-1] + self.used, np.diff(bounds)
            self.score[own], self.gap[own] = score, gap
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[dict]]]:
        """Best pieces of all texts, flat and with bounds; scores of the n best of each text, best first; and for
        those after the best, what they put in place of which pieces of it."""
        if len(self.number) > MEMORY:
            self._reset()
        per = [self.keys(t) if t else [] for t in texts]
        keys = [k for own in per for k in own]
        get = self.number.get
        number = [get(k, -1) for k in keys]
        if -1 in number:
            self._learn(list(dict.fromkeys(k for k, i in zip(keys, number, strict=True) if i < 0)))
            number = [get(k) for k in keys]
        at = np.array(number, np.int64)
        count = self.count[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], count) + np.arange(ends[-1])]
        chunk = np.concatenate([[0], np.cumsum([len(own) for own in per])]).astype(np.int64)
        bounds = ends[chunk]
        gaps, total = self.gap[at], np.concatenate([[0.0], np.cumsum(self.score[at])])
        scores, others = [], []
        for d in range(len(texts)):
            lo, hi = int(chunk[d]), int(chunk[d + 1])
            if lo == hi:
                scores.append([])
                others.append([])
                continue
            best = float(self.score[at[lo:hi]].sum()) if hi - lo < 64 else float(total[hi] - total[lo])
            s, o = [best], []
            if self.n > 1:
                own = gaps[lo:hi]
                k = min(self.n - 1, hi - lo)
                near = np.argpartition(own, k - 1)[:k] if k < hi - lo else np.arange(hi - lo)
                limit = own[near].max()
                near = np.concatenate([np.flatnonzero(own < limit), np.flatnonzero(own == limit)])[:k] if k < hi - lo else near
                near = np.sort(near[np.isfinite(own[near])])
                self._alternatives(near + lo, keys, ends, ends[lo], best, s, o, ids)
            scores.append(s)
            others.append(o)
        return ids, bounds, scores, others

    def _alternatives(self, near: np.ndarray, keys: list[str], ends: np.ndarray, base: int, best: float, s: list[float], o: list[dict], ids: np.ndarray) -> None:
        """A-star over the lattices of the chunks at ``near``; what comes out besides the best path is appended."""
        if not len(near):
            return
        model = self.model
        whole = [k if (k := keys[c])[:1] == "\n" and model.chained else SPACE + k.replace(" ", SPACE) for c in near.tolist()]
        chain = [lattice_of(model, w) for w in whole]
        firsts = [ids[ends[c] : ends[c + 1]].tolist() for c in near.tolist()]
        got = search(chain, self.n)
        top = got[0][0]
        for value, path in got:
            edits = []
            for c, w, edges, first in zip(near.tolist(), whole, path, firsts, strict=True):
                if (own := expand(model, w, edges)) != first:
                    edits.append({"start": int(ends[c] - base), "end": int(ends[c + 1] - base), "ids": own})
            if edits and len(s) < self.n:
                s.append(best + (value - top))
                o.append({"edits": edits})


#: Lattices of short chunks that a worker remembers (some kilobytes each).
_LATTICES = 8_000
_lattices: dict[str, Lattice] = {}


def lattice_of(model: Model, chunk: str) -> Lattice:
    """The lattice of a chunk, remembered if it is short."""
    if len(chunk) > LONG:
        return Lattice(model, chunk)
    got = _lattices.get(chunk)
    if got is None or got.model is not model:
        if len(_lattices) >= _LATTICES:
            _lattices.clear()
        got = _lattices[chunk] = Lattice(model, chunk)
    return got


class Decoder:
    """Piece numbers to text."""

    def __init__(self, model: Model):
        raw = [bytes([int(p[3:5], 16)]) if b else ("" if i not in ok else p.replace(SPACE, " ")).encode() for ok in [set(model.usable.values())] for i, (p, b) in enumerate(zip(model.pieces, model.is_byte.tolist(), strict=True))]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts with the space that stands before each, and bounds."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[bounds]


_EDIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHER = pa.struct([("edits", pa.list_(_EDIT))])


def _encode(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    model = cached(path)
    encoder, decoder = Encoder(model, n), Decoder(model)
    for batch in batches:
        for part in tb.slices(batch):
            column = part.column("text")
            texts = column.to_pylist()
            ids, bounds, scores, others = encoder(texts)
            raw, ends = decoder(ids, bounds)
            given, offsets = tb.buffers(tb.filled(column))
            same = []
            for d, t in enumerate(texts):
                a = raw[ends[d] + 1 : ends[d + 1]]
                b = given[offsets[d] : offsets[d + 1]]
                same.append(None if t is None else bool(len(a) == len(b) and (a == b).all()))
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            empty = pa.array([None] * len(texts), pa.list_(pa.int32()))
            counts = pa.array(np.diff(bounds).astype(np.int32), mask=np.array([t is None for t in texts], bool))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    counts,
                    pa.compute.if_else(null, empty, lists) if any(t is None for t in texts) else lists,
                    pa.array([None if t is None else s for t, s in zip(texts, scores, strict=True)], pa.list_(pa.float64())),
                    pa.array([None if t is None else o for t, o in zip(texts, others, strict=True)], pa.list_(_OTHER)),
                    pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids", "scores", "alternatives", "round_trip"],
            )


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, n: int = NBEST) -> DataFrame:
    """The ``n`` best segmentations of each text: ``doc_id``, ``n_pieces`` and ``ids`` of the best, ``scores`` of up
    to ``n``, best first, ``alternatives``, one for each score after the first, whose ``edits`` put ``ids`` in place
    of the best segmentation's pieces ``start`` to ``end`` (exclusive), and ``round_trip``, whether decoding ``ids``
    gives the text back.

    One row comes out for each row that goes in. A null text has nulls, an empty one no pieces, no scores and a true
    ``round_trip``. Of equal scores the path whose pieces from the end are shortest is the best; which of equally
    scored alternatives are given is settled by the order of the search, the same for the same text, so repeated rows
    get equal results. A very long text, or a long run without a space, takes time and memory in proportion. U+2581 in a
    text stands for a space in the piece alphabet, so such a text comes back with a space in its place. An empty
    table gives no rows. Other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    docs = plain(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces int, ids array<int>, scores array<double>, alternatives array<struct<edits:array<struct<start:int,end:int,ids:array<int>>>>>, round_trip boolean"
    return docs.mapInArrow(lean(partial(_encode, path=path, n=n)), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(cached(path))
    for batch in batches:
        texts = []
        for own in batch.column("ids"):
            if not own.is_valid:
                texts.append(None)
                continue
            ids = own.values.to_numpy(zero_copy_only=False).astype(np.int64)
            texts.append(decoder(ids, np.array([0, len(ids)]))[0].tobytes()[1:].decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` of piece numbers. Null gives null, no pieces give empty text; bytes that aren't UTF-8
    become U+FFFD."""
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(lean(partial(_decode, path=path)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
