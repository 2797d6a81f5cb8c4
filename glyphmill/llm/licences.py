"""License scans: fuzzy search for short notices.

A notice of m characters that may have k errors (insertions, deletions, substitutions) is cut into k + 1 pieces; by
the pigeonhole principle one of them occurs unchanged wherever the notice occurs with at most k errors. One
Aho-Corasick automaton finds the pieces of all notices. In the windows around them one pass of Myers' bit vectors
gives the least errors of a match at every place, so only true matches are left, and their start; there the ``regex``
library matches the notice with exactly that bound on errors, which verifies the edits and gives their kinds. With
the bound and the span known beforehand that match is quick however many errors a long notice may have.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb
from .common import lean, plain, table
from .secretscan import folded

NOTICES = {
    "AGPL-3.0": "licensed under the gnu affero general public license",
    "Apache-2.0": "licensed under the apache license, version 2.0",
    "All-Rights-Reserved": "all rights reserved",
    "BSD": "redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "licensed under cc by 4.0",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "CC-BY-SA-4.0": "licensed under cc by-sa 4.0",
    "CC0-1.0": "dedicated to the public domain under cc0 1.0",
    "GPL-2.0": "licensed under the gnu general public license, version 2",
    "GPL-3.0": "licensed under the gnu general public license, version 3",
    "ISC": "permission to use, copy, modify, and/or distribute this software for any purpose",
    "LGPL": "licensed under the gnu lesser general public license",
    "MIT": "released under the mit license",
    "MIT-text": "permission is hereby granted, free of charge, to any person obtaining a copy",
    "MPL-2.0": "subject to the terms of the mozilla public license, v. 2.0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
}
#: Characters of a notice for each error that it may have.
PER_ERROR = 9


@dataclass(frozen=True)
class Notice:
    name: str
    text: str
    errors: int

    def pattern(self, errors: int) -> regex.Pattern:
        return regex.compile(f"(?:{regex.escape(self.text, special_only=True)}){{e<={errors}}}")

    def pieces(self) -> list[tuple[int, str]]:
        """Place and text of errors + 1 pieces of about equal size."""
        cuts = [round(i * len(self.text) / (self.errors + 1)) for i in range(self.errors + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def notices(texts: dict[str, str] | None = None, per_error: int = PER_ERROR) -> list[Notice]:
    return [Notice(name, t, len(t) // per_error) for name, t in sorted((texts or NOTICES).items())]


def masks(pattern: str) -> dict[str, int]:
    """For each character the places where the pattern has it, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(own: dict[str, int], size: int, text: str, lo: int, hi: int, anywhere: bool = True) -> list[int]:
    """For a pattern of ``size`` characters given by its masks: the least errors of a match that ends after each
    character of ``text[lo:hi]`` and starts anywhere in it (or, with ``anywhere`` false, at ``lo``)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, out = full, 0, size, []
    first = 0 if anywhere else 1
    for i in range(lo, hi):
        eq = own.get(text[i], 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus)
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | first
        down <<= 1
        plus = (down | ~(xv | up)) & full
        minus = up & xv & full
        out.append(score)
    return out


class Matcher:
    """A notice with what its matching needs."""

    def __init__(self, notice: Notice):
        self.notice, self.size = notice, len(notice.text)
        self.forward, self.backward = masks(notice.text), masks(notice.text[::-1])
        self.patterns = [notice.pattern(e) for e in range(notice.errors + 1)]

    def start(self, text: str, end: int, errors: int, least: int) -> int:
        """The longest match with that many errors that ends at ``end`` and doesn't start before ``least``."""
        lo = max(least, end - self.size - errors)
        back = text[lo:end][::-1]
        by_size = distances(self.backward, self.size, back, 0, len(back), anywhere=False)
        return end - max(k for k, e in enumerate(by_size, 1) if e == errors)

    def __call__(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """Spans and errors in ``text[lo:hi]``: the match with the fewest errors (of equal ones that which ends first,
        of those the longest), then the next that overlaps none before, and so on."""
        most, size = self.notice.errors, self.size
        todo = [(e, end) for end, e in enumerate(distances(self.forward, size, text, lo, hi), lo + 1) if e <= most]
        heapq.heapify(todo)
        ends: list[int] = []  # of the matches taken, with their starts
        starts: list[int] = []
        out = []
        while todo:
            errors, end = heapq.heappop(todo)
            k = bisect_left(ends, end)
            if k < len(starts) and starts[k] < end:
                continue
            least = ends[k - 1] if k else lo
            if end - least < size - most:
                continue
            from_end = max(least, end - size - most)
            best = min(distances(self.backward, size, text[from_end:end][::-1], 0, end - from_end, anywhere=False))
            if best > errors:
                if best <= most:
                    heapq.heappush(todo, (best, end))
                continue
            start = self.start(text, end, errors, least)
            m = self.patterns[errors].fullmatch(text, start, end)
            if not m or sum(m.fuzzy_counts) != errors:
                raise ValueError(f"{self.notice.name}: {errors} errors at {start} to {end} aren't confirmed")
            ends.insert(k, end)
            starts.insert(k, start)
            out.append((start, end, errors))
        return sorted(out)


def settle(found: list[tuple[int, int, int, Notice]]) -> list[tuple[int, int, int, str]]:
    """Of notices that overlap, the one with the smallest share of errors stays, then the longest, the first, the
    first by name."""
    out: list[tuple[int, int, int, str]] = []  # in order of place; none overlaps another
    for s, e, n, notice in sorted(found, key=lambda x: (x[2] / len(x[3].text), x[0] - x[1], x[0], x[3].name)):
        k = bisect_left(out, (s,))
        if (k == 0 or out[k - 1][1] <= s) and (k == len(out) or out[k][0] >= e):
            out.insert(k, (s, e, n, notice.name))
    return out


class Finder:
    def __init__(self, own: list[Notice] | None = None):
        import ahocorasick

        self.notices = own or notices()
        self.matchers = [Matcher(n) for n in self.notices]
        by: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            for at, piece in n.pieces():
                by.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own_places in by.items():
            self.automaton.add_word(piece, (len(piece), tuple(own_places)))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """Start, end, errors and name of the notices in a text."""
        if not text:
            return []
        low = folded(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(low):
            for k, at in places:
                n = self.notices[k]
                start = end - size + 1 - at
                windows.setdefault(k, []).append([max(0, start - n.errors), min(len(low), start + len(n.text) + n.errors)])
        found = []
        for k, own in windows.items():
            own.sort()
            merged = [own[0]]
            for w in own[1:]:
                if w[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], w[1])
                else:
                    merged.append(w)
            for lo, hi in merged:
                found += [(*m, self.notices[k]) for m in self.matchers[k](low, lo, hi)]
        return settle(found)


def _scan(batches: Iterator[pa.RecordBatch], own: list[Notice]) -> Iterator[pa.RecordBatch]:
    finder = Finder(own)
    for batch in batches:
        for part in tb.slices(batch):
            rows = [(k, *hit) for k, t in enumerate(part.column("text").to_pylist()) for hit in finder(t)]
            if rows:
                at, start, end, errors, name = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at)), pa.array(name), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(errors, pa.int32())],
                    names=["doc_id", "license", "start", "end", "errors"],
                )


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None, per_error: int = PER_ERROR) -> DataFrame:
    """One row per notice found: ``doc_id``, ``license``, ``start`` and ``end`` (characters, end exclusive) and
    ``errors``, at most one for every ``per_error`` characters of the notice. ``texts`` gives other notices by name, in
    lower case. Case doesn't count; every other difference is an error, a line break for a space too.

    Null and empty texts have none. Rows without identifier are searched and give rows without one; repeated rows
    give theirs each. Very long texts are searched whole. Of overlapping notices one stays (``settle``), of matches of
    one notice that overlap the one with the fewest errors, then the first, then the longest. An empty table gives no
    rows. Other columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    return docs.mapInArrow(lean(partial(_scan, own=notices(texts, per_error))), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, start int, end int, errors int")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_notices(table(spark, sf_dir, "documents"))


QUERIES = {"op10_license_scan": op10_license_scan}
ORACLES: dict[str, str] = {}
