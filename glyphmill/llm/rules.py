"""Quality rules as a short-circuit cascade.

A rule is true for a text to reject. On a bounded sample every rule is timed and its share of rejections counted; the
rules then run by falling rejection per cost, so that most bad texts are settled by the rules that are cheap and find
much, and a rule runs only on what all rules before it passed. The order changes the time, never the result.

Rules run in Arrow batches on the bytes of many texts at once (``RULES``): counts over character classes, word and
sentence spans, without an object for each word.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb
from .common import bounded_sample, lean, plain, table

#: Rows on which costs and selectivities are estimated at most.
SAMPLE_ROWS = 1000
MAX_WORD, MIN_WORD, SYMBOLS, PIPES, UPPER, REPEATS, SENTENCES = 20.0, 1.5, 0.1, 0.1, 0.45, 0.2, 0.3
_SYMBOL = "#$%&*|!~^_=<>{}\\"


def _sql_text() -> str:
    w = "list_filter(string_split_regex(t, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"
    s = "list_filter(string_split_regex(t, '[.!?\\n]+[ \\t]*'), lambda x: x <> '')"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, length(t) AS c, {w} AS w, {s} AS s,
  length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS letters, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS upper,
  length(regexp_replace(t, '[ \\t\\n\\r\\f]+', '', 'g')) AS solid,
  length(t) - length(translate(t, '#$%&*|!~^_=<>{{}}\\', '')) AS symbols, length(t) - length(replace(t, '|', '')) AS pipes FROM a)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words FROM b
WHERE len(w) >= 1
  AND NOT (solid / greatest(len(w), 1) > {MAX_WORD} OR (len(w) > 3 AND solid / greatest(len(w), 1) < {MIN_WORD}))
  AND NOT (symbols / greatest(c, 1) > {SYMBOLS})
  AND NOT (pipes / greatest(len(w), 1) > {PIPES})
  AND NOT (letters >= 20 AND upper / greatest(letters, 1) > {UPPER})
  AND NOT (len(w) >= 10 AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) / greatest(len(w), 1) > {REPEATS})
  AND NOT (len(s) >= 5 AND 1 - len(list_distinct(s)) / greatest(len(s), 1) > {SENTENCES})
"""


def order_rules(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Names by falling rejection per cost; of equal ones the cheaper, then the first by name."""
    return sorted(estimates, key=lambda n: (-estimates[n][1] / estimates[n][0], estimates[n][0], n))


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_IS_SPACE, _IS_SYMBOL, _IS_PIPE, _IS_END, _IS_BLANK = _class(" \t\n\r\f"), _class(_SYMBOL), _class("|"), _class(".!?\n"), _class(" \t")
_ASCII_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_ASCII_UPPER = np.array([c < 128 and chr(c).isupper() for c in range(256)])
_wide: list[np.ndarray] = []


def _letter_tables() -> list[np.ndarray]:
    """Whether each code point is a letter, and an upper-case one; letters end below 0x33000. Built once a process."""
    if not _wide:
        kinds = [unicodedata.category(chr(c)) for c in range(0x33000)]
        _wide.extend([np.array([k[0] == "L" for k in kinds]), np.array([k == "Lu" for k in kinds])])
    return _wide


class Texts:
    """Bytes of many texts with bounds; what rules count is computed when first asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets

    @staticmethod
    def of(column: pa.Array) -> Texts:
        return Texts(*tb.buffers(tb.filled(column)))

    def select(self, on: np.ndarray) -> Texts:
        """The texts at these places."""
        sizes = np.diff(self.offsets)[on]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return Texts(self.raw[np.repeat(np.isin(np.arange(len(self.offsets) - 1), on), np.diff(self.offsets))], ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags of each text."""
        out = np.zeros(len(self.offsets) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.offsets))
        if len(some):
            out[some] = np.add.reduceat(flags, self.offsets[some], dtype=np.int64)
        return out

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of the maximal runs of set flags within a text."""
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        first[at] = inside[at]
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        return start, np.flatnonzero(last) + 1, np.searchsorted(self.offsets, start, side="right") - 1

    @cached_property
    def solid_bytes(self) -> np.ndarray:
        return ~_IS_SPACE[self.raw]

    @cached_property
    def leading(self) -> np.ndarray:
        """First bytes of characters."""
        return (self.raw & 0xC0) != 0x80

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(self.solid_bytes)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=len(self.offsets) - 1)

    @cached_property
    def solid(self) -> np.ndarray:
        return self.per_text(self.solid_bytes & self.leading)

    @cached_property
    def chars(self) -> np.ndarray:
        return self.per_text(self.leading)

    def share(self, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters and upper-case letters of each text."""
        raw = self.raw
        letter, upper = self.per_text(_ASCII_LETTER[raw]), self.per_text(_ASCII_UPPER[raw])
        at = np.flatnonzero(raw >= 0xC2)
        if len(at):
            padded = np.concatenate([raw, np.zeros(3, np.uint8)])
            b = [padded[at + k].astype(np.int32) for k in range(4)]
            low = [x & 0x3F for x in b]
            two, three = (b[0] & 0x1F) << 6 | low[1], (b[0] & 0x0F) << 12 | low[1] << 6 | low[2]
            code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, (b[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
            code[code >= 0x33000] = 0
            doc = np.searchsorted(self.offsets, at, side="right") - 1
            for total, is_kind in zip((letter, upper), _letter_tables(), strict=True):
                total += np.bincount(doc[is_kind[code]], minlength=len(total))
        return letter, upper

    @cached_property
    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans between sentence ends and the blanks that follow them."""
        raw = self.raw
        end = _IS_END[raw]
        blank = np.flatnonzero(_IS_BLANK[raw])
        if len(blank):
            run = np.concatenate([[True], (blank[1:] != blank[:-1] + 1) | np.isin(blank[1:], self.offsets)])
            head = blank[run]
            ok = np.zeros(len(head), bool)
            inner = ~np.isin(head, self.offsets)
            ok[inner] = end[head[inner] - 1]
            end[blank[ok[np.cumsum(run) - 1]]] = True
        return self.spans(~end)


def _word_length(t: Texts) -> np.ndarray:
    mean = t.share(t.solid, t.n_words)
    return (mean > MAX_WORD) | ((t.n_words > 3) & (mean < MIN_WORD))


def _repeated_words(t: Texts) -> np.ndarray:
    start, end, doc = t.words
    size = end - start
    near = np.flatnonzero((doc[1:] == doc[:-1]) & (size[1:] == size[:-1]) & (t.raw[start[1:]] == t.raw[start[:-1]]))
    own = np.union1d(near, near + 1)
    h = tb.span_hashes(t.raw, start[own], end[own])
    same = near[h[np.searchsorted(own, near)] == h[np.searchsorted(own, near + 1)]]
    return (t.n_words >= 10) & (t.share(np.bincount(doc[same], minlength=len(t.n_words)), t.n_words) > REPEATS)


def _repeated_sentences(t: Texts) -> np.ndarray:
    start, end, doc = t.sentences
    n = np.bincount(doc, minlength=len(t.offsets) - 1)
    h = tb.span_hashes(t.raw, start, end)
    order = np.lexsort((h, doc))
    fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(order) else np.zeros(0, bool)
    distinct = np.bincount(doc[order][fresh], minlength=len(n))
    return (n >= 5) & (1 - t.share(distinct, n) > SENTENCES)


#: Rejections by name. Every rule is false for a text it doesn't apply to; null counts as empty.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "no_words": lambda t: t.n_words < 1,
    "word_length": _word_length,
    "symbols": lambda t: t.share(t.per_text(_IS_SYMBOL[t.raw]), t.chars) > SYMBOLS,
    "tables": lambda t: t.share(t.per_text(_IS_PIPE[t.raw]), t.n_words) > PIPES,
    "upper_case": lambda t: (t.letters[0] >= 20) & (t.share(t.letters[1], t.letters[0]) > UPPER),
    "repeated_words": _repeated_words,
    "repeated_sentences": _repeated_sentences,
}


def survivors(column: pa.Array, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts that all rules pass, and their numbers of words."""
    at, now = np.arange(len(column)), Texts.of(column)
    for name in order:
        good = np.flatnonzero(~RULES[name](now))
        if len(good) < len(at):
            at, now = at[good], now.select(good)
        if not len(at):
            break
    return at, now.n_words


def estimate_batches(texts: list[str | None], runs: int = 2) -> dict[str, tuple[float, float]]:
    """Seconds that each rule takes alone on the sample, with all it needs, and its share of rejections there."""
    column = pa.array(texts, pa.large_string())
    out = {}
    _letter_tables()
    for name, rule in RULES.items():
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            share = float(rule(Texts.of(column)).mean())
            best = min(best, time.perf_counter() - began)
        out[name] = (best, share)
    return out


def _ordered(docs: DataFrame, id_col: str, text_col: str, rows: int) -> list[str]:
    got = bounded_sample(plain(docs, id_col, text_col), rows)
    return order_rules(estimate_batches([r.text for r in got])) if got else sorted(RULES)


def _keep(batches: Iterator[pa.RecordBatch], text: str, order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch, text):
            yield part.take(pa.array(survivors(part.column(text), order)[0]))


def _count(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch):
            at, n = survivors(part.column("text"), order)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(n.astype(np.int32))], names=["doc_id", "n_words"])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows whose text no rule rejects, with all their columns.

    A null or empty text and one of white space only has no words and is rejected. Texts of a few words are kept:
    rules on shares ask for a least number of words, letters or sentences. Rows without identifier are judged like
    others, and repeated rows alike. Very long texts are judged whole. An empty table gives no rows.
    """
    return docs.mapInArrow(lean(partial(_keep, text=text_col, order=_ordered(docs, id_col, text_col, sample_rows))), docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pass all rules, those without identifier too, with their number of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(lean(partial(_count, order=_ordered(docs, "doc_id", "text", SAMPLE_ROWS))), "doc_id bigint, n_words int")


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLES = {"op8_quality_rules": _sql_text()}
