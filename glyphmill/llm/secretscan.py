"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksum validation.

One automaton holds the keywords of all rules. Only where a keyword stands is its rule's regular expression tried,
anchored at the keyword's first character, so the cost is that of one pass of the automaton over the text. What
matches is then validated: token formats that embed a checksum must have the right one (base-62 CRC-32, Luhn), a
signed web token must have a readable header, and formats without a checksum must at least look random.

Values of open length end where their run of characters ends. Keywords that stand within one another's values, as when
a keyword is repeated, share that run: its end is looked for once, and the randomness of all values in it is counted in
one walk from its end, so a text of nothing but keywords takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as tb
from .common import lean, plain, table

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base62_crc(body: str) -> str:
    """CRC-32 of the text as six base-62 digits."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _B62[d] + out
    return out


def _crc_ok(m: re.Match) -> str | None:
    body = m.group(1)
    return "valid" if base62_crc(body[:-6]) == body[-6:] else None


_IIN = re.compile(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|3[0689]|35|6011|62|64[4-9]|65")


def _card_ok(m: re.Match) -> str | None:
    digits = re.sub("[ -]", "", m.group(0))
    return "valid" if 13 <= len(digits) <= 19 and _IIN.match(digits) and luhn(digits) else None


def _jwt_ok(m: re.Match) -> str | None:
    head = m.group(0).split(".")[0]
    try:
        return "valid" if "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))) else None
    except (ValueError, TypeError):
        return None


def entropy(text: str) -> float:
    """Bits per character."""
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


#: Bits per character that a value without a checksum has at least, and its least number of characters.
RANDOM, LEAST = 2.8, 20


def random_suffixes(text: str, starts: list[int], end: int) -> list[bool]:
    """For each start, falling: whether ``text[start:end]`` looks random, that is, has a digit and ``RANDOM`` bits per
    character. Counts are carried on from one start to the next."""
    counts: Counter[str] = Counter()
    total, digits, at, out = 0.0, 0, end, []
    for start in starts:
        for c in text[start:at]:
            n = counts[c]
            counts[c] = n + 1
            total += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
            digits += c.isdigit()
        at = start
        out.append(digits > 0 and round(math.log2(end - start) - total / (end - start), 9) >= RANDOM)
    return out


def _plain_ok(_: re.Match) -> str | None:
    return "none"


@dataclass(frozen=True)
class Rule:
    """Lower-case keywords, an expression that matches from the keyword's first character on, and a check that
    gives the state of the checksum (``valid``, or ``none`` for formats without one), or None to discard. With ``run``
    the expression ends where the value begins, and the value is the run of such characters, at least ``LEAST`` of
    them, that look random."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    check: Callable[[re.Match], str | None] = _plain_ok
    run: re.Pattern | None = None


_ASSIGNED = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "auth_key", "private_key")
RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?<![0-9A-Za-z])gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _crc_ok),
    Rule("npm_token", ("npm_",), re.compile(r"(?<![0-9A-Za-z])npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), _crc_ok),
    Rule("payment_card", tuple(f"{a}{b}" for a in "23456" for b in "0123456789"), re.compile(r"(?<![0-9A-Za-z.])[2-6][0-9](?:[ -]?[0-9]){11,17}(?![0-9])"), _card_ok),
    Rule("web_token", ("eyj",), re.compile(r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}"), _jwt_ok),
    Rule("aws_key_id", ("akia", "asia"), re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[2-7A-Z]{16}(?![0-9A-Za-z])"), _plain_ok),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(r"(?<![0-9A-Za-z])xox[bpar]-"), run=re.compile(r"[0-9A-Za-z-]*")),
    Rule("stripe_key", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_"), run=re.compile(r"[0-9A-Za-z]*")),
    Rule("private_key", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), _plain_ok),
    Rule("assigned_secret", _ASSIGNED, re.compile(r"(?i:" + "|".join(_ASSIGNED) + r")[\"']?[ \t]*(?::|=>?)[ \t]*[\"']?"), run=re.compile(r"[0-9A-Za-z_/+=.-]*")),
)


def folded(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        import ahocorasick

        self.rules = rules
        by: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for word in rule.keywords:
                by.setdefault(word, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, own in by.items():
            self.automaton.add_word(word, (len(word), tuple(own)))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and checksum state of the secrets of a text, none overlapping another: of those that do,
        the first stays, of equal starts the longest, then that of the first rule."""
        if not text:
            return []
        found = []
        runs: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by rule and end of the run: (value's start, keyword's start)
        last: dict[int, tuple[int, int]] = {}  # by rule: the run looked at last
        for end, (size, own) in self.automaton.iter(folded(text)):
            at = end - size + 1
            for k in own:
                rule = self.rules[k]
                m = rule.pattern.match(text, at)
                if not m:
                    continue
                if rule.run is None:
                    if state := rule.check(m):
                        found.append((m.start(), -m.end(), k, state))
                    continue
                value = m.end()
                lo, hi = last.get(k, (0, -1))
                if not lo <= value < hi:
                    hi = rule.run.match(text, value).end()
                    last[k] = (value, hi)
                if hi - value >= LEAST:
                    runs.setdefault(k, {}).setdefault(hi, []).append((value, at))
        for k, ends in runs.items():
            for hi, starts in ends.items():
                starts.sort(reverse=True)
                found += [(at, -hi, k, "none") for (_, at), ok in zip(starts, random_suffixes(text, [v for v, _ in starts], hi), strict=True) if ok]
        return settle(found, self.rules)


def settle(found: list[tuple[int, int, int, str]], rules: tuple[Rule, ...]) -> list[tuple[int, int, str, str]]:
    out, last = [], 0
    for start, end, k, state in sorted(set(found)):
        if start >= last:
            out.append((start, -end, rules[k].kind, state))
            last = -end
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        for part in tb.slices(batch):
            rows = [(k, *hit) for k, t in enumerate(part.column("text").to_pylist()) for hit in scanner(t)]
            if rows:
                at, start, end, kind, state = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at)), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(state)],
                    names=["doc_id", "kind", "start", "end", "checksum"],
                )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per secret: ``doc_id``, ``kind``, ``start`` and ``end`` (characters, end exclusive) and ``checksum``
    (``valid`` where the format has a checksum, else ``none``). The secret itself isn't returned.

    Null and empty texts have none. Rows without identifier are scanned and give rows without one; repeated rows give
    theirs each. Very long texts are scanned whole, and values may have any length. An empty table gives no rows. Other
    columns are ignored.
    """
    docs = plain(docs, id_col, text_col)
    return docs.mapInArrow(lean(_scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kind string, start int, end int, checksum string")


def mask(text: str, hits: list[tuple[int, int, str, str]]) -> str:
    out, last = [], 0
    for start, end, kind, _ in hits:
        out += [text[last:start], f"<{kind}>"]
        last = end
    return "".join([*out, text[last:]])


def _redact(batches: Iterator[pa.RecordBatch], at: int, size_at: int) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        column = batch.column(at)
        texts = column.to_pylist()
        changed = {k: mask(t, hits) for k, t in enumerate(texts) if (hits := scanner(t))}
        if changed:
            columns = list(batch.columns)
            columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], column.type)
            if size_at >= 0:
                sizes = columns[size_at].to_pylist()
                columns[size_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(sizes)], columns[size_at].type)
            batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        yield batch


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """All rows and columns, with each secret in the text replaced by its kind in angle brackets. ``size_col`` names
    a column that holds the number of characters; it follows the text. Null and empty texts stay as they are; repeated
    rows change alike; very long texts are searched whole. An empty table stays empty."""
    size_at = docs.columns.index(size_col) if size_col else -1
    return docs.mapInArrow(lean(partial(_redact, at=docs.columns.index(text_col), size_at=size_at)), docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
