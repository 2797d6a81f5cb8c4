"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles, maximal non-overlapping runs of at least ``min_match``
equal tokens, taken longest first wherever they stand in the document, cover at least ``coverage`` of the item.
Order doesn't count, so a passage whose sentences were moved about is caught.

Documents and items are joined on shared seeds, the hashes of ``min_match`` tokens. Every tile consists of seeds, so
the share of the item that its shared seeds cover bounds the tiles' coverage from above, and only pairs above the
threshold by that bound are tiled. While the benchmark is small its seeds are broadcast and each text is scanned
once, without a shuffle; a larger benchmark is joined by shuffling seeds. Both ways give the same rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import lean, materialized, plain, row_hash, semi, table, unused

MIN_MATCH, COVERAGE = 5, 0.6
#: Characters of benchmark text up to which its seeds are broadcast (about 16 bytes a seed).
BROADCAST_CHARS = 8_000_000
_MOD = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687 % _MOD


def _free_runs(marked: list[bool]) -> list[tuple[int, int]]:
    runs, start = [], -1
    for i, m in enumerate([*marked, True]):
        if m and start >= 0:
            runs.append((start, i))
            start = -1
        elif not m and start < 0:
            start = i
    return runs


def _rolled(tokens: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Start and Karp-Rabin hash of every unmarked run of ``size`` tokens."""
    drop = pow(_BASE, size - 1, _MOD)
    for lo, hi in _free_runs(marked):
        h = 0
        for i in range(lo, hi):
            if i - lo >= size:
                h = (h - tokens[i - size] * drop) % _MOD
            h = (h * _BASE + tokens[i]) % _MOD
            if i - lo >= size - 1:
                yield i - size + 1, h


def _starts(tokens: list[int], marked: list[bool], size: int) -> dict[int, deque[int]]:
    at: dict[int, deque[int]] = {}
    for i, h in _rolled(tokens, marked, size):
        at.setdefault(h, deque()).append(i)
    return at


def _common(item: list[int], text: list[int], item_marked: list[bool], text_marked: list[bool], size: int) -> bool:
    """Whether some unmarked run of ``size`` tokens occurs in both."""
    at = _starts(item, item_marked, size)
    return bool(at) and any(item[i : i + size] == text[j : j + size] for j, h in _rolled(text, text_marked, size) if h in at for i in at[h])


def _mark(item: list[int], text: list[int], item_marked: list[bool], text_marked: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Mark the common runs of ``size`` tokens: for each start in the item, in order, the first place in the text that
    is still free. Places that have been passed stay taken, so each is looked at once for each run that has its hash."""
    places = _starts(text, text_marked, size)
    out = []
    for i, h in list(_rolled(item, item_marked, size)):
        if item_marked[i] or item_marked[i + size - 1]:
            continue
        own = places.get(h, deque())
        while own and (text_marked[own[0]] or text_marked[own[0] + size - 1]):
            own.popleft()
        j = next((j for j in own if item[i : i + size] == text[j : j + size] and not (text_marked[j] or text_marked[j + size - 1])), None)
        if j is not None:
            item_marked[i : i + size] = [True] * size
            text_marked[j : j + size] = [True] * size
            out.append((i, j, size))
    return out


def tiles(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item start, text start, length)`` of each tile. The longest common unmarked run is
    marked first; of equally long ones that with the first start in the item, then in the text. Its length is found
    by halving, since a common run of some length implies one of every smaller length."""
    item_marked, text_marked = [False] * len(item), [False] * len(text)
    out = []
    top = min(len(item), len(text))
    while top >= min_match:
        lo, hi, found = min_match, top, 0
        while lo <= hi:
            mid = (lo + hi) // 2
            if _common(item, text, item_marked, text_marked, mid):
                found, lo = mid, mid + 1
            else:
                hi = mid - 1
        if not found:
            break
        out += _mark(item, text, item_marked, text_marked, found)
        top = found
    return out


@dataclass
class Index:
    """Benchmark items as token hashes, and their seeds sorted by hash with item and place."""

    ids: list
    tokens: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray

    def need(self, coverage: float) -> np.ndarray:
        """Tokens of each item that tiles must cover."""
        return np.array([max(1.0, coverage * len(t)) for t in self.tokens])


_BITS = 22


def build_index(ids: list, texts: list[str], min_match: int) -> Index:
    tokens = tb.tokenize(pa.array(texts, pa.large_string()))
    bounds = tokens.bounds
    first, g = tb.grams(tokens, min_match)
    item = tokens.doc[first]
    order = np.argsort(g, kind="stable")
    bits = np.zeros(1 << _BITS, bool)
    bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(ids, [tokens.hash[bounds[i] : bounds[i + 1]] for i in range(len(ids))], g[order], item[order], (first - bounds[item])[order], bits)


def _covered(places: np.ndarray, min_match: int) -> int:
    """Item tokens that seeds at these sorted distinct places cover."""
    return int(np.minimum(np.diff(places), min_match).sum()) + min_match if len(places) else 0


def tile_pair(item: np.ndarray, text: np.ndarray, min_match: int) -> tuple[int, int, int]:
    """Covered tokens of the item, number of tiles and longest tile, for token hashes. Only the runs of the text
    that seeds of the item cover can hold tiles, so the rest is cut out first."""
    seeds = np.unique(_seeds(item, min_match))
    hit = np.flatnonzero(np.isin(_seeds(text, min_match), seeds))
    if not len(hit):
        return 0, 0, 0
    cut = np.flatnonzero(hit[1:] > hit[:-1] + min_match) + 1
    runs = [text[a : b + min_match] for a, b in zip(hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])], strict=True)]
    number = {int(h): k + 1 for k, h in enumerate(dict.fromkeys(item.tolist()))}
    flat: list[int] = []
    for k, r in enumerate(runs):
        flat += [number.get(int(h), -1) if int(h) in number else len(number) + 1 for h in r.tolist()]
        flat.append(len(number) + 2 + k)  # runs don't join
    got = tiles([number[int(h)] for h in item.tolist()], flat, min_match)
    return sum(n for _, _, n in got), len(got), max((n for _, _, n in got), default=0)


def _seeds(tokens: np.ndarray, k: int) -> np.ndarray:
    return tb.grams(tb.Tokens(1, np.zeros(len(tokens), np.int64), tokens, tokens, tokens), k)[1]


def _result(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, items, share, number, longest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(at)), pa.array(items), pa.array(share, pa.float64()), pa.array(number, pa.int32()), pa.array(longest, pa.int32())],
        names=["doc_id", "item_id", "coverage", "tiles", "longest"],
    )


def _hits(texts: pa.Array, index: Index, need: np.ndarray, min_match: int, coverage: float) -> list[tuple]:
    """Of a slice of texts: (text, item, covered share, tiles, longest tile) of every contamination."""
    tokens = tb.tokenize(texts)
    first, g = tb.grams(tokens, min_match)
    near = index.bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)]
    first, g = first[near], g[near]
    lo, hi = np.searchsorted(index.seeds, g, "left"), np.searchsorted(index.seeds, g, "right")
    count = hi - lo
    if not count.sum():
        return []
    # which items' places each text's seeds hit; a seed that a text repeats counts once
    doc, entry = _pairs(tokens.doc[first], lo, count)
    item, place = index.item[entry], index.place[entry]
    order = np.lexsort((place, item, doc))
    doc, item, place = doc[order], item[order], place[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1
    bounds, rows = tokens.bounds, []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)], strict=True):
        d, i = int(doc[a]), int(item[a])
        if _covered(place[a:b], min_match) >= need[i]:
            n, number, longest = tile_pair(index.tokens[i], tokens.hash[bounds[d] : bounds[d + 1]], min_match)
            if n >= need[i]:
                rows.append((d, index.ids[i], round(n / len(index.tokens[i]), 6), number, longest))
    return rows


def _pairs(doc: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and index entry of every seed that both have, each once."""
    some = np.flatnonzero(count)
    doc, lo, count = doc[some], lo[some], count[some]
    order = np.lexsort((lo, doc))
    doc, lo, count = doc[order], lo[order], count[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])])
    doc, lo, count = doc[fresh], lo[fresh], count[fresh]
    ends = np.cumsum(count)
    return np.repeat(doc, count), np.repeat(lo - ends + count, count) + np.arange(ends[-1])


def _scan(batches: Iterator[pa.RecordBatch], shared, min_match: int, coverage: float) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    need = index.need(coverage)
    for batch in batches:
        for part in tb.slices(batch):
            if rows := _hits(part.column("text"), index, need, min_match, coverage):
                yield _result(part.column("doc_id"), rows)


def _clean(batches: Iterator[pa.RecordBatch], at: int, shared, min_match: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """The rows, with all their columns, whose text (the column at ``at``) has no contamination."""
    index: Index = shared.value
    need = index.need(coverage)
    for batch in batches:
        start, good = 0, np.ones(batch.num_rows, bool)
        for part in tb.slices(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])):
            good[[start + r[0] for r in _hits(part.column("text"), index, need, min_match, coverage)]] = False
            start += part.num_rows
        yield batch if good.all() else batch.filter(pa.array(good))


#: Bits of the filter of benchmark seeds that the shuffled way broadcasts: 32 MB whatever the size of the benchmark.
FILTER_BITS = 28
_PAGE = 16  # bits of a place within a page of the filter


def _filter_pages(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The pages of the filter that a partition's seeds set."""
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = (batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        page = slot >> _PAGE
        order = np.argsort(page, kind="stable")
        slot, page = slot[order], page[order]
        cut = np.flatnonzero(np.diff(page)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(page)], strict=True):
            if b > a:
                pages.setdefault(int(page[a]), np.zeros(1 << _PAGE, bool))[slot[a:b] & ((1 << _PAGE) - 1)] = True
    for p, flags in pages.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["page", "flags"])


def _filter_union(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one number added up, sorted by number."""
    last, sum_ = None, None
    for batch in rows:
        for page, flags in zip(batch.column("page").to_pylist(), batch.column("flags"), strict=True):
            own = np.frombuffer(flags.as_buffer(), np.uint8)
            if page != last and last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sum_.tobytes()], pa.binary())], names=["page", "flags"])
            last, sum_ = page, own if page != last else sum_ | own
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([sum_.tobytes()], pa.binary())], names=["page", "flags"])


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for every value of the first ``bits`` bits of a seed, packed: set if a benchmark seed has it."""
    pages = seeds.select("seed").mapInArrow(lean(partial(_filter_pages, bits=bits)), "page bigint, flags binary")
    whole = pages.repartition("page").sortWithinPartitions("page").mapInArrow(lean(_filter_union), "page bigint, flags binary")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    each = (1 << _PAGE) // 8
    for r in whole.toLocalIterator():
        own = np.frombuffer(r.flags, np.uint8)
        out[r.page * each : r.page * each + len(own)] = own[: len(out)]
    return out


def _doc_seeds(batches: Iterator[pa.RecordBatch], k: int, shared, bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct seeds of each text that pass the filter."""
    flags = shared.value
    for batch in batches:
        for part in tb.slices(batch):
            tokens = tb.tokenize(part.column("text"))
            first, g = tb.grams(tokens, k)
            slot = (g >> np.uint64(64 - bits)).astype(np.int64)
            on = (flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
            doc, g = tokens.doc[first][on], g[on]
            order = np.lexsort((g, doc))
            doc, g = doc[order], g[order]
            if len(g):
                fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])
                yield pa.RecordBatch.from_arrays([tb.signed(g[fresh]), part.column("doc_id").take(pa.array(doc[fresh]))], names=["seed", "doc_id"])


def _item_seeds(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch):
            tokens = tb.tokenize(part.column("text"))
            first, g = tb.grams(tokens, k)
            doc = tokens.doc[first]
            sizes = np.diff(tokens.bounds)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [tb.signed(g), part.column("item").take(take), pa.array(sizes[doc].astype(np.int32)), pa.array((first - tokens.bounds[doc]).astype(np.int32))],
                names=["seed", "item", "size", "place"],
            )


def _tile(batches: Iterator[pa.RecordBatch], min_match: int, coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch):
            texts, items = tb.tokenize(part.column("text")), tb.tokenize(part.column("item_text"))
            tb_, ib, rows = texts.bounds, items.bounds, []
            for k in range(part.num_rows):
                item = items.hash[ib[k] : ib[k + 1]]
                n, number, longest = tile_pair(item, texts.hash[tb_[k] : tb_[k + 1]], min_match)
                if n >= max(1.0, coverage * len(item)):
                    rows.append((k, part.column("item_id")[k].as_py(), round(n / len(item), 6), number, longest))
            if rows:
                yield _result(part.column("doc_id"), rows)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    broadcast_chars: int = BROADCAST_CHARS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Pairs of document and benchmark item whose tiles cover at least ``coverage`` of the item's tokens: ``doc_id``,
    ``item_id``, ``coverage`` (6 decimals), ``tiles`` (number), ``longest`` (tokens of the longest tile).

    Tokens are those of ``textbuf``. Null and empty texts match nothing, nor do items of fewer than ``min_match``
    tokens. Rows without identifier are left out. Repeated rows of the benchmark count once; each of the documents'
    repeated rows is reported. Of ties between tiles the first in the item, then in the text is taken. Very long texts
    are searched whole; equal tokens in a row cost time in proportion. An empty table on either side gives no rows.
    Other columns are ignored.

    Beyond ``broadcast_chars`` of benchmark text the seeds are shuffled. Only a filter of ``2 ** filter_bits`` bits is
    broadcast then; it leaves out the documents' seeds that no item has, before the shuffle.
    """
    docs = plain(docs, id_col, text_col).where("doc_id IS NOT NULL")
    items = _items(benchmark, item_col, item_text_col)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, coverage double, tiles int, longest int"
    if index := _small(items, min_match, broadcast_chars):
        return docs.mapInArrow(lean(partial(_scan, shared=index, min_match=min_match, coverage=coverage)), schema)
    items = items.withColumn("item", F.xxhash64("item_id", "item_text"))
    seeds = items.select("item", F.col("item_text").alias("text")).mapInArrow(lean(partial(_item_seeds, k=min_match)), "seed bigint, item bigint, size int, place int")
    known = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds, filter_bits))
    # sorted and shuffled, so that adaptive execution splits a seed that many documents have
    shared = docs.mapInArrow(lean(partial(_doc_seeds, k=min_match, shared=known, bits=filter_bits)), f"seed bigint, doc_id {kind}").join(seeds.hint("merge"), "seed")
    places = shared.groupBy("doc_id", "item").agg(F.first("size").alias("size"), F.array_sort(F.collect_set("place")).alias("p"))
    steps = F.zip_with(F.expr("slice(p, 2, size(p))"), F.expr("slice(p, 1, size(p) - 1)"), lambda a, b: F.least(a - b, F.lit(min_match)))
    bound = F.aggregate(steps, F.lit(min_match), lambda s, x: s + F.coalesce(x, F.lit(0)))
    pairs = places.where(bound >= F.greatest(F.lit(1.0), F.lit(coverage) * F.col("size"))).select("doc_id", "item")
    both = docs.join(pairs, "doc_id").join(items, "item").select("doc_id", "text", "item_id", "item_text")
    return both.mapInArrow(lean(partial(_tile, min_match=min_match, coverage=coverage)), schema)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id IS NOT NULL AND item_text IS NOT NULL").distinct()


def _small(items: DataFrame, min_match: int, broadcast_chars: int):
    """The broadcast index of a benchmark of up to ``broadcast_chars``, else None."""
    if (items.agg(F.sum(F.length("item_text"))).first()[0] or 0) > broadcast_chars:
        return None
    rows = sorted(map(tuple, items.collect()))
    return items.sparkSession.sparkContext.broadcast(build_index([r[0] for r in rows], [r[1] for r in rows], min_match))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    broadcast_chars: int = BROADCAST_CHARS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The documents that no item contaminates, with all their columns; keywords as for ``contaminated``.

    Each row is judged by its own text, whatever its identifier: rows without identifier like others, repeated rows
    alike, rows that share an identifier each for itself. Null and empty texts stay. Very long texts are searched
    whole. An empty table on either side removes nothing.
    """
    if index := _small(_items(benchmark, item_col, item_text_col), min_match, broadcast_chars):
        return docs.mapInArrow(lean(partial(_clean, at=docs.columns.index(text_col), shared=index, min_match=min_match, coverage=coverage)), docs.schema)
    name = unused(docs, "row")
    marked = docs.withColumn(name, row_hash(docs))
    bad = contaminated(marked, benchmark, name, text_col, item_col, item_text_col, min_match, coverage, broadcast_chars, filter_bits)
    return semi(marked, materialized(bad.select(F.col("doc_id").alias(name)).distinct()), name, "left_anti").drop(name)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES: dict[str, str] = {}
