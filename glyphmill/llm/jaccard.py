"""N-gram Jaccard join: MinHash banding on word n-grams, then verification on the full n-gram sets.

1. One scan computes each text's set of hashed word n-grams, a fingerprint of the set and its MinHash values. Texts
   with equal sets (exact copies above all) become one node with a number of copies, so that a group of thousands of
   copies costs as much as one text.
2. Nodes are shuffled on band keys. A pair of nodes is taken in the first band that they share and nowhere else, so
   candidates need no deduplication. A band key is a hash of the very values that decide which band is the first.
3. Buckets are cut into blocks of ``BLOCK`` nodes, and every pair of blocks is a group of its own, so a bucket that
   holds a third of all nodes is spread over many tasks and no group grows with the data.
4. The n-gram sets of a group's nodes meet once, and the exact Jaccard similarity decides. What leaves the group is a
   number of links for each node and the edges of a spanning forest, not a row for each pair.

The numbers of bands and rows follow from the threshold and the recall wanted at it (``band_plan``). No bucket and
no number of partners is capped, and nothing but the exact similarity (and the sizes of the sets, which bound it)
rules a candidate out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import lean, lookup, materialized, row_hash, semi, table, unused

NGRAM, THRESHOLD, RECALL = 3, 0.5, 0.95
#: Nodes of a bucket in one block.
BLOCK = 1024
#: The low bits of a band key are the number of its band.
_BAND_BITS = 7


def band_plan(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """Bands and rows per band: the most rows (fewest false candidates) whose bands reach the recall at the
    threshold with at most ``most_hashes`` hash functions."""
    best = (0, 0)
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands < 1 << _BAND_BITS and (bands * rows <= most_hashes or not best[0]):
            best = (bands, rows)
    if not best[0]:
        raise ValueError(f"a recall of {recall} at {threshold} needs more than {1 << _BAND_BITS} bands")
    return best


def gram_sets(tokens: tb.Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and bounds. A text of 1 to n - 1 tokens has one gram, all its
    tokens; a text without tokens has none."""
    first, g = tb.grams(tokens, n)
    bounds = np.searchsorted(tokens.doc[first], np.arange(tokens.texts + 1))
    whole = tokens.bounds
    sets = []
    for i in range(tokens.texts):
        x = g[bounds[i] : bounds[i + 1]]
        if len(x) > 1:
            x = np.sort(x)
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif not len(x) and whole[i + 1] > whole[i]:
            h = np.uint64(whole[i + 1] - whole[i])
            with np.errstate(over="ignore"):
                for t in tokens.hash[whole[i] : whole[i + 1]]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + t
            x = tb.mix(np.array([h]))
        sets.append(x)
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _fingerprints(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.add.reduceat(tb.mix(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
    return tb.mix(total + sizes.astype(np.uint64))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Key of every band of signatures of ``bands * rows`` 16-bit values."""
    keys = np.empty((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sig), b + 1, np.uint64)
            for r in range(rows):
                h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(np.uint64))
            keys[:, b] = (h >> np.uint64(_BAND_BITS) << np.uint64(_BAND_BITS)) | np.uint64(b)
    return keys


def _sign(batches: Iterator[pa.RecordBatch], n: int, count: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    by = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    for batch in batches:
        for part in tb.slices(batch):
            flat, bounds = gram_sets(tb.tokenize(part.column("text")), n)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            none = sizes == 0
            prints = np.zeros(len(sizes), np.int64)
            values: list[bytes | None] = [None] * len(sizes)
            if len(some):
                starts = bounds[:-1][some]
                prints[some] = _fingerprints(flat, starts, sizes[some]).view(np.int64)
                x = (flat >> np.uint64(32)).astype(np.uint32)
                least = np.empty((len(some), count), np.uint16)
                with np.errstate(over="ignore"):
                    for k in range(count):
                        least[:, k] = np.minimum.reduceat(x * by[k] + plus[k], starts) & np.uint32(0xFFFF)
                for i, v in zip(some.tolist(), least, strict=True):
                    values[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), pa.array(prints, mask=none), pa.array(sizes.astype(np.int32)), pa.array(values, pa.binary())],
                names=["doc_id", "row", "fp", "n", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1 << 13):
            part = batch.slice(lo, 1 << 13)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, bands * rows)
            fp = np.repeat(part.column("fp").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([tb.signed(band_keys(sig, bands, rows).reshape(-1)), pa.array(fp)], names=["key", "fp"])


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted on ``key``, without those whose key occurs once, with their block in the bucket. Only one row and
    a count are carried on, so a bucket of any size passes through."""
    last_key, last_fp, at, shown = None, 0, 0, False  # the row before: its place in the bucket, whether it is out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if last_key is not None:
            key, fp = np.concatenate([[last_key], key]), np.concatenate([[last_fp], fp])
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(fresh)
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
        if last_key is not None:
            place[: start[1] if len(start) > 1 else len(key)] += at
        same = np.zeros(len(key), bool)
        same[1:] = ~fresh[1:]
        same[:-1] |= ~fresh[1:]
        same |= place > 0
        out_before = last_key is not None and shown
        last_key, last_fp, at, shown = int(key[-1]), int(fp[-1]), int(place[-1]), bool(same[-1])
        if out_before:
            same[0] = False
        out = np.flatnonzero(same)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(fp[out]), pa.array((place[out] // size).astype(np.int32))], names=["key", "fp", "block"])


def _wide(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_list(kind):
        return pa.large_list(kind.value_type)
    return {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}.get(kind, kind)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows. Strings, binaries and lists get 64-bit offsets, as 32 bits end at 2 GB a column."""
    wide = pa.schema([(f.name, _wide(f.type)) for f in held[0].schema])
    out = pa.Table.from_batches(held).cast(wide).combine_chunks().to_batches()
    if len(out) != 1:
        raise ValueError(f"{len(out)} batches where one was expected")
    return out[0]


def _by_key(batches: Iterator[pa.RecordBatch], least: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Batches of rows that are sorted on ``key``, rejoined so that all rows of a key are in one batch, with
    64-bit offsets."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        key = batch.column("key").to_numpy()
        same = np.flatnonzero(key != key[-1])
        cut = int(same[-1]) + 1 if len(same) else 0
        if not cut and len(held) > 1 and held[-2].column("key")[-1].as_py() == int(key[-1]):
            continue  # the last key goes on
        done, held = [*held[:-1], batch.slice(0, cut)], [batch.slice(cut)]
        rows = held[0].num_rows
        if out := [b for b in done if b.num_rows]:
            yield _joined(out)
    if held:
        yield _joined(held)


def _pairs(batches: Iterator[pa.RecordBatch], bands: int, rows: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidates of every group: each node with its partners among those after it. In a group of two blocks
    (``side`` 1 and 2) only nodes of different blocks are paired."""
    for batch in _by_key(batches):
        key, band = batch.column("key").to_numpy(), batch.column("band").to_numpy()
        fp, n, side = batch.column("fp").to_numpy(), batch.column("n").to_numpy(), batch.column("side").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, bands * rows)
        left, right, shift = [], [], 1
        at = np.arange(len(key))
        while len(at := at[at < len(key) - shift]) and len(at := at[key[at] == key[at + shift]]):
            for lo in range(0, len(at), 1 << 14):
                i = at[lo : lo + (1 << 14)]
                j = i + shift
                near = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & (band[i] == band[j]) & ((side[i] == 0) | (side[i] != side[j]))
                i, j = i[near], j[near]
                if not len(i):
                    continue
                first = (sig[i] == sig[j]).reshape(-1, bands, rows).all(2).argmax(1)
                keep = first == band[i]
                left.append(i[keep])
                right.append(j[keep])
            shift += 1
        i = np.concatenate(left) if left else np.zeros(0, np.int64)
        j = np.concatenate(right) if right else np.zeros(0, np.int64)
        if not len(i):
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        nodes = np.union1d(i, j)
        bounds = np.concatenate([np.searchsorted(i, nodes), [len(i)]])
        for lo in range(0, len(nodes), 1 << 12):
            hi = min(len(nodes), lo + (1 << 12))
            a, b = bounds[lo], bounds[hi]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[nodes[lo:hi]]), pa.array(fp[nodes[lo:hi]]), tb.lists(pa.array(fp[j[a:b]]), bounds[lo : hi + 1] - a)],
                names=["key", "fp", "partners"],
            )


def _with_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row with the n-gram set for every group that needs the text. ``uses`` is one array a text, so slices are
    kept small by text and the sets of a text go out a few at a time."""
    for batch in batches:
        for part in tb.slices(batch):
            flat, bounds = gram_sets(tb.tokenize(part.column("text")), n)
            sizes = np.diff(bounds)
            small = (flat >> np.uint64(32)).astype(np.uint32)
            some = np.flatnonzero(sizes)
            prints = np.zeros(len(sizes), np.uint64)
            if len(some):
                prints[some] = _fingerprints(flat, bounds[:-1][some], sizes[some])
            prints = prints.view(np.int64)
            keys: list[int] = []
            fps: list[int] = []
            copies: list[int] = []
            sets: list[bytes] = []
            held = 0
            for i, (fp, times, uses) in enumerate(zip(part.column("fp").to_pylist(), part.column("copies").to_pylist(), part.column("uses").to_pylist(), strict=True)):
                if prints[i] != fp:
                    raise ValueError("a text doesn't have the fingerprint that it had before: the input changes between reads")
                grams = small[bounds[i] : bounds[i + 1]].tobytes()
                for use in uses:
                    keys.append(use)
                    fps.append(fp)
                    copies.append(times)
                    sets.append(grams)
                    held += len(grams)
                    if held > 1 << 24:
                        yield _sets(keys, fps, copies, sets)
                        keys, fps, copies, sets, held = [], [], [], [], 0
            if keys:
                yield _sets(keys, fps, copies, sets)


def _sets(keys: list[int], fps: list[int], copies: list[int], sets: list[bytes]) -> pa.RecordBatch:
    none = pa.array([None] * len(keys), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(fps, pa.int64()), pa.array(copies, pa.int64()), none, pa.array(sets, pa.binary())], names=["key", "fp", "copies", "partners", "grams"]
    )


def _group_pairs(sets: list[np.ndarray], partners: list[list[int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every set with partners: its number, theirs, and the exact similarities."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) > 2:
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flags = np.zeros(len(values), bool)
    for k, others in enumerate(partners):
        if not others:
            continue
        m = np.array(others)
        if len(sets) > 2:
            flags[ids[bounds[k] : bounds[k + 1]]] = True
            both = np.empty(len(m), np.int64)
            lo = 0
            for hi in [*(np.flatnonzero(np.diff(np.cumsum(sizes[m]) >> 22)) + 1).tolist(), len(m)]:  # four million grams at a time
                where = np.concatenate([ids[bounds[x] : bounds[x + 1]] for x in others[lo:hi]])
                both[lo:hi] = np.add.reduceat(flags[where].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[m[lo:hi]])[:-1]]))
                lo = hi
            flags[ids[bounds[k] : bounds[k + 1]]] = False
        else:
            both = np.array([len(np.intersect1d(sets[k], sets[x], assume_unique=True)) for x in others])
        yield k, m, both / (sizes[k] + sizes[m] - both)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, every: bool) -> Iterator[pa.RecordBatch]:
    """Of every group, with ``every`` all pairs ``(a, b, jaccard)``, else ``(a, b)`` of a spanning forest of the
    pairs and ``(a, links)``, the number of copies that the node's partners in this group have."""
    for batch in _by_key(batches, 1 << 10):
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        copies = batch.column("copies").to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        grams, partners = batch.column("grams"), batch.column("partners")
        is_set = np.asarray(grams.is_valid())
        out_a: list[int] = []
        out_b: list[int | None] = []
        out_j: list[float | None] = []
        out_n: list[int | None] = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = lo + np.flatnonzero(is_set[lo:hi])
            at = {int(f): k for k, f in enumerate(fp[own])}
            sets = [np.frombuffer(grams[k].as_buffer(), np.uint32) for k in own.tolist()]
            lists: list[list[int]] = [[] for _ in sets]
            for k in (lo + np.flatnonzero(~is_set[lo:hi])).tolist():
                lists[at[int(fp[k])]] += [at[f] for f in partners[k].as_py()]
            times, links = copies[own], np.zeros(len(own), np.int64)
            root = list(range(len(own)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for k, m, j in _group_pairs(sets, lists):
                m, j = m[j >= threshold], j[j >= threshold]
                links[k] += int(times[m].sum())
                np.add.at(links, m, int(times[k]))
                for x, v in zip(m.tolist(), j.tolist(), strict=True):
                    if every or find(x) != find(k):
                        root[find(x)] = find(k)
                        out_a.append(int(fp[own[k]]))
                        out_b.append(int(fp[own[x]]))
                        out_j.append(v)
                        out_n.append(None)
            if not every:
                for k in np.flatnonzero(links).tolist():
                    out_a.append(int(fp[own[k]]))
                    out_b.append(None)
                    out_j.append(None)
                    out_n.append(int(links[k]))
        if out_a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_j, pa.float64()), pa.array(out_n, pa.int64())], names=["a", "b", "jaccard", "links"]
            )


def _groups(shared: DataFrame) -> DataFrame:
    """``(key, band, side, fp)``: the groups in which each node is compared. A bucket of one block is a group; of a
    larger one every pair of blocks is a group, with the first block as side 1 and the second as side 2."""
    band = (F.col("key").bitwiseAND((1 << _BAND_BITS) - 1)).cast("int").alias("band")
    more = materialized(shared.where("block > 0").groupBy("key").agg((F.max("block") + 1).alias("blocks")))
    marked = lookup(shared, more, "key")
    one = marked.where("blocks IS NULL").select("key", band, F.lit(0).alias("side"), "fp")
    other = marked.where("blocks IS NOT NULL").select("key", band, "block", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2)
    return one.unionByName(other.select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("key"), "band", side.alias("side"), "fp"))


def similar_nodes(docs: DataFrame, n: int, threshold: float, recall: float, every: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a table with ``doc_id``, ``row`` (a hash of the row, see ``row_hash``) and ``text``:

    - ``signed``: ``(doc_id, row, fp)`` of every row, where ``fp`` is the fingerprint of its n-gram set, null for a text without tokens;
    - ``nodes``: ``(fp, copies, first_id)``;
    - what ``_verify`` gives of the nodes.
    """
    bands, rows = band_plan(threshold, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = materialized(docs.mapInArrow(lean(partial(_sign, n=n, count=bands * rows)), f"doc_id {kind}, row struct<a:bigint,b:bigint>, fp bigint, n int, sig binary"))
    nodes = materialized(
        signed.where("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    )
    keyed = nodes.select("fp", "sig").mapInArrow(lean(partial(_bands, bands=bands, rows=rows)), "key bigint, fp bigint")
    shared = materialized(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(partial(_numbered, size=block)), "key bigint, fp bigint, block int"))
    held = _groups(shared).join(nodes.select("fp", "n", "sig"), "fp")
    found = materialized(held.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(partial(_pairs, bands=bands, rows=rows, threshold=threshold)), "key bigint, fp bigint, partners array<bigint>"))
    uses = materialized(found.groupBy("fp").agg(F.collect_list("key").alias("uses")).join(nodes.select("fp", "row", "copies"), "fp"))
    texts = semi(docs.select("row", "text"), uses.select("row"), "row").dropDuplicates(["row"]).join(uses.hint("shuffle_hash"), "row").select("text", "fp", "copies", "uses")
    sets = texts.mapInArrow(lean(partial(_with_sets, n=n)), "key bigint, fp bigint, copies bigint, partners array<bigint>, grams binary")
    wanted = found.where(F.size("partners") > 0).select("key", "fp", F.lit(None).cast("bigint").alias("copies"), "partners", F.lit(None).cast("binary").alias("grams"))
    both = sets.unionByName(wanted).repartition("key").sortWithinPartitions("key", "fp")
    verified = both.mapInArrow(lean(partial(_verify, threshold=threshold, every=every)), "a bigint, b bigint, jaccard double, links bigint")
    return signed.select("doc_id", "row", "fp"), nodes.select("fp", "copies", "first_id"), verified


def _own(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    mine = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *([] if row is None else [row.alias("row")]))
    return mine if row is not None else mine.withColumn("row", row_hash(mine))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The classes of the join of a table with itself on a Jaccard similarity of word n-grams of at least
    ``threshold``: for each row ``doc_id``; ``class_id``, the smallest identifier among the texts that a chain of
    similar pairs connects with it; and ``links``, the number of other rows whose texts are similar to its own, its
    copies among them.

    Tokens are those of ``textbuf``; sets are compared on 32-bit n-gram hashes and texts with equal 64-bit
    fingerprints of their sets count as equal. Of the pairs at the threshold the share ``recall`` is expected, of
    more similar ones more; every pair found is verified on the full sets.

    One row comes out for each row that goes in. Null or empty texts and texts without a token match nothing: they
    are in a class of their own without links. A text of 1 to n - 1 tokens is one gram, so it matches only texts with
    the same tokens. A row without identifier is compared like others; its class is null if no other row of it has
    one. Repeated rows are links of each other. Very long texts are compared whole. Of ties, as in a class of equal
    texts, the smallest identifier names the class. An empty table gives no rows. Other columns are ignored.
    """
    signed, nodes, verified = similar_nodes(_own(docs, id_col, text_col), n, threshold, recall, block=block)
    verified = materialized(verified)
    links = verified.where("links IS NOT NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    named = _named(nodes.join(links, "fp", "left"), verified)
    named = materialized(named.where("copies > 1 OR links IS NOT NULL").select("fp", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    out = lookup(signed.select("doc_id", "fp"), named, "fp")
    alone = F.col("links").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def _named(nodes: DataFrame, verified: DataFrame) -> DataFrame:
    """Nodes with ``root``, the smallest fingerprint of their class, and ``class_id``, its smallest identifier."""
    group = components(verified.where("b IS NOT NULL"))
    rooted = nodes.join(group, nodes["fp"] == group["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    return rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("class_id")), "root")


def representative_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``jaccard_join`` in a form that doesn't expand copies: ``(a, b, jaccard)`` between fingerprints
    (6 decimals), each pair of different sets once, and the membership ``(doc_id, fp)`` of all rows whose text has a
    token. Rows with the same fingerprint have equal sets, so they are pairs of similarity 1. Nulls, ties and repeated
    rows as there."""
    signed, _, verified = similar_nodes(_own(docs, id_col, text_col), n, threshold, recall, every=True, block=block)
    pairs = verified.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("jaccard", 6).alias("jaccard"))
    return pairs, signed.where("fp IS NOT NULL").select("doc_id", "fp")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of the connected component of every node that has an edge: ``(node, root)``.

    Alternates joining each node's larger neighbours to its smallest neighbour with joining its smaller ones
    (large and small stars), so the number of rounds grows with the logarithm of the longest path. A node's
    neighbours are never collected: their minimum is aggregated and joined to the edges again. Each round is
    checkpointed; it ends when the edges no longer change.
    """
    now = materialized(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("m").alias("u"), "v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select("m", F.explode(F.array("u", "v")).alias("v")).where("v > m").select(F.col("m").alias("u"), "v").distinct()
        now = materialized(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        last = mark


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Of each class of ``jaccard_join`` the row with the smallest identifier, with all its columns.

    Rows are told apart by a hash of all their columns, not by identifier, so a text isn't lost because its
    identifier is that of a copy, and copies without identifier go too; rows without identifier come after those with
    one. Of equal identifiers the row with the smallest hash stays, of rows that are repeated whole one. Null and
    empty texts and texts without a token match nothing and all stay. An empty table gives no rows.
    """
    row = row_hash(docs)
    signed, nodes, verified = similar_nodes(_own(docs, id_col, text_col, row), n, threshold, recall, block=block)
    named = _named(nodes, materialized(verified)).select("fp", "root")
    crowded = materialized(named.join(nodes.where("copies > 1").select("fp"), "fp", "left_semi").union(named.where("fp <> root")).union(named.where("fp <> root").select("root", "root")).distinct())
    rows = materialized(lookup(signed.where("fp IS NOT NULL"), crowded, "fp").where("root IS NOT NULL").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key")))
    first = rows.groupBy("root").agg(F.min("key").alias("key"))
    kept = materialized(first.select(F.col("key.row").alias("row")))
    extra = rows.select(F.col("key.row").alias("row")).groupBy("row").count()
    extra = materialized(extra.join(kept.withColumn("kept", F.lit(True)), "row", "left").where("kept IS NULL OR count > 1").select("row", F.coalesce("kept", F.lit(False)).alias("kept")))
    name = unused(docs, "row")
    marked = docs.withColumn(name, row)
    stay = semi(marked, extra.select(F.col("row").alias(name)), name, "left_anti")
    again = extra.where("kept").select(F.col("row").alias(name))
    if again.isEmpty():
        return stay.drop(name)
    return stay.unionByName(semi(marked, again, name).dropDuplicates([name])).drop(name)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES: dict[str, str] = {}
