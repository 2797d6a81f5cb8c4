"""Model files: an archive of arrays, tensors with a JSON header for exchange, and n-gram summaries."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import pad_rows
from ..operators.embed import Embedder
from ..operators.network import Network

VERSION = 1


def _check(version: int) -> None:
    if version != VERSION:
        raise NotImplementedError(f"the model file has version {version}; version {VERSION} is supported")


def save(model: Embedder, path: str) -> None:
    """One archive of the tokenizer's JSON bytes, the version, the n-grams, the map from their hashes to their
    numbers, inverse frequencies and layers."""
    layers = {f"nn_layer_{k}": w for k, w in enumerate(model.network.layers)}
    with open(path, "wb") as f:
        np.savez(
            f, tokenizer=np.frombuffer(model.tokenizer.encode(), np.uint8), version=np.int64(VERSION), recognized_ngrams=model.ngrams, idf_values=model.idf,
            ngram_hash_to_ngram_idx_keys=model.hashes(), ngram_hash_to_ngram_idx_values=np.arange(len(model.ngrams), dtype=np.uint32),
            num_nn_layers=np.array([len(layers)]), **layers,
        )


def load(path: str) -> Embedder:
    """A model of an archive; arrays that it has besides are passed over. Another version is a
    ``NotImplementedError`` that names both."""
    with np.load(path, allow_pickle=False) as f:
        _check(int(f["version"]))
        layers = [f[f"nn_layer_{k}"] for k in range(int(f["num_nn_layers"].ravel()[0]))]
        ngrams = _as_uint32(f["recognized_ngrams"])
        return Embedder(f["tokenizer"].tobytes().decode(), ngrams, f["idf_values"], Network(layers))


def _as_uint32(ngrams: np.ndarray) -> np.ndarray:
    """N-grams with the padding of uint32, whichever type they come in."""
    if ngrams.dtype == np.uint32:
        return ngrams
    wide = ngrams.astype(np.int64)
    own = np.iinfo(ngrams.dtype).max
    return np.where((ngrams == own) | (wide < 0), np.iinfo(np.uint32).max, wide).astype(np.uint32)


_KINDS = {"F32": np.float32, "F64": np.float64, "I64": np.int64, "I32": np.int32, "U8": np.uint8}


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    """Named arrays in the safetensors layout: length of a JSON header, the header, the bytes."""
    names = {np.dtype(v): k for k, v in _KINDS.items()}
    head, at = {}, 0
    for name, x in tensors.items():
        head[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text)
        for x in tensors.values():
            f.write(np.ascontiguousarray(x).tobytes())


def read_tensors(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = json.loads(f.read(struct.unpack("<Q", f.read(8))[0]))
        data = f.read()
    return {n: np.frombuffer(data[slice(*h["data_offsets"])], _KINDS[h["dtype"]]).reshape(h["shape"]) for n, h in head.items() if n != "__metadata__"}


def state(model: Embedder) -> dict[str, np.ndarray]:
    """The model as named tensors, n-grams and map widened to 64 bits."""
    out = {
        "embedder.version": np.array([VERSION], np.int64), "embedder.tokenizer": np.frombuffer(model.tokenizer.encode(), np.uint8),
        "embedder.recognized_ngrams": model.ngrams.astype(np.int64), "embedder.ngram_keys": model.hashes(),
        "embedder.ngram_vals": np.arange(len(model.ngrams), dtype=np.int64), "embedder.idf_values": model.idf.astype(np.float32),
        "embedder.num_layers": np.array([len(model.network.layers)], np.int64),
    }
    return out | {f"embedder.nn_layer_{k}": w.astype(np.float32) for k, w in enumerate(model.network.layers)}


def from_state(tensors: dict[str, np.ndarray]) -> Embedder:
    _check(int(tensors["embedder.version"][0]))
    layers = [tensors[f"embedder.nn_layer_{k}"] for k in range(int(tensors["embedder.num_layers"][0]))]
    wide = tensors["embedder.recognized_ngrams"]
    return Embedder(tensors["embedder.tokenizer"].tobytes().decode(), _as_uint32(wide), tensors["embedder.idf_values"], Network(layers))


def export(model: Embedder, folder: str, **overrides) -> None:
    """A folder with the tensors and a configuration; keywords are put over the configuration."""
    os.makedirs(folder, exist_ok=True)
    write_tensors(os.path.join(folder, "model.safetensors"), state(model))
    config = {"max_ngram_length": model.max_ngram_length, "embedding_dim": model.embedding_dim, "format_version": VERSION} | overrides
    with open(os.path.join(folder, "config.json"), "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2)


def import_folder(folder: str) -> Embedder:
    """A model of a folder. A configuration that doesn't fit the tensors is a ``ValueError``."""
    model = from_state(read_tensors(os.path.join(folder, "model.safetensors")))
    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        config = json.load(f)
    for name in ("max_ngram_length", "embedding_dim"):
        if config.get(name, getattr(model, name)) != getattr(model, name):
            raise ValueError(f"{name} is {config[name]} in the configuration and {getattr(model, name)} in the tensors")
    return model


def save_summary(summary: DataFrame, totals: DataFrame, path: str) -> None:
    """A summary (``ngram``, ``n``, ``count``) and its one row of totals as two Parquet tables."""
    summary.write.parquet(f"{path}/ngrams")
    totals.write.parquet(f"{path}/totals")


def load_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/ngrams"), spark.read.parquet(f"{path}/totals")


def summary_to_archive(summary: DataFrame, total: int, path: str, longest: int) -> None:
    """A summary that fits the driver as an archive of arrays, rising by count."""
    rows = summary.orderBy("count", F.col("ngram").desc()).select("ngram", "count").toArrow()
    grams = pad_rows(rows.column("ngram").to_pylist(), longest)
    with open(path, "wb") as f:
        np.savez(f, ngrams=grams, approximate_counts=rows.column("count").to_numpy(), total_ngrams_seen=np.int64(total), hash_collisions_skipped=np.int64(0))


def summary_from_archive(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    with np.load(path, allow_pickle=False) as f:
        grams, counts, total = f["ngrams"], f["approximate_counts"], int(f["total_ngrams_seen"])
    pad = np.iinfo(grams.dtype).max
    rows = [([int(t) for t in g if t != pad], int((g != pad).sum()), int(c)) for g, c in zip(grams, counts, strict=True)]
    return spark.createDataFrame(rows, "ngram array<bigint>, n int, count bigint"), total
