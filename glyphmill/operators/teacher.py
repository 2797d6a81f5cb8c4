"""A place for an external model whose vectors are distilled.

The transformer itself is the caller's: any object with ``states(texts) -> (array [n, t, d], mask [n, t])``. This
module does what surrounds it: the query prefix, pooling of the first unmasked place, the cut to a prefix of the
vector with a new normalisation, and quantisation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .network import unit

FULL, SHORT, LIMIT = 768, 256, 0.3


class Model(Protocol):
    def states(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]: ...


def pool_first(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return states[np.arange(len(states)), mask.argmax(1)]


def quantize(x: np.ndarray, limit: float) -> np.ndarray:
    return np.rint(np.clip(limit + x.astype(np.float64), 0, 2 * limit) / (2 * limit / 255)).astype(np.uint8)


def dequantize(q: np.ndarray, limit: float) -> np.ndarray:
    return np.float32(-limit) + np.float32(2 * limit / 255) * q.astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch], make: Callable[[], Model], prefix: str, size: int, short: int | None, limit: float | None) -> Iterator[pa.RecordBatch]:
    model = make()
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            states, mask = model.states([prefix + (t or "") for t in part.column(1).to_pylist()])
            v = pool_first(states, mask)
            v = unit(v[:, :short] if short else v)[0]
            flat = quantize(v, limit).astype(np.int16) if limit is not None else v.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * v.shape[1]).astype(np.int32)), pa.array(flat.reshape(-1)))], names=[batch.schema.names[0], "embedding"]
            )


def embed_with(docs: DataFrame, make: Callable[[], Model], is_query: bool = False, size: int = 64, short: int | None = None, limit: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``embedding``: floats, or with ``limit`` codes as ``smallint``. ``make`` builds the model once
    a task. A null text is embedded like an empty one."""
    two = docs.select(id_col, text_col)
    kind = T.ShortType() if limit is not None else T.FloatType()
    schema = T.StructType([two.schema[0], T.StructField("embedding", T.ArrayType(kind))])
    return two.mapInArrow(partial(_vectors, make=make, prefix="query: " if is_query else "", size=size, short=short, limit=limit), schema)
