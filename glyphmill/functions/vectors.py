"""Functions on ``array<float>`` and ``array<double>`` columns. Sums run in double, in the order of the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at unit length, in double. A zero vector stays as it is; null gives null."""
    length = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, n).otherwise(1.0))
    return F.get(F.transform(length, lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))  # bound once, not for each value


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0).cast("float")))


def truncate_and_normalize(v: Column, dims: int) -> Column:
    """The first ``dims`` values, normalised after the cut."""
    return l2_normalize(F.slice(v, 1, dims))


def quantize(v: Column, limit: float) -> Column:
    """Codes 0 to 255 of values in [-limit, limit], rounded half to even; values beyond are clipped."""
    wide = F.lit(2.0 * limit)
    return F.transform(v, lambda x: F.rint(F.greatest(F.lit(0.0), F.least(wide, F.lit(float(limit)) + x)) / (wide / 255)).cast("smallint"))


def dequantize(codes: Column, limit: float) -> Column:
    """Floats of codes: -limit plus the code times the bin width, in single precision."""
    width = F.lit(2.0 * limit / 255).cast("float")
    return F.transform(codes, lambda q: (F.lit(-float(limit)).cast("float") + width * q.cast("float")).cast("float"))


def first_unmasked(states: Column, mask: Column) -> Column:
    """The state at the first place whose mask is 1; null if none is."""
    at = F.array_position(mask, 1)
    return F.when(at > 0, F.get(states, (at - 1).cast("int")))


def expected_label(labels: Column, scores: Column) -> Column:
    """Sum of labels weighted by their scores."""
    return dot(labels, scores)
