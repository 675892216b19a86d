"""Column builders over array<double>: vector algebra and distances, all inside the JVM.

Null arrays give null. Arrays of unequal length are padded with nulls by zip_with and give null sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pair(a, b, f) -> Column:
    return F.zip_with(_c(a), _c(b), f)


def _is_column(b) -> bool:
    return isinstance(b, (str, Column))


def _elementwise(a, b, f) -> Column:
    """Vector with vector (column) or vector with scalar (number)."""
    return _pair(a, b, f) if _is_column(b) else F.transform(_c(a), lambda x: f(x, F.lit(float(b))))


def add(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def sub(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def sub_from(b: float, a) -> Column:
    """Scalar minus vector."""
    return F.transform(_c(a), lambda x: F.lit(float(b)) - x)


def mul(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x * y)


def div(a, b) -> Column:
    """Division by zero gives null."""
    return _elementwise(a, b, lambda x, y: F.try_divide(x, y))


def div_from(b: float, a) -> Column:
    """Scalar divided by vector."""
    return F.transform(_c(a), lambda x: F.try_divide(F.lit(float(b)), x))


def apply(a, f) -> Column:
    return F.transform(_c(a), f)


def power(a, p: float) -> Column:
    return apply(a, lambda x: F.pow(x, F.lit(float(p))))


def sqrt(a) -> Column:
    return apply(a, F.sqrt)


def absolute(a) -> Column:
    return apply(a, F.abs)


def exp(a) -> Column:
    return apply(a, F.exp)


def log(a) -> Column:
    return apply(a, F.log)


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(_pair(a, b, lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def least(a) -> Column:
    return F.array_min(_c(a))


def largest(a) -> Column:
    return F.array_max(_c(a))


def least_index(a) -> Column:
    """Position from 0 of the first smallest element."""
    return (F.array_position(_c(a), F.array_min(_c(a))) - 1).cast("int")


def largest_index(a) -> Column:
    return (F.array_position(_c(a), F.array_max(_c(a))) - 1).cast("int")


def part(a, start: int, end: int) -> Column:
    """Elements start … end - 1, counted from 0."""
    return F.slice(_c(a), start + 1, end - start)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def steps(start: int, end: int) -> Column:
    """start, start + 1, … end as doubles."""
    return F.transform(F.sequence(F.lit(start), F.lit(end)), lambda x: x.cast("double"))


# ---- distances ----


def squared_euclidean(a, b) -> Column:
    return total(_pair(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cosine(a, b) -> Column:
    """1 - cos; null where a norm is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def rv(a, b) -> Column:
    """1 - RV coefficient of the outer products, which is 1 - cos² (no outer product is built);
    1 where a norm is zero."""
    d = dot(a, b)
    return F.lit(1.0) - F.coalesce(F.try_divide(d * d, dot(a, a) * dot(b, b)), F.lit(0.0))


def rv_flat(a, b) -> Column:
    """RV of two symmetric matrices given as flat arrays: their cosine."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def jaccard(a, b) -> Column:
    """1 - |A∩B| / |A∪B| of two arrays of active indexes; null where both are empty."""
    common = F.size(F.array_intersect(_c(a), _c(b)))
    return F.lit(1.0) - F.try_divide(common.cast("double"), F.size(F.array_union(_c(a), _c(b))).cast("double"))


def hash_distance(a, b) -> Column:
    """Least number of unequal entries over the hash tables (one entry each: 0 or 1)."""
    return F.array_min(_pair(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)))


def ring(*differences) -> Column:
    """Chebyshev distance of grid coordinates."""
    return F.greatest(*(F.abs(_c(d)) for d in differences)) if len(differences) > 1 else F.abs(_c(differences[0]))


def almost_equal(a, b, tolerance: float = 1e-10) -> Column:
    return F.abs(_c(a) - _c(b)) <= F.lit(tolerance)


#: Distances by name; users may add their own builders.
DISTANCES = {"euclidean": euclidean, "sqeuclidean": squared_euclidean, "cosine": cosine, "RV": rv, "jaccard": jaccard}


def distance(name: str):
    """The builder of a named distance; an unknown name is a ValueError."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}; one of {', '.join(DISTANCES)}")
    return DISTANCES[name]


def register(name: str, builder) -> None:
    """Makes a builder (a, b) -> Column known under a name; a name in use is a ValueError."""
    if name in DISTANCES:
        raise ValueError(f"the distance {name!r} exists already")
    DISTANCES[name] = builder


def manhattan(a, b) -> Column:
    return total(_pair(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a, b) -> Column:
    return F.array_max(_pair(a, b, lambda x, y: F.abs(x - y)))


DISTANCES |= {"manhattan": manhattan, "chebyshev": chebyshev}


def within(cols: list[str], low: list[float], high: list[float], closed: bool = True) -> Column:
    """Point inside a box, bounds included or (closed=False) excluded."""
    out = F.lit(True)
    for c, a, b in zip(cols, low, high):
        out = out & ((F.col(c) >= a) & (F.col(c) <= b) if closed else (F.col(c) > a) & (F.col(c) < b))
    return out
