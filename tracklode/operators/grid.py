"""Points to grid cells and back, and what cells hold."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklode.functions.ids import number_rows
from tracklode.operators.profile import _wide, lexicon_ids, numeric_stats
from tracklode.runtime import is_finite


def offset_cells(df: DataFrame, numeric: dict[str, float], nominal: list[str] = ()) -> DataFrame:
    """Adds cell array<bigint>: trunc((v - min) / size) of each numeric dimension, then the lexicon id
    of each nominal one. Rows with a null or non-finite value in one of them have a null cell."""
    dims = list(numeric)
    t = lexicon_ids(df, list(nominal)) if nominal else df
    t = t.crossJoin(F.broadcast(_wide(numeric_stats(df, dims), dims, ["min"])))
    parts = [((F.col(d).cast("double") - F.col(f"_min_{d}")) / F.lit(float(s))).cast("bigint") for d, s in numeric.items()]
    ok = F.lit(True)
    for d in dims:
        ok = ok & is_finite(F.col(d).cast("double"))
    for d in nominal:
        parts.append(F.col(f"id_{d}").cast("bigint"))
        ok = ok & F.col(f"id_{d}").isNotNull()
    return t.select(*df.columns, F.when(ok, F.array(*parts)).alias("cell"))


def ceil_cells(df: DataFrame, eps: dict[str, float]) -> DataFrame:
    """Adds cell array<bigint>: ceil(v / eps) per dimension; null where a value is null or not finite."""
    ok = F.lit(True)
    for d in eps:
        ok = ok & is_finite(F.col(d).cast("double"))
    return df.withColumn("cell", F.when(ok, F.array(*(F.ceil(F.col(d).cast("double") / F.lit(float(e))).cast("bigint") for d, e in eps.items()))))


def cell_name(cell: str | Column = "cell") -> Column:
    """The coordinates joined by commas."""
    return F.array_join(F.transform(F.col(cell) if isinstance(cell, str) else cell, lambda x: x.cast("string")), ",")


def cell_counts(df: DataFrame) -> DataFrame:
    """(cell, n) of rows that have a cell."""
    return df.where("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"))


def cell_ids(cells: DataFrame, start: int = 1) -> DataFrame:
    """(cell, cell_id): dense ids from `start` in the order of the coordinates."""
    return number_rows(cells.select("cell").where("cell IS NOT NULL").distinct(), ["cell"], "cell_id", start)


def given_ids(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with one value per key: the smallest given."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def neighbours(cell: Column, dims: int, box: bool = True) -> Column:
    """Array of the neighbouring coordinates, the cell itself included: all 3^d, or (box=False) only
    those one step along one axis."""
    steps = itertools.product((-1, 0, 1), repeat=dims) if box else [tuple(0 for _ in range(dims)), *(tuple(s if i == j else 0 for j in range(dims)) for i in range(dims) for s in (-1, 1))]
    return F.array(*(F.array(*(cell[i] + F.lit(s) for i, s in enumerate(step))) for step in steps))


# ---- hotspot cells ----


def linear_id(x, y, t, nx, ny) -> Column:
    return x + y * nx + t * nx * ny


def from_linear(cell_id, nx, ny) -> tuple[Column, Column, Column]:
    """(x, y, t) of a linear id."""
    xy = nx * ny
    return F.pmod(cell_id, nx), F.floor(F.pmod(cell_id, xy) / nx).cast("bigint"), F.floor(cell_id / xy).cast("bigint")


def segment_bounds(segment, first, step) -> tuple[Column, Column]:
    """Least and largest time of a time segment."""
    return first + segment * step, first + (segment + 1) * step
