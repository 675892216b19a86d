"""A pattern run described by a properties file: key = value lines, `!` or `#` before comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklode.operators import lsh, profile
from tracklode.operators.hotspot import DataError, InputError, PathError, RangeError
from tracklode.plans import pipeline
from tracklode.sources import io

# ---- fixed values: keys of the file and what holds without them ----
DEFAULTS = {
    "delimiter": ",", "semAreasMethod": "MINHASHLSH", "numOfHashTables": "5", "lshJoinThreshold": "0.8",
    "minSupport": "0.6", "maxPatternLength": "100", "maxDTofPatterns": "100",
    "maxIteration": "100", "mergeWindow": "0.001", "bandwidth": "10000",
    "bskm_distanceMethod": "cosine", "bskm_k": "20", "bskm_maxIterations": "100", "bskm_minDivisibleClusterSize": "10",
    "ms_k": "7", "ms_epsilon1": "0.05", "ms_epsilon2": "0.05", "ms_epsilon3": "0.07", "ms_ratioToStop": "1.0", "ms_yStarIter": "10",
    "ms_cmin": "3", "ms_normalisation": "true", "ms_w": "1", "ms_nbseg": "7", "ms_nbblocs1": "10", "ms_nbblocs2": "5", "ms_nbLabelIter": "1",
    "minPtsFlag": "1", "minCellInClusterFlag": "0", "ratioFlag": "1",
}


def read_properties(path: str) -> dict[str, str]:
    """The settings of a file over the defaults. A file that can't be read is a PathError, a line without
    a key or value an InputError."""
    out = dict(DEFAULTS)
    try:
        lines = open(path, encoding="utf-8").read().splitlines()
    except OSError as e:
        raise PathError(f"can't read {path}: {e}") from e
    for n, line in enumerate(lines, 1):
        line = line.strip()
        if line and line[0] not in "!#":
            key, sign, value = line.partition("=")
            if not sign or not key.strip():
                raise InputError(f"{path}, line {n}: not key = value")
            out[key.strip()] = value.strip()
    return out


def source(settings: dict[str, str]) -> str:
    if not settings.get("data_file"):
        raise InputError("no input: give data_file")
    return "/".join(x.rstrip("/") for x in (settings.get("storage"), settings["data_file"]) if x)


def _number(settings, key, kind=float, low=None, high=None):
    try:
        value = kind(settings[key])
    except ValueError as e:
        raise InputError(f"{key} = {settings[key]!r} is no {kind.__name__}") from e
    if low is not None and value < low or high is not None and value > high:
        raise RangeError(f"{key} = {value} lies outside {low} to {high}")
    return value


def area_options(df: DataFrame, types: list[str], settings: dict[str, str]) -> tuple[DataFrame, dict]:
    """The points with what the area method needs, and its options."""
    method, number = settings["semAreasMethod"], lambda *a, **k: _number(settings, *a, **k)
    mask = [int(x) for x in settings.get("selectedDimensions", ",".join("1" * len(types))).split(",")]
    if len(mask) != len(types):
        raise InputError("selectedDimensions needs one value a dimension")
    chosen = io.selected_columns(df, mask)
    if not chosen:
        raise InputError("selectedDimensions selects none")
    kind = dict(zip(df.columns, types))
    numeric, nominal = [c for c in chosen if kind[c] != "S"], [c for c in chosen if kind[c] == "S"]

    def sizes(key):
        if key not in settings:
            raise InputError(f"{method} needs {key}")
        all_of = dict(zip(df.columns, (float(x) for x in settings[key].split(","))))
        return {c: all_of[c] for c in numeric}

    if method == "MINHASHLSH":
        return profile.active_indexes(df, numeric, nominal), {"active": "active", "ab": lsh.coefficients(number("numOfHashTables", int, 1), 7), "threshold": number("lshJoinThreshold", low=0.0), "pairwise": True}
    if method == "CELLS":
        return df, {"numeric": sizes("cellSizePerDim"), "nominal": nominal}
    if method in ("PATCHWORK", "MERGINGCELLS"):
        grid = {"eps": sizes("epsilonFlag")}
        return df, grid if method == "MERGINGCELLS" else grid | {"ratio": number("ratioFlag"), "min_pts": number("minPtsFlag", int), "min_cells": number("minCellInClusterFlag", int)}
    if method == "DBSCAN":
        eps = max(sizes("epsilonFlag").values())
        return df, {"cols": numeric, "eps": eps, "min_pts": number("minPtsFlag", int, 1)}
    dense = profile.dense_features(df, numeric, nominal)
    if method == "BISECTING":
        return dense, {"vec": "features", "dim": len(chosen), "k": number("bskm_k", int, 1), "name": settings["bskm_distanceMethod"], "iterations": number("bskm_maxIterations", int, 1), "min_size": number("bskm_minDivisibleClusterSize")}
    if method == "MSLSH":
        return dense, {
            "vec": "features", "dim": len(chosen), "k": number("ms_k", int, 1), "epsilon1": number("ms_epsilon1"), "epsilon2": number("ms_epsilon2"), "epsilon3": number("ms_epsilon3"), "ratio_to_stop": number("ms_ratioToStop"),
            "iterations": number("ms_yStarIter", int, 1), "cmin": number("ms_cmin", int, 0), "normalise": settings["ms_normalisation"] == "true", "w": number("ms_w"), "segments": number("ms_nbseg", int, 1), "slices": number("ms_nbblocs1", int, 1), "label_slices": number("ms_nbblocs2", int, 1), "label_models": number("ms_nbLabelIter", int, 1),
        }
    raise InputError(f"semAreasMethod = {method!r} can't be run from a file")


def run(spark: SparkSession, path: str, settings: dict[str, str]) -> pipeline.PatternRun:
    """Points of a delimited file to patterns, as the settings say. Input without rows is a DataError."""
    if not settings.get("dimensionTypes"):
        raise InputError("dimensionTypes is missing")
    types = [t.strip() for t in settings["dimensionTypes"].split(",")]
    df = io.read_points(spark, path, types, settings["delimiter"])
    if df.isEmpty():
        raise DataError(f"{path} has no usable rows")
    points, options = area_options(df, types, settings)
    spatial = [c for c, t in list(zip(df.columns, types))[2:5] if t != "S"]
    return pipeline.mine(
        points, settings["semAreasMethod"], options, spatial=spatial, min_support=_number(settings, "minSupport", low=0.0, high=1.0), max_gap=_number(settings, "maxDTofPatterns", int, 0), max_length=_number(settings, "maxPatternLength", int, 1),
        bandwidth=_number(settings, "bandwidth"), merge_window=_number(settings, "mergeWindow"), max_iterations=_number(settings, "maxIteration", int, 1),
    )
