"""Command lines: patterns, hotspot, dbscan, nearest and within.

    python -m tracklode.cli patterns --config run.properties --input points --output out

    python -m tracklode.cli hotspot -i points -o out -cs 0.05 -ct 1 -tk 50 -nd 3
    python -m tracklode.cli dbscan --ds-input points --ds-output out --eps 0.3 --numPts 10
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tracklode.functions.arrays import distance
from tracklode.operators import dbscan as D
from tracklode.operators import hotspot as H
from tracklode.plans import config
from tracklode.plans.pipeline import hotspots
from tracklode.runtime import session
from tracklode.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracklode")
    sub = p.add_subparsers(dest="command", required=True)
    h = sub.add_parser("hotspot", help="space-time hotspots of id,seconds,lat,lon points")
    h.add_argument("--input", "-i", required=True)
    h.add_argument("--output", "-o", required=True)
    h.add_argument("--cell-size", "-cs", type=float, default=0.05, help="degrees")
    h.add_argument("--cell-time", "-ct", type=float, default=1.0, help="days")
    h.add_argument("--top-k", "-tk", type=int, default=50)
    h.add_argument("--neighbor-distance", "-nd", type=int, default=3)
    for name in ("--cell-height", "--input-data", "--mode", "--flag"):
        h.add_argument(name, help=argparse.SUPPRESS)  # accepted and without effect
    m = sub.add_parser("patterns", help="trajectories to areas, frequent patterns and clustered transitions")
    m.add_argument("--config", required=True, help="a properties file")
    m.add_argument("--input", default=None, help="instead of storage and data_file")
    m.add_argument("--output", default=None, help="instead of results")
    for name in ("dbscan", "nearest", "within"):
        c = sub.add_parser(name)
        c.add_argument("--ds-master", default=None)
        c.add_argument("--ds-jar", default=None, help=argparse.SUPPRESS)
        c.add_argument("--ds-input", required=True)
        c.add_argument("--ds-output", required=True)
        c.add_argument("--distanceMeasure", default="euclidean")
        c.add_argument("--ds-debugOutput", default=None)
        c.add_argument("--eps", type=float, default=1e-4)
        c.add_argument("--numPts", type=int, default=3)
        c.add_argument("--dims", type=int, default=2)
        c.add_argument("--borderPointsAsNoise", action="store_true")
        c.add_argument("--npp", type=int, default=None, help=argparse.SUPPRESS)  # joins on cells need no partition size
        c.add_argument("--numBuckets", type=int, default=16)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(master=getattr(a, "ds_master", None))
    if a.command == "patterns":
        settings = config.read_properties(a.config)
        source = io.existing(spark, a.input or config.source(settings))
        target = a.output or settings.get("results")
        if not target:
            raise H.InputError("no output: give --output or results")
        run = config.run(spark, source, settings)
        io.write_table(run.areas, f"{target}/areas")
        io.write_table(run.patterns, f"{target}/patterns")
        io.write_table(io.flat_rows(run.clusters.withColumnRenamed("v", "value")), f"{target}/transitions")
        return 0
    if a.command == "hotspot":
        io.existing(spark, a.input)
        if a.top_k < 10:
            raise H.RangeError("top-k must be at least 10")
        if a.neighbor_distance < 0:
            raise H.RangeError("neighbour distance must not be negative")
        top = hotspots(io.read_hotspot_points(spark, a.input), "vessel_id", "lon", "lat", "ts", a.cell_size, int(a.cell_time * H.DAY_MS), a.neighbor_distance, a.top_k)
        io.write_hotspots(top.select("cell_id", "z"), a.output, [f"cell size {a.cell_size}, {a.cell_time} days, top {a.top_k}", "cell,  z,"], a.top_k)
        return 0
    distance(a.distanceMeasure)
    if a.distanceMeasure not in D.MEASURES:
        raise H.RangeError(f"cells need one of {', '.join(D.MEASURES)}")
    io.existing(spark, a.ds_input)
    if a.ds_debugOutput:
        spark.conf.set("tracklode.debug.dir", a.ds_debugOutput)
    pts = io.read_numeric_points(spark, a.ds_input, a.dims)
    cols = [f"c{i}" for i in range(a.dims)]
    df = io.write_debug(pts.select(*(F.col("features")[i].alias(c) for i, c in enumerate(cols))), "points")
    if a.command == "dbscan":
        io.write_labels(D.dbscan(df, cols, a.eps, a.numPts, a.borderPointsAsNoise, a.distanceMeasure).select(*cols, "cluster"), a.ds_output, *cols)
    elif a.command == "nearest":
        io.write_labels(D.nearest_histogram(df, cols, a.eps, a.numBuckets, a.distanceMeasure), a.ds_output, "lo")
    else:
        io.write_labels(D.within_eps_histogram(df, cols, a.eps, a.numBuckets, a.distanceMeasure), a.ds_output, "lo")
    return 0


if __name__ == "__main__":
    sys.exit(main())
