"""Scans, sinks, models, command line, the entry contract and the whole pipeline."""

import json

import pytest
from pyspark.sql import functions as F

from tracklode import cli
from tracklode.operators import kmeans, lsh
from tracklode.plans import pipeline
from tracklode.sources import io, models


def test_points(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("1,10,2.5,MOVE\n1,x,3.5,STOP\n,12,1.0,MOVE\n")
    (tmp_path / "in/b").write_text("2,11,,STOP\n")
    df = io.read_points(spark, str(tmp_path / "in"), ["L", "L", "D", "S"])
    assert sorted(map(tuple, df.collect())) == [(1, 10, 2.5, "MOVE"), (2, 11, None, "STOP")]
    assert io.nominal_columns(df) == ["d_3"] and io.selected_columns(df, [0, 0, 1, 1]) == ["d_2", "d_3"]
    with pytest.raises(ValueError):
        io.point_schema(["Q"])


def test_hotspot_points_and_sequences(spark, tmp_path):
    (tmp_path / "p").write_text("mmsi,ts,lat,lon\nv1,10,48.5,-4.5\nv1,11,48.6\nv2,x,1,2\n")
    assert [tuple(r) for r in io.read_hotspot_points(spark, str(tmp_path / "p")).collect()] == [("v1", 10_000, 48.5, -4.5)]
    (tmp_path / "s").write_text("1,5;2,6;\n\n9,7\n")
    rows = io.read_sequences(spark, str(tmp_path / "s")).orderBy("seq_id").collect()
    assert [[tuple(i) for i in r["items"]] for r in rows] == [[(1, 5), (2, 6)], [(9, 7)]]
    (tmp_path / "n").write_text("1,2\n3,\n4,5\n")
    assert sorted(r.features for r in io.read_numeric_points(spark, str(tmp_path / "n"), 2).collect()) == [[1, 2], [4, 5]]


def test_jdbc_round_trip(spark, tmp_path):
    url, p = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, [1.5, 2.5]), (2, None)], "id int, v array<double>")
    try:
        io.write_jdbc(df, url, "t", "overwrite", p)
    except Exception as e:
        pytest.skip(f"no embedded database here: {str(e)[:80]}")
    io.write_jdbc(df, url, "t", "append", p)
    got = io.read_jdbc(spark, url, "t", p)
    assert got.count() == 4 and {r[1] for r in got.collect()} == {"[1.5,2.5]", None}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(12)], "cell_id bigint, z double")
    io.write_hotspots(df, str(tmp_path / "h"), ["head"], 3)
    lines = "".join(f.read_text() for f in (tmp_path / "h").glob("part*")).splitlines()
    assert lines == ["head", "2,  2.0,", "5,  2.0,", "8,  2.0,"]
    io.write_labels(spark.createDataFrame([("a", [1.0, 2.0], 3)], "id string, c array<double>, n int"), str(tmp_path / "l"), "id")
    assert "".join(f.read_text() for f in (tmp_path / "l").glob("part*")) == "a,1.0,2.0,3\n"
    assert io.write_debug(df, "x") is df


def test_models(spark, tmp_path):
    ab = lsh.coefficients(3, 1)
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ab)], "table int, a bigint, b bigint")
    models.save(spark, str(tmp_path / "m"), "minhash", t, seed=1)
    meta, data = models.load(spark, str(tmp_path / "m"), "minhash")
    assert meta["seed"] == 1 and [(r.a, r.b) for r in data.orderBy("table").collect()] == ab
    with pytest.raises(ValueError):
        models.load(spark, str(tmp_path / "m"), "kmeans")
    with pytest.raises(ValueError):
        models.save(spark, str(tmp_path / "k"), "kmeans", t)
    models.save(spark, str(tmp_path / "k"), "kmeans", kmeans.kmeans_table(spark, [[1.0, 2.0]]), k=1, distance="RV", cost=0.0)
    assert models.load(spark, str(tmp_path / "k"), "kmeans")[1].head().center == [1, 2]
    p = spark.createDataFrame([([[1], [2]], 5)], "pattern array<array<int>>, support bigint")
    models.save(spark, str(tmp_path / "p"), "patterns", p)
    assert json.loads(spark.read.text(str(tmp_path / "p/metadata")).head()[0])["class"] == "patterns"
    pts = spark.createDataFrame([(i, [float(i), float(i % 2)]) for i in range(8)], "id int, v array<double>")
    nodes, _ = kmeans.bisecting(pts, 3, 2, iterations=3)
    models.save(spark, str(tmp_path / "b"), "bisecting", kmeans.nodes_table(spark, nodes), k=3)
    assert models.load(spark, str(tmp_path / "b"), "bisecting")[1].count() == len(nodes)


def test_command_lines(spark, tmp_path):
    (tmp_path / "p").write_text("".join(f"v{i % 3},{i * 4000},{48 + (i % 7) * 0.03},{-4 + (i % 5) * 0.03}\n" for i in range(60)))
    assert cli.main(["hotspot", "-i", str(tmp_path / "p"), "-o", str(tmp_path / "o"), "-tk", "10", "-nd", "1", "--mode", "x"]) == 0
    lines = "".join(f.read_text() for f in (tmp_path / "o").glob("part*")).splitlines()
    assert len(lines) == 12
    (tmp_path / "d").write_text("".join(f"{i % 4 * 0.1},{i % 3 * 0.1}\n" for i in range(30)) + "9,9\n")
    assert cli.main(["dbscan", "--ds-input", str(tmp_path / "d"), "--ds-output", str(tmp_path / "c"), "--eps", "0.3", "--numPts", "5"]) == 0
    assert sum(line.endswith(",0") for f in (tmp_path / "c").glob("part*") for line in f.read_text().splitlines()) == 1
    assert cli.main(["within", "--ds-input", str(tmp_path / "d"), "--ds-output", str(tmp_path / "w"), "--eps", "0.3"]) == 0
    assert cli.main(["nearest", "--ds-input", str(tmp_path / "d"), "--ds-output", str(tmp_path / "n"), "--eps", "0.3"]) == 0
    with pytest.raises(ValueError):
        cli.main(["hotspot", "-i", "x", "-o", "y", "-tk", "3"])


def test_pipeline(spark):
    rows = [(t, 10_000 + 100 * s, float(t), float(s), 0.0, "walk" if (s + t) % 3 else "bus") for t in range(6) for s in range(12)]
    pts = spark.createDataFrame(rows + [(None, 1, 0.0, 0.0, 0.0, "bus"), rows[0]], "d_0 bigint, d_1 bigint, d_2 double, d_3 double, d_4 double, d_6 string")
    active = pipeline.nominal_areas_input(pts, [], ["d_6"])
    run = pipeline.mine(active, "MINHASHLSH", {"active": "active", "ab": lsh.coefficients(2, 1)}, min_support=0.5, max_gap=300, max_length=3, bandwidth=5.0, merge_window=1.0)
    assert run.areas.agg(F.max("area_id")).head()[0] == 2
    assert run.patterns.count() > 0 and run.instances.count() > 0
    assert run.transitions.count() == run.clusters.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and {"p5_found", "gap_patterns_all"} <= set(q)
    assert e.entry(spark).count() > 0


def test_flat_rows(spark):
    df = spark.createDataFrame([(1, {"a": [(2, [3.0, 4.0])]}), (2, {}), (3, None)], "id int, m map<string,array<struct<t:int,p:array<double>>>>")
    got = sorted(tuple(r) for r in io.flat_rows(df).collect())
    assert got == [(1, "a", 0, 2, 0, 3.0), (1, "a", 0, 2, 1, 4.0)]
    assert io.flat_rows(df).columns == ["id", "m_key", "m_pos", "m_t", "m_p_pos", "m_p"]


def test_pattern_run_from_a_file(spark, tmp_path):
    from tracklode import cli
    from tracklode.operators import hotspot
    from tracklode.plans import config

    (tmp_path / "pts").write_text("".join(f"{d};{t};{d}.0;{t}.0;0.0;{'ab'[(t // 10) % 2]}\n" for d in range(6) for t in range(0, 60, 5)))
    for method, more in (("MINHASHLSH", ""), ("CELLS", "cellSizePerDim=1,1,1,20,1,1\n"), ("DBSCAN", "epsilonFlag=1,1,1,1,1,1\nminPtsFlag=2\n")):
        mask = "0,0,0,0,0,1" if method == "MINHASHLSH" else "0,0,1,1,0,0"
        (tmp_path / "run").write_text(f"! a run\ndelimiter = ;\ndimensionTypes=L,L,D,D,D,S\nselectedDimensions={mask}\nsemAreasMethod={method}\nminSupport=0.5\nmaxDTofPatterns=10\nmaxPatternLength=2\n{more}")
        out = f"{tmp_path}/{method}"
        assert cli.main(["patterns", "--config", f"{tmp_path}/run", "--input", f"{tmp_path}/pts", "--output", out]) == 0
        assert spark.read.parquet(f"{out}/areas").count() > 0
    patterns = {tuple(r["pattern"]): r["support"] for r in spark.read.parquet(f"{tmp_path}/MINHASHLSH/patterns").collect()}
    assert set(patterns) == {(1, 1), (1, 2), (2, 1), (2, 2)} and set(patterns.values()) == {6}
    assert {"pattern", "cluster", "value", "value_pos"} <= set(spark.read.parquet(f"{tmp_path}/MINHASHLSH/transitions").columns)
    with pytest.raises(hotspot.PathError):
        cli.main(["patterns", "--config", f"{tmp_path}/none"])
    with pytest.raises(hotspot.PathError):
        cli.main(["patterns", "--config", f"{tmp_path}/run", "--input", f"{tmp_path}/nothing", "--output", "x"])
    (tmp_path / "bad").write_text("no sign here\n")
    with pytest.raises(hotspot.InputError):
        config.read_properties(f"{tmp_path}/bad")
    (tmp_path / "empty").write_text("")
    with pytest.raises(hotspot.DataError):
        config.run(spark, f"{tmp_path}/empty", config.read_properties(f"{tmp_path}/run"))
    with pytest.raises(hotspot.RangeError):
        config.run(spark, f"{tmp_path}/pts", config.read_properties(f"{tmp_path}/run") | {"minSupport": "2"})
