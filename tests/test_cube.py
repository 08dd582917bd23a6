"""Cube operators: missing values, broadcasting, domains, requests, grids, vectors, catalog, streams."""

from __future__ import annotations

import math
from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import queries as Q
from gridloom.functions.calendar import calendar_bin, season_months
from gridloom.operators import cube as C
from gridloom.operators import regrid
from gridloom.operators.cube import Cube, Span
from gridloom.operators.linalg import Eof
from gridloom.plans import kernels as K
from gridloom.plans import request as R
from gridloom.plans.execute import execute
from gridloom.sources.catalog import Catalog, Jobs, aggregation_rows, collection_list
from gridloom.streaming.windows import drained, windowed

SCHEMA = "member string, t int, y int, x int, value double"


def cube(spark, cells):
    df = spark.createDataFrame([("m", *c) for c in cells], SCHEMA)
    return Cube(df.withColumns({"lat": F.col("y") * 10.0, "lon": F.col("x") * 90.0, "time": F.lit(datetime(2000, 1, 15)).cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), F.col("t"))}), coords=("time", "lat", "lon"))


def values(c: Cube):
    return {tuple(r[k] for k in c.keys): r[c.value] for r in c.df.collect()}


SOME = [(0, 0, 0, 1.0), (0, 0, 1, None), (0, 1, 0, 3.0), (1, 0, 0, -5.0), (1, 1, 1, None), (1, 1, 0, 4.0)]


@pytest.mark.parametrize("op,want", [("max", 3.0), ("min", 1.0), ("sum", 4.0), ("ave", 2.0), ("count", 2), ("ptp", 2.0), ("rms", math.sqrt(10.0)), ("maxmag", 3.0)])
def test_reductions_skip_missing(spark, op, want):
    assert values(C.reduced(cube(spark, SOME), op, "xy"))[("m", 0)] == pytest.approx(want)


def test_all_missing_gives_null(spark):
    c = cube(spark, [(0, 0, 0, None), (0, 0, 1, None)])
    assert all(values(C.reduced(c, op, "xy")) == {("m", 0): None} for op in ("max", "min", "sum", "ave", "rms", "stddev", "maxmag", "minmag"))
    assert C.reduced(Cube(c.df.limit(0)), "sum", "t").df.count() == 0


def test_cosine_weights(spark):
    c = cube(spark, [(0, 0, 0, 1.0), (0, 6, 0, 4.0), (0, 3, 0, None)])
    assert values(C.reduced(c, "ave", "y", "cosine"))[("m", 0, 0)] == pytest.approx((1 + 4 * 0.5) / 1.5)


@pytest.mark.parametrize("axes", ["", "q", "tq"])
def test_bad_axes(spark, axes):
    with pytest.raises(ValueError):
        C.reduced(cube(spark, SOME), "max", axes)


def test_order_of_operands_survives_broadcasting(spark):
    c = cube(spark, [(0, 0, 0, 1.0), (1, 0, 0, 4.0)])
    mean = C.reduced(c, "ave", "t")
    assert values(C.combined("diff", [mean, c])) == {("m", 0, 0, 0): 1.5, ("m", 1, 0, 0): -1.5}
    assert values(C.combined("diff", [c, mean])) == {("m", 0, 0, 0): -1.5, ("m", 1, 0, 0): 1.5}
    with pytest.raises(ValueError):
        C.combined("sum", [C.reduced(c, "ave", "t"), C.reduced(c, "ave", "x")])


def test_a_single_cell_is_broadcast_in_either_order(spark):
    c = C.member(cube(spark, [(0, 0, 0, 1.0), (0, 0, 1, None), (1, 0, 0, 4.0), (1, 1, 0, 7.0)]), "m")
    mean = C.reduced(c, "ave", "txy")
    assert mean.keys == []
    assert values(C.combined("diff", [mean, c])) == {(0, 0, 0): 3.0, (0, 0, 1): None, (1, 0, 0): 0.0, (1, 1, 0): -3.0}
    assert values(C.combined("diff", [c, mean])) == {(0, 0, 0): -3.0, (0, 0, 1): None, (1, 0, 0): 0.0, (1, 1, 0): 3.0}
    assert values(C.combined("div", [mean, mean])) == {(): 1.0}
    got = execute('[variable=[{uri:"collection:/g",name:"q:v1"}],operation=[{name:"c.ave",input:"v1",axes:"txy",id:"v1ave"},{name:"c.eDiff",input:"v1ave,v1",id:"out"}]]', lambda coll, name: c)
    assert sorted((r.t, r.y, r.x, r.value) for r in got["out"].where("value is not null").collect()) == [(0, 0, 0, 3.0), (1, 0, 0, 0.0), (1, 1, 0, -3.0)]


def test_elementwise_missing_and_zero(spark):
    a, b = cube(spark, [(0, 0, 0, 1.0), (0, 0, 1, None), (0, 1, 0, 2.0)]), cube(spark, [(0, 0, 0, 0.0), (0, 0, 1, 5.0), (0, 1, 0, 4.0)])
    assert values(C.combined("div", [a, b])) == {("m", 0, 0, 0): None, ("m", 0, 0, 1): None, ("m", 0, 1, 0): 0.5}
    assert values(C.combined("min", [a, b]))[("m", 0, 0, 1)] is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 17), st.integers(0, 1), st.floats(-100, 100) | st.none()), min_size=1, max_size=30, unique_by=lambda x: x[:2]))
def test_lowpass_plus_highpass_is_the_series(spark, cells):
    c = cube(spark, [(t, 0, x, v) for t, x, v in cells])
    low, high, raw = values(C.lowpass(c, 6)), values(C.highpass(c, 6)), values(c)
    assert set(low) == set(raw)
    for k, v in raw.items():
        if v is not None:
            assert low[k] + high[k] == pytest.approx(v, abs=1e-9)


def test_anomalies_average_to_zero(spark):
    c = cube(spark, [(t, 0, 0, float(t * t)) for t in range(24)])
    out = C.reduced(C.anomaly(c, "t", "monthOfYear"), "ave", "t", group="monthOfYear")
    assert all(abs(v) < 1e-9 for v in values(out).values())


def test_subset_twice_is_the_intersection(spark):
    c = cube(spark, [(t, y, 0, 1.0) for t in range(5) for y in range(5)])
    a, b = [Span("t", 1, 3)], [Span("y", 10, 30, "values"), Span("t", 2, 9)]
    assert values(C.subset(C.subset(c, a), b)).keys() == values(C.subset(c, [*a, *b])).keys() == {("m", t, y, 0) for t in (2, 3) for y in (1, 2, 3)}
    assert {k[2] for k in values(C.subset(c, [Span("y", 11, 12, "values")]))} == {2}
    with pytest.raises(ValueError):
        C.subset(c, [Span("z", 0, 1)])


def test_polygon_with_hole(spark):
    c = cube(spark, [(0, y, x, 1.0) for y in range(7) for x in range(4)])
    ring = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    out = values(C.masked(c, [ring(-10, -1, 200, 61), ring(80, 15, 100, 45)]))
    assert {(k[2], k[3]) for k in out} == {(y, x) for y in range(7) for x in range(3)} - {(2, 1), (3, 1), (4, 1)}


@pytest.mark.parametrize("name,want", [("season", 120), ("seasonOfYear", 0), ("monthOfYear", 12), ("decade", 199), ("N", None), ("6-month", 60), ("6/1-month", 60), ("4-monthOfYear", 2), ("10-year", 2), ("dayOfYear", 346), ("5-day", 10_937 // 5)])
def test_bins(spark, name, want):
    df = spark.createDataFrame([(datetime(1999, 12, 12, 7),)], "m timestamp_ntz")
    if want is None:
        with pytest.raises(ValueError):
            calendar_bin(name, F.col("m"))
        return
    got = df.select(calendar_bin(name, F.col("m"))).first()[0]
    assert got == want


def test_season_initials():
    assert season_months("DJF") == [12, 1, 2] and season_months("JJA") == [6, 7, 8] and season_months("MAM") == [3, 4, 5]
    with pytest.raises(ValueError):
        season_months("XYZ")


def test_as_of_with_ties_nulls_and_buckets(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 30, 2), ("a", 1, 3), ("b", 9, 4), (None, 3, 5)], "k string, ts int, id int")
    right = spark.createDataFrame([("a", 5, 10.0), ("a", 4, 9.0), ("a", 12, None), ("c", 1, 7.0)], "k string, ts int, v double")
    for bucket in (None, F.floor(F.col("ts") / 10)):
        got = {r.id: r.out for r in C.as_of(left, right, ["k"], "ts", "v", "out", bucket).collect()}
        assert got == {1: 10.0, 2: None, 3: None, 4: None, 5: None}


def test_converted_is_linear_between_and_flat_beyond(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0), ("a", 5.0, None)], "k string, p double, v double")
    t = spark.createDataFrame([("a", -1.0), ("a", 2.5), ("a", 10.0), ("a", 99.0), ("b", 1.0)], "k string, p double")
    assert {(r.k, r.p): r.value for r in C.converted(s, t, ["k"], "p", "v").collect()} == {("a", -1.0): 0.0, ("a", 2.5): 5.0, ("a", 10.0): 20.0, ("a", 99.0): 20.0, ("b", 1.0): None}


def test_bilinear_is_exact_on_a_plane(spark):
    lats, lons = [0.0, 10.0, 20.0], [0.0, 90.0, 180.0, 270.0]
    c = cube(spark, [(0, y, x, 2 * lats[y] + (1.0 if x == 1 else 0.0)) for y in range(3) for x in range(4)])
    out = {(r.y, r.x): r.value for r in regrid.regridded(c, lats, lons, [5.0, 12.5, 40.0], [45.0, 315.0]).df.collect()}
    assert out[0, 0] == pytest.approx(10.5) and out[1, 1] == pytest.approx(25.0) and out[2, 0] == pytest.approx(40.5)
    assert regrid.gaussian_axis(2)[1] == pytest.approx(35.264389682754654)
    assert regrid.same_grid((lats, lons), (lats, lons)) and not regrid.same_grid((lats, lons), (lats[:2], lons))


def test_eof_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(t, y, float(x[t, y])) for t in range(20) for y in range(5)] + [(0, 9, 1.0), (3, 9, None)], "t int, y int, value double")
    e = Eof.fit(df, "t", ["y"], "value", modes=5)
    a = x - x.mean(0)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    loadings = np.zeros((5, 5))
    for r in e.maps().collect():
        loadings[r.mode, r.y] = r.eof
    assert np.allclose(e.values, s**2 / 19) and np.allclose(np.abs(loadings @ v.T), np.eye(5), atol=1e-6)
    assert e.variance_fractions().sum() == pytest.approx(1) and e.total_variance() == pytest.approx(a.var(0, ddof=1).sum())
    back = {(r.t, r.y): r.value for r in e.reconstructed(5).collect()}
    assert all(back[t, y] == pytest.approx(x[t, y]) for t in range(20) for y in range(5))
    pcs = {(r.t, r.mode): r.pc for r in e.components(scaling=1).collect()}
    assert np.std([pcs[t, 0] for t in range(20)], ddof=1) == pytest.approx(1)
    scaled = Eof.fit(df, "t", ["y"], "value", modes=2, scale=True)
    assert np.allclose(scaled.values, np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1])
    related = {(r.y, r.mode): r.r for r in e.related().collect()}
    assert related[0, 0] == pytest.approx(np.corrcoef(x[:, 0], [pcs[t, 0] for t in range(20)])[0, 1])


def test_complete_months_by_the_nations_of_the_data(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 4, 2.0), (1, 1, 3.0), (2, 1, 1.0), (2, 4, None), (3, 1, 1.0), (3, 4, 0.0), (3, 9, None)], "t int, y int, value double")
    assert sorted({r.t for r in Q._complete(df).collect()}) == [0, 3]


def test_grammar():
    out = R.parse('[domain=[{"name":"d0","lat":{"start":-1.5,"end":5,"system":"values"},tags:[1,2,true]}],variable={"uri":"collection:/g","name":"a:v1,b:v2"};operation=[]]')
    assert out["domain"][0] == {"name": "d0", "lat": {"start": -1.5, "end": 5, "system": "values"}, "tags": [1, 2, True]}
    assert R.bind(out).variables == {"v1": ("g", "a"), "v2": ("g", "b")} and R.bind(out).operations[0].name == "cube.noop"
    for bad in ("", "[domain", "[a=[{x:}]]", "[a={}] b", "[operation=[{name:'c.max',input:'nope'}]]"):
        with pytest.raises(ValueError):
            R.bind(R.parse(bad))


def test_operations_in_a_circle():
    with pytest.raises(ValueError):
        R.bind(R.parse("[operation=[{name:'c.max',input:'b',id:'a'},{name:'c.max',input:'a',id:'b'}]]"))


def test_request_equals_direct_calls(spark):
    c = cube(spark, [(t, y, 0, float(t * y)) for t in range(4) for y in range(3)])
    text = '[domain=[{name:"d",lat:{start:1,end:2,system:"indices"}}],variable=[{uri:"collection:/g",name:"q:v"}],operation=[{name:"Module.ave",input:"v",axes:"t",id:"m",domain:"d"},{name:"x.diff2",input:"v,m",id:"out",domain:"d"}]]'
    got = execute(text, lambda coll, name: c)
    part = C.subset(c, [Span("y", 1, 2)])
    assert list(got) == ["out"] and sorted(got["out"].select("t", "y", "value").collect()) == sorted(C.combined("diff", [part, C.reduced(part, "ave", "t")]).df.select("t", "y", "value").collect())
    assert K.describe("python.max")["name"] == "cube.max" and any(k[0] == "cube.rmsum" for k in K.capabilities()) and not any(k[0] == "cube.rmsum" for k in K.capabilities("public"))


@pytest.mark.parametrize("axes,group", [("t", "monthOfYear"), ("tyx", None), ("yx", None)])
def test_groups_are_aggregated_before_they_are_shuffled(spark, axes, group):
    c = cube(spark, SOME)
    plan = C.anomaly(c, axes, group).df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan and "Window" not in plan and "partial_avg" in plan


@pytest.mark.parametrize("shape,whole", [((12, 60), 2048), ((60, 12), 2048), ((12, 60), 4), ((60, 12), 4)])
def test_eof_of_either_side_and_by_iteration(spark, shape, whole):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(shape[0], 6)) * [9, 7, 5, 3, 2, 1] @ rng.normal(size=(6, shape[1])) + rng.normal(size=shape) * 0.01
    df = spark.createDataFrame([(t, y, float(x[t, y])) for t in range(shape[0]) for y in range(shape[1])], "t int, y int, value double")
    e = Eof.fit(df, "t", ["y"], "value", modes=3, weights=F.sqrt(F.col("y") + 1.0), whole=whole)
    a = (x - x.mean(0)) * np.sqrt(np.arange(shape[1]) + 1.0)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(e.values[:3], s[:3] ** 2 / (shape[0] - 1)) and e.total_variance() == pytest.approx((s**2).sum() / (shape[0] - 1))
    got = {(r.mode, r.y): r.eof for r in e.maps().collect()}
    sign = [np.sign(v[m, np.abs(v[m]).argmax()]) for m in range(3)]
    assert all(got[m, y] == pytest.approx(v[m, y] * sign[m], abs=1e-5) for m in range(3) for y in range(shape[1]))
    pcs = {(r.mode, r.t): r.pc for r in e.components().collect()}
    assert all(pcs[m, t] == pytest.approx(u[t, m] * s[m] * sign[m], abs=1e-3) for m in range(3) for t in range(shape[0]))
    again = {(r.mode, r.t): r.pc for r in e.components(df.where("t > 3")).collect()}
    assert all(again[k] == pytest.approx(pcs[k]) for k in again) and len(again) == 3 * (shape[0] - 4)


def test_eof_of_a_globe_of_ten_thousand_cells(spark):
    df = spark.range(8).select(F.col("id").cast("int").alias("t")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(10_367)))).withColumn("value", F.sin(F.col("t") * 1.3) * F.cos(F.col("c") / 50) + F.col("t") * 0.01)
    e = Eof.fit(df, "t", ["c"], "value", modes=2)
    assert e.maps().count() == 2 * 10_368 and e.variance_fractions().sum() == pytest.approx(1)


def test_spans_are_pushed_to_the_scan(spark, tmp_path):
    catalog = Catalog(str(tmp_path))
    c = cube(spark, SOME)
    catalog.save("Some", c)
    plan = C.subset(catalog.load(spark, "some"), [Span("t", 1, 1), Span("y", 1, 1)]).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,1)" in plan and "GreaterThanOrEqual(y,1)" in plan
    assert values(catalog.load(spark, "SOME")) == values(c) and catalog.listed()[0][0] == "some"
    catalog.drop("some")
    with pytest.raises(ValueError):
        catalog.load(spark, "some")


def test_ingest_and_catalog_texts(spark, tmp_path):
    for k, names in enumerate(["ab", "ba", "c"]):
        spark.createDataFrame([(1,) * len(names)], list(names)).coalesce(1).toPandas().to_parquet(tmp_path / f"{k}.parquet")
    paths = [str(tmp_path / f"{k}.parquet") for k in range(3)]
    assert Catalog(str(tmp_path)).ingest(spark, paths) == {"a-b": paths[:2], "c": paths[2:]}
    (tmp_path / "x.txt").write_text("P; title; T\nV; tas; Air; d.tas; desc; 1,2,3; ; time lat lon; K\nF; 60; 12; /a.nc\n")
    v = aggregation_rows(spark, [str(tmp_path / "x.txt")], "V").first()
    assert (v.name, v.resolution, v.units) == ("tas", None, "K") and aggregation_rows(spark, [str(tmp_path / "x.txt")], "F").first().path == "/a.nc"
    (tmp_path / "list.csv").write_text("# c\nid1, .*nc, Title, /data\n")
    assert [tuple(r) for r in collection_list(spark, [str(tmp_path / "list.csv")]).collect()] == [("id1", ".*nc", "Title", "/data")]


def test_jobs(spark):
    jobs = Jobs(most=2)
    a = jobs.submit(lambda: spark.range(3))
    assert jobs.status(a) == "planned" and jobs.result(a).count() == 3
    b = jobs.submit(lambda: 1 / 0)
    assert jobs.status(b) == "failed"
    jobs.submit(lambda: spark.range(1))
    assert jobs.status(a) == "unknown"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, h), "a", float(h)) for h in range(12)], "ts timestamp, k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = drained(spark, windowed(stream, "ts", ["k"], "v", "6 hours", ("sum", "max")), str(tmp_path))
    assert sorted((r.sum, r.max) for r in out.collect()) == [(15.0, 5.0), (51.0, 11.0)]


def test_netcdf_round_trip(spark, tmp_path):
    from gridloom.sources import netcdf3

    x = np.arange(5 * 2 * 3, dtype=float).reshape(5, 2, 3)
    x[1, 0, 1] = -999
    paths = []
    for k, unlimited in enumerate((0, 5)):
        path = str(tmp_path / f"{k}.nc")
        netcdf3.write_file(path, {"time": unlimited, "lat": 2, "lon": 3}, {"lat": (["lat"], np.array([1.0, 2.0]), {}), "tas": (["time", "lat", "lon"], x, {"missing_value": -999.0, "units": "K"}), "other": (["time"], np.arange(5.0), {})}, {"title": "t"})
        paths.append(path)
    head = netcdf3.read_header(paths[0])
    assert head.n_records == 5 and head.variables["tas"].attributes["units"] == "K" and head.attributes == {"title": "t"}
    cells = netcdf3.cells_of(netcdf3.records(spark, paths, "tas", steps=2)).collect()
    assert len(cells) == 60
    assert all(r.value == (None if x[r.t, r.y, r.x] == -999 else x[r.t, r.y, r.x]) for r in cells)
    assert netcdf3.records(spark, paths, "none").count() == 0 and netcdf3.records(spark, [], "tas").count() == 0
    (tmp_path / "bad.nc").write_bytes(b"HDF5")
    with pytest.raises(ValueError):
        netcdf3.read_header(str(tmp_path / "bad.nc"))


def test_settings_that_nothing_reads_are_errors(spark):
    c = cube(spark, SOME)
    ask = lambda op, **run: execute('[variable=[{uri:"collection:/g",name:"q:v1"}],operation=[' + op + "]]", lambda coll, name: c, **run)
    for bad in ('{name:"c.max",input:"v1",axes:"t",colour:"red"}', '{name:"c.max",input:"v1",axes:"t",crs:"wgs"}', '{name:"c.max",input:"v1"}', '{name:"c.eDiff",input:"v1"}', '{name:"c.lowpass",input:"v1"}', '{name:"c.lowpass",input:"v1",groupBy:"monthofyear"}', '{name:"c.none",input:"v1"}', '{name:"c.write",input:"v1"}', '{name:"c.max",input:"v1",axes:"t",grid:"hexagonal"}'):
        with pytest.raises(ValueError):
            ask(bad)
    with pytest.raises(ValueError):
        execute('[variable=[{uri:"http://x/y",name:"q:v1"}]]', lambda coll, name: c)
    with pytest.raises(ValueError):
        execute('[domain=[{name:"d",lat:{start:1,end:2,system:"indices"}}],variable=[{uri:"collection:/g",name:"q:v1"},{uri:"collection:/h",name:"q:v2"}],operation=[{name:"c.eSum",input:"v1,v2",domain:"d"}]]', lambda coll, name: c)


def test_several_outputs_and_their_names(spark):
    c = cube(spark, [(t, y, 0, float((t * 7 + y * 3) % 5)) for t in range(8) for y in range(3)])
    out = execute('[variable=[{uri:"collection:/g",name:"q:v1"}],operation=[{name:"ml.svd",input:"v1",modes:"2",id:"s"}]]', lambda coll, name: c)
    assert set(out) == {"s.maps", "s.components", "s.fractions"} and out["s.maps"].count() == 6 and out["s.components"].count() == 16
    stats = execute('[variable=[{uri:"collection:/g",name:"q:v1,q:v2"}],operation=[{name:"x.ensembleStats",input:"v1,v2",target:"v1",id:"e"},{name:"c.max",input:"e.std",axes:"tyx",id:"top"}]]', lambda coll, name: c)
    assert stats["top"].first().value == 0.0


def test_kernels_are_discovered(spark, tmp_path, monkeypatch):
    (tmp_path / "ownkernels").mkdir()
    (tmp_path / "ownkernels" / "__init__.py").write_text("")
    (tmp_path / "ownkernels" / "more.py").write_text("from pyspark.sql import functions as F\nfrom gridloom.plans import kernels as K\nK.reducing('own.spread', 'Spread', lambda v: F.max(v) - F.min(v))\nK.combining('own.eHypot', 'Hypotenuse', F.hypot)\nK.macro('own.shifted', 'Shifted', lambda c, cfg: __import__('gridloom.operators.cube', fromlist=['x']).with_scalar(c, 'sum', float(cfg['by'])), ('by',))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("GRIDLOOM_KERNELS", "ownkernels")
    try:
        assert K.discovered() == ["own.ehypot", "own.shifted", "own.spread"]
        c = cube(spark, [(0, 0, 0, 3.0), (1, 0, 0, 7.0)])
        ask = lambda op: [r.value for r in next(iter(execute('[variable=[{uri:"collection:/g",name:"q:v1"}],operation=[' + op + "]]", lambda coll, name: c).values())).collect()]
        assert ask('{name:"own.spread",input:"v1",axes:"t"}') == [4.0] and sorted(ask('{name:"own.shifted",input:"v1",by:1}')) == [4.0, 8.0]
        assert K.describe("own.shifted")["settings"] == ["by"] and ("own", 3) in K.modules()
    finally:
        for name in ("own.ehypot", "own.shifted", "own.spread"):
            K.REGISTRY.pop(name, None)


@pytest.mark.parametrize("text,want", [("1996", "1996-01-01 00:00:00"), ("1996-03", "1996-03-01 00:00:00"), ("1850-01-30T00:00:00Z", "1850-01-30 00:00:00"), ("1990-01-01T02:00:00+02:00", "1990-01-01 00:00:00"), ("5 January 1990", "1990-01-05 00:00:00"), ("Jan 1990", "1990-01-01 00:00:00")])
def test_times_of_requests(text, want):
    assert R.instant(text) == want


def test_time_instants(spark):
    df = spark.createDataFrame([("m", k, datetime(2000, k + 1, 1), datetime(2000, k + 2, 1), float(k)) for k in range(4)], "member string, t int, time timestamp_ntz, time_end timestamp_ntz, value double")
    c = Cube(df, ("t",), ("member",), ("time",))
    at = lambda cube, *span: sorted(r.t for r in C.subset(cube, [Span("t", *span, "values")]).df.collect())
    assert at(c, "2000-02-20", None) == [1] and at(c, "1999-01-01", None) == [0] and at(c, "2000-02-01", "2000-04-01") == [1, 2]
    ended = Cube(df, ("t",), ("member",), ("time", "time_end"))
    assert at(ended, "2000-02-20", None) == [1] and at(ended, "1999-01-01", None) == []


def test_calendars(spark):
    day = 86_400_000
    df = spark.createDataFrame([(59 * day,), (-1,)], "ms bigint")
    bins = lambda name, cal: [r[0] for r in df.select(calendar_bin(name, F.col("ms"), calendar=cal)).collect()]
    assert bins("monthOfYear", "360_day") == [2, 12] and bins("monthOfYear", "noleap") == [3, 12] and bins("year", "noleap") == [1970, 1969] and bins("dayOfYear", "360_day") == [60, 360]
    with pytest.raises(ValueError):
        calendar_bin("year", F.col("ms"), calendar="martian")


def test_long_series_take_the_time_of_short_ones(spark):
    import time

    df = spark.range(16_000).select(F.lit("m").alias("member"), F.col("id").cast("int").alias("t"), F.sin("id").alias("value"))
    began = time.time()
    assert C.lowpass(Cube(df, ("t",), ("member",)), 6).df.agg(F.count("value")).first()[0] == 16_000
    points = df.select("member", F.col("t").cast("double").alias("p"), F.col("value").alias("v"))
    assert C.converted(points.where("p % 7 = 0"), points, ["member"], "p", "v", width=1000.0).count() == 16_000
    assert time.time() - began < 20


def test_records(spark):
    from gridloom.operators import records

    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"x": 1})], "l map<string,int>, r map<string,int>")
    assert [r[0] for r in df.select(records.elements_merged(F.col("l"), F.col("r"))).collect()] == [{"a": 1, "b": 3, "c": 4}, {"x": 1}]
    assert df.select(records.elements_renamed(F.col("l"), {"a": "b"})).first()[0] == {"b": 2}
    a, b = records.Section.parse("Section{0,2:4,4}"), records.Section((2, 0), (5, 3))
    assert str(a.union(b)) == "Section{0,0:7,6}" and a.intersection(b) == records.Section((2, 2), (2, 1)) and a.intersection(records.Section((9, 9), (1, 1))) is None
    assert records.merge_metadata("sum", [{"n": "x", "roi": str(a), "k": "1"}, {"n": "y", "roi": str(b)}]) == {"n": "sum(x,y)", "roi": "Section{0,0:7,6}", "k": "1"}
    m = spark.createDataFrame([({"n": "x", "roi": str(a)}, {"n": "y", "roi": str(b)})], "l map<string,string>, r map<string,string>")
    assert m.select(records.metadata_merged("sum", F.col("l"), F.col("r"))).first()[0] == {"n": "sum(x,y)", "roi": "Section{0,0:7,6}"}


def test_small_texts():
    from gridloom.functions.calendar import duration_millis
    from gridloom.functions.text import parse_size, uid, unquoted

    assert parse_size("200M") == 200 << 20 and parse_size("1.5kb") == 1536 and unquoted(' "\'a\'" ') == "a" and uid("Tas:", "V 1", "") == "tas-v1"
    assert duration_millis("6 hours") == 21_600_000 and duration_millis("day") == 86_400_000 and duration_millis("2 months") == pytest.approx(2 * 365.2425 / 12 * 86_400_000)


def _files(tmp_path, calendar=None):
    from gridloom.sources import netcdf3

    paths = []
    for k, first in enumerate((30, 0)):  # the later file comes first
        x = np.arange(3 * 2 * 4, dtype=float).reshape(3, 2, 4) + 100 * first
        x[0, 0, 0] = -1.0
        at = np.arange(first, first + 30, 10.0)
        attrs = {"units": "days since 2000-01-01", "bounds": "tb", **({"calendar": calendar} if calendar else {})}
        path = str(tmp_path / f"f{k}.nc")
        netcdf3.write_file(path, {"time": 0, "lat": 2, "lon": 4, "two": 2}, {"lat": (["lat"], np.array([10.0, 20.0]), {}), "lon": (["lon"], np.arange(4) * 90.0, {}), "time": (["time"], at, attrs), "tb": (["time", "two"], np.c_[at, at + 10], {}), "tas": (["time", "lat", "lon"], x, {"missing_value": -1.0, "scale_factor": 0.5, "add_offset": 1.0})})
        paths.append(path)
    return paths


def test_files_as_a_cube_and_back(spark, tmp_path):
    from gridloom.sources import netcdf3

    paths = _files(tmp_path)
    c = netcdf3.cube_of(spark, paths, "tas", steps=2)
    got = {(r.t, r.lat, r.lon): (r.time, r.time_end, r.value) for r in c.cells().collect()}
    assert len(got) == 48 and got[0, 10.0, 0.0][2] is None and got[5, 20.0, 270.0] == (datetime(2000, 2, 20), datetime(2000, 3, 1), (3000 + 23) * 0.5 + 1)
    files = netcdf3.write_cube(c, str(tmp_path / "out"), "tas", steps=4).collect()
    assert sorted((r.first, r.n) for r in files) == [(0, 4), (4, 2)]
    again = netcdf3.cube_of(spark, [r.path for r in files], "tas")
    assert {(r.t, r.lat, r.lon): (r.time, r.value) for r in again.cells().collect()} == {k: (v[0], v[2]) for k, v in got.items()}


def test_files_in_a_model_calendar(spark, tmp_path):
    from gridloom.sources import netcdf3

    c = netcdf3.cube_of(spark, _files(tmp_path, "360_day"), "tas")
    out = {(r.bin, r.y, r.x): r.value for r in C.reduced(c, "count", "t", group="month").df.collect()}
    assert {k[0] for k in out} == {361, 362} and out[362, 1, 1] == 3
    assert netcdf3.epoch_of("days since 2001-03-01", "noleap") == (86_400_000, (31 * 365 + 59) * 86_400_000.0)


def test_a_catalogue_outlives_its_process(spark, tmp_path):
    c = replace(cube(spark, SOME), calendar="noleap", axis_values={"y": [0.0, 10.0]})
    catalog = Catalog(str(tmp_path / "store"))
    catalog.save("some", c, title="Some cells")
    catalog.store(spark)
    other = Catalog.open(spark, str(tmp_path / "store"))
    back = other.load(spark, "some")
    assert values(back) == values(c) and back.calendar == "noleap" and back.axis_values == {"y": {0: 0.0, 1: 10.0}}
    part = other.fragment(spark, "some", "v", C.subset(back, [Span("y", 0, 0)]))
    assert other.fragment(spark, "some", "v", C.subset(back, [Span("y", 0, 0)])).df.count() == part.df.count() and other.metadata(spark, "frag").count() == 1
    assert other.metadata(spark, "col").count() == 2 and other.metadata(spark, "var:some").first().name == "value" and other.metadata(spark, "ker").count() >= 40 and other.metadata(spark, "op").count() >= 1
    other.clear(spark, "fragment")
    assert other.metadata(spark, "frag").count() == 0 and not list((tmp_path / "store").glob("v-some*"))
    assert spark.read.parquet(other.save_grid("some", C.subset(back, []))).where("axis = 'y'").count() == 2


def test_requests_over_files_and_kept_results(spark, tmp_path):
    paths = _files(tmp_path)
    catalog = Catalog(str(tmp_path / "store"))
    ask = lambda text, **run: execute(text, catalog.loader(spark), catalog, run=run)
    text = '[domain=[{name:"d",lat:20,time:{start:"2000-01-01",end:"2000-02-01"}}],variable=[{uri:"file:' + paths[1] + '",name:"tas:v1",domain:"d"}],operation=[{name:"c.max",input:"v1",axes:"tx",id:"top"}]]'
    assert next(iter(ask(text, saveLocalFile="true").values())).first().value == 23 * 0.5 + 1
    assert [r.value for r in ask('[variable=[{uri:"collection:/top",name:"*:v1"}]]')["op0"].collect()] == [23 * 0.5 + 1]
    assert catalog.ingest(spark, paths) == {"tas-tb": sorted(paths)}


def test_client(spark, tmp_path):
    from gridloom.plans.client import Client

    client = Client(spark, Catalog(str(tmp_path / "c")), most=2)
    client.catalog.save("some", cube(spark, SOME))
    job = client.execute('[variable=[{uri:"collection:/some",name:"value:v1"}],operation=[{name:"c.max",input:"v1",axes:"tyx",id:"m"}]]')
    assert client.status(job) == "planned" and client.result(job)["m"].count() == 1
    bad = client.execute("[nonsense")
    assert client.status(bad) == "failed" and client.capabilities("jobs").count() == 2
    assert client.describe("max")["outputs"] == ["value"] and "axes" in client.describe("max")["settings"]
    client.util(f"dres|{job}")
    client.util("util.dcol|some")
    assert client.status(job) == "unknown" and client.capabilities("collections").count() == 0 and not (tmp_path / "c" / "some").exists()
    client.util("clearCache")
    with pytest.raises(ValueError):
        client.util("explode")


def test_folders_of_the_process_go(spark):
    import os

    from gridloom.sources.tables import removed, written

    out = written(spark.range(3))
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://")).rpartition("/")[0]
    assert os.path.isdir(folder)
    removed(spark, folder)
    assert not os.path.exists(folder)
