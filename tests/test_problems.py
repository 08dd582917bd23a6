"""Operators of the problems 1 to 5 on small fixtures: nulls, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import os
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from oracles import header_changes, utc_ms
from pyspark.sql import functions as F

from gridloom import problems
from gridloom.functions.units import parse_unit, resolve_unit
from gridloom.operators import drift, harmonise, intervals, spikes, times


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 drift
@pytest.mark.parametrize("block", [4096, 3, 1])
def test_header_changes_against_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(drift, "FILES", block)
    rng = random.Random(4)
    files = [("a", i, 10 + i) for i in range(9)] + [("a", 2, 12)] + [("b", i, 50 + 7 * i) for i in range(4)]
    variables, coordinates = [], []
    for _, _, f in sorted(set(files)):
        for v in range(4):
            if rng.random() < 0.8:
                name = rng.choice([f"v{v}", f"v{v}", f"V{v}"])
                n = rng.choice([8, 12])
                shape = rng.choice([f"{n},4,5", f"[{n}, 4, 5]", f"{n}.0x4x5", f"{n} 4 6", None])
                variables.append((f, name, rng.choice([f"Long {v}", f"long_{v}"]), shape, rng.choice(["time,lat,lon", "(Time, Lat, Lon)", "time lon lat", None]), rng.choice(["float", "double"])))
        coordinates.append((f, "lat", rng.choice(["4", "[4]", "4.0", "5", None]), rng.choice(["lat", "(lat)", "", None])))
    seen = set()
    variables = [v for v in variables if not ((v[0], v[2].lower().replace("_", " ")) in seen or seen.add((v[0], v[2].lower().replace("_", " "))))]
    fdf = spark.createDataFrame(files, "agg_id string, file_index int, file_id bigint")
    vdf = spark.createDataFrame(variables, "file_id bigint, var_name string, full_name string, shape string, dims string, dtype string").withColumn("kind", F.lit("clash"))
    cdf = spark.createDataFrame(coordinates, "file_id bigint, coord_name string, shape string, dims string")
    items = drift.header_items(vdf.unionByName(vdf), "V", "var_name", "full_name", "dtype").unionByName(drift.header_items(cdf, "C", "coord_name"))
    assert set(rows(drift.changes(fdf, items))) == header_changes(files, variables, coordinates)
    assert drift.changes(fdf.limit(0), items).count() == 0
    log = drift.numbered(drift.change_log(fdf, items)).orderBy("agg_id", "log_no").collect()
    assert [r.log_no for r in log if r.agg_id == "a"] == list(range(1, sum(r.agg_id == "a" for r in log) + 1))
    assert [(r.agg_id, r.file_index, r.file_id, r.kind, r.item_name, r.change_type) for r in log] == sorted((r.agg_id, r.file_index, r.file_id, r.kind, r.item_name, r.change_type) for r in log)
    assert {r.union_dtype for r in log if r.change_type == "dtype"} == {"double"}
    table = {(r.agg_id, r.item_name): r for r in drift.union_schema(fdf, items).collect()}
    assert ("a", "lat") in table and table["a", "lat"].n_files == 9


@pytest.mark.parametrize("types,out", [(["short", "int"], "int"), (["int", "float"], "double"), (["short", "float"], "float"), (["long", None, "double"], "double"), (["string", "int"], "string"), ([None], None), (["weird"], "weird")])
def test_lattice(spark, types, out):
    value = None
    for t in types:
        value = drift.promote(value, t)
    assert value == out
    df = spark.createDataFrame([(types,)], "a array<string>")
    assert df.select(drift.promoted(F.col("a"))).first()[0] == out


def test_union_of_files(spark, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": pa.array([1, 2], pa.int16()), "b": ["x", None]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"a": pa.array([1.5], pa.float32()), "c": pa.array([7], pa.int64())}), tmp_path / "2.parquet")
    pq.write_table(pa.table({"old": pa.array([3], pa.int32()), "b": ["y"]}), tmp_path / "3.parquet")
    df = drift.read_union(spark, [str(tmp_path / f"{i}.parquet") for i in (1, 2, 3)], {"old": "a"})
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "bigint"}
    assert rows(df.select("a", "b", "c")) == sorted([(1.0, "x", None), (2.0, None, None), (1.5, None, 7), (3.0, "y", None)], key=repr)


def test_union_follows_renames(spark, tmp_path):
    import pyarrow.parquet as pq

    names = {0: "clt", 1: "cldfrac", 2: "cldfrac", 3: "clt", 4: "CLT", 6: "cldfrac"}  # there and back, on to a third, and again after a gap
    files = [("a", i, 10 + i) for i in range(7)] + [("b", i, 30 + i) for i in range(3)]
    v = [(10 + i, n, "Total cloud_cover", f"{i + 1},4", "time,lat", "int" if i % 2 else "float") for i, n in names.items()]
    v += [(10 + i, "tas", "Temp", "1", "time", "float") for i in range(7)]
    # in b, one file holds both names: they are two variables there
    v += [(30, "x", "Wind", "1", "time", "short"), (31, "y", "wind", "2", "time", "int"), (32, "x", "wind", "3", "time", "short"), (32, "y", "wind", "3", "time", "int")]
    fdf = spark.createDataFrame(files, "agg_id string, file_index int, file_id bigint")
    items = drift.header_items(spark.createDataFrame(v, "file_id bigint, var_name string, full_name string, shape string, dims string, dtype string"), "V", "var_name", "full_name", "dtype")
    got = {(r.agg_id, r.item_name): (r.dtype, r.shape, r.n_files, r.first_index, r.last_index, r.old_names) for r in drift.union_schema(fdf, items).collect()}
    assert got == {("a", "cldfrac"): ("double", "7 4", 6, 0, 6, ["CLT", "clt"]), ("a", "tas"): ("float", "1", 7, 0, 6, []), ("b", "x"): ("short", "3", 2, 0, 2, []), ("b", "y"): ("int", "3", 2, 1, 2, [])}
    renamed = {r.item_name: r.name for r in drift.canonical_names(fdf, items).where("agg_id = 'a'").collect()}
    for i, n in names.items():
        pq.write_table(pa.table({n: pa.array([i], pa.int32() if i % 2 else pa.float32())}), tmp_path / f"{i}.parquet")
    whole = drift.read_union(spark, [str(tmp_path / f"{i}.parquet") for i in names], renamed)
    assert dict(whole.dtypes) == {"cldfrac": "double"} and rows(whole) == [(float(i),) for i in names]


def test_union_of_all_kinds_of_columns(spark, tmp_path):
    from decimal import Decimal

    import pyarrow.parquet as pq
    from pyspark.sql import types as T

    day, moment = datetime(2020, 1, 2).date(), datetime(2020, 1, 2, 3, 4, 5, 6)
    a = {"ts": pa.array([moment], pa.timestamp("us")), "d": pa.array([day]), "dec": pa.array([Decimal("1.25")], pa.decimal128(5, 2)), "l": pa.array([[1, None]], pa.list_(pa.int32())), "u": pa.array([4_000_000_000], pa.uint32()), "s": pa.array([{"x": 1, "y": "b"}]), "raw": pa.array([b"z"]), "same": pa.array([moment], pa.timestamp("us", "UTC"))}
    b = {"ts": pa.array([day]), "d": pa.array([moment], pa.timestamp("us")), "dec": pa.array([7], pa.int32()), "l": pa.array([[2.5]], pa.list_(pa.float64())), "u": pa.array([3], pa.uint64()), "s": pa.array([{"y": "c", "w": 2.0}]), "raw": pa.array(["text"]), "same": pa.array([moment], pa.timestamp("us", "UTC"))}
    for k, columns in enumerate((a, b)):
        pq.write_table(pa.table(columns), tmp_path / f"{k}.parquet")
    out = drift.read_union(spark, iter([str(tmp_path / "0.parquet"), f"file://{tmp_path}/1.parquet"]))
    kinds = {f.name: f.dataType for f in out.schema.fields}
    assert kinds == {"ts": T.TimestampNTZType(), "d": T.TimestampNTZType(), "dec": T.DecimalType(12, 2), "l": T.ArrayType(T.DoubleType()), "u": T.DecimalType(20, 0), "s": T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType()), T.StructField("w", T.DoubleType())]), "raw": T.BinaryType(), "same": T.TimestampType()}
    one, two = sorted(out.collect(), key=lambda r: r.u, reverse=True)
    assert (one.ts, one.d, one.dec, one.l, int(one.u), bytes(one.raw)) == (moment, datetime(2020, 1, 2), Decimal("1.25"), [1.0, None], 4_000_000_000, b"z") and one.s.asDict() == {"x": 1, "y": "b", "w": None}
    assert (two.ts, two.d, two.dec, two.l, int(two.u), bytes(two.raw)) == (datetime(2020, 1, 2), moment, Decimal("7.00"), [2.5], 3, b"text") and two.s.asDict() == {"x": None, "y": "c", "w": 2.0}
    with pytest.raises(ValueError):
        drift.read_union(spark, [])


# 2 times
STAMPS = [
    ("2018-03-25 02:30", None), ("2018-10-28 02:30", None), ("2018-10-28T02:30:00Z", None), ("2018-07-01", None), ("03/04/2018 05:06", None), ("11/03/2018 12:00 AM", None), ("11/03/2018 12:05 PM", None),
    ("20180101T010203+0530", None), ("2018-060T23:00Z", None), ("2017-366T23:00Z", None), ("25824140.5", None), ("1199565600", None), ("1199565600000", None), ("1199565600000999", None), ("7", None), ("", None), (None, None), ("TBD", None), ("0000-00-00T00:00:00", None),
    ("Fri Aug 20 07:00:00 CEST 2010", None), ("10 Apr 2017 15:00 +0000", None), ("2018-03-25T02:30[Europe/Berlin]", None), ("2018-01-25 02:30:00 Asia/Kolkata", None), ("2018-01-25 02:30:00 Nowhere/Land", None), ("2018-01-18T17:00:01.23499Z", None), ("2018-02-30 10:00", None),
    ("21246.6666666667 days since 1950-01-01", "360_day"), ("59 days since 2001-01-01", "360_day"), ("59 days since 2001-01-01", "noleap"), ("1154 days since 2001-01-01", "NOLEAP"), ("59 days since 2001-01-01", None), ("100000.000000000 hours since 1900-01-01 00:00:00", "standard"),
]


@pytest.mark.parametrize("zone", ["Europe/Berlin", "Asia/Kolkata", "America/New_York"])
def test_timestamps_against_plain_version(spark, zone):
    df = spark.createDataFrame([(i, s, c, zone, True) for i, (s, c) in enumerate(STAMPS)], "i int, s string, c string, z string, f boolean").withColumn("_x", F.lit(1))
    got = {r.i: r.ms for r in times.resolved(times.parsed(df, "s", "c", "f"), "z", "ms").collect()}
    for i, (s, c) in enumerate(STAMPS):
        if s == "2018-01-25 02:30:00 Nowhere/Land":
            assert got[i] is None
        else:
            assert got[i] == utc_ms(s, c, zone, True), s


def test_zone_is_found_from_order_and_arrival(spark):
    data = []
    for k in range(40):
        t = datetime(2018, 1 + k // 4, 3 + k % 4, 5)
        data.append((k, "g", t.strftime("%Y-%m-%d %H:%M"), None, False, int((t - datetime(1970, 1, 1)).total_seconds() * 1000) - 9 * 3_600_000))
    data += [(100 + k, g, "2018-01-01 00:00", None, False, None) for k, g in enumerate(("few", None))]
    df = spark.createDataFrame(data, "i int, g string, s string, c string, f boolean, expected bigint").withColumn("site", F.lit("x"))
    out = {r.g: r for r in times.estimated_zones(times.parsed(df, "s", "c", "f"), "g", "site", ["Europe/Berlin", "Asia/Tokyo", "UTC"], "expected").collect()}
    assert (out["g"].zone, out["g"].violations, out["g"].rows) == ("Asia/Tokyo", 0, 40)
    # no texts of their own: the siblings' history
    assert (out["few"].zone, out["few"].rows) == ("Asia/Tokyo", 0) and out[None].zone == "Asia/Tokyo"
    assert times.estimated_zones(times.parsed(df.limit(0), "s", "c", "f"), "g", "site", ["UTC"], "expected").count() == 0


def test_offset_histories():
    names = {z: k for k, (zones, _, _) in enumerate(times.offset_histories()) for z in zones}
    assert names["Europe/Berlin"] == names["Europe/Paris"] != names["Europe/Lisbon"] and names["America/New_York"] != names["America/Chicago"]
    _, since, offsets = times.offset_histories()[names["Europe/Berlin"]]
    at = int(datetime(2024, 3, 31, 1).timestamp() * 1000)
    assert at in since and offsets[list(since).index(at)] == 120


def test_zones_flag_where_the_estimate_differs(spark):
    out = problems.p2_zones(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 24 and all((r.differs is None) == (r.estimated_zone is None) for r in out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_the_estimate_alone_gives_the_instants(spark):
    found, alone = ({tuple(r) for r in f(spark, "/root/testdata/sf0.01").collect()} for f in (problems.p2_found, problems.p2_alone))
    assert len(found & alone) >= 0.97 * len(found) and len(found & alone) >= 0.97 * len(alone)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_units_of_hidden_names_are_predicted(spark):
    r = problems.p4_hidden(spark, "/root/testdata/sf0.01").first()
    assert r.hidden == r.converted + r.review and r.converted > 0.5 * r.hidden and r.right > 0.97 * r.converted


# 3 spikes
def frame(spark, series, missing=-999.0, source="s", element="tas-v0", unit="K"):
    data = [(k, source, k * 3600_000, element, (missing, [float(x) for x in row] if row is not None else None), unit) for k, row in enumerate(series)]
    return spark.createDataFrame(data, "record_id bigint, source_id string, t bigint, element_key string, spec struct<missing:float,data:array<float>>, unit string")


def test_bad_readings(spark):
    rng = np.random.default_rng(0)
    x = 280 + 5 * np.sin(np.arange(300) / 20) + rng.normal(0, 0.5, 300).round(2)
    x[200:] += 40  # a lasting change of level
    x[50], x[51], x[120], x[130] = 330, 331, -5, -999.0
    x[150:162] = 277.25
    x[155] = -999.0
    series = [[v, 281 + 0.01 * (k % 7)] for k, v in enumerate(x)]
    series[100][1] = float("inf")
    series[101] = None
    want = {(50, 0, "jump"), (51, 0, "jump"), (120, 0, "impossible"), (100, 1, "impossible")} | {(k, 0, "stuck") for k in range(150, 162) if k != 155}
    for rows_ in (spikes.BLOCK_ROWS, 100):  # whole, and in blocks that see their neighbours
        got = {(r.record_id, r.cell_no, r.reason) for r in spikes.bad_readings(frame(spark, series), F.col("unit"), rows_, 60).collect()}
        assert got == want
    repeated = frame(spark, series).unionByName(frame(spark, series).withColumn("record_id", F.col("record_id") + 1000))
    got = {(r.record_id, r.cell_no, r.reason) for r in spikes.bad_readings(repeated, F.col("unit")).collect()}
    assert got == want | {(k + 1000, c, w) for k, c, w in want}
    assert spikes.bad_readings(frame(spark, series).limit(0), F.col("unit")).count() == 0


def test_blocks_of_uneven_times_judge_as_the_whole_series(spark):
    rng = np.random.default_rng(5)
    n = 1200
    x = 280 + 5 * np.sin(np.arange(n) / 40) + rng.normal(0, 0.5, n).round(2)
    outage = np.arange(n) * 60_000
    outage[600:] += 10**10
    outage[-1] = 10**13  # one stray late slice
    slower = np.r_[np.arange(700) * 1000, 700_000 + np.arange(500) * 3600_000]
    want = set()
    for a in range(95, n - 20, 110):  # runs of ten that lie everywhere against the borders of blocks
        x[a : a + 10] = 277.25
        want |= {(k, 0, "stuck") for k in range(a, a + 10)}
    x[60], x[640] = 330, 330
    want |= {(60, 0, "jump"), (640, 0, "jump")}
    rare = np.full(n, -999.0)  # a cell with a reading in every 60th slice, the last twelve equal
    rare[::60] = 281 + 0.01 * (np.arange(0, n, 60) // 60 % 7)
    rare[480::60] = 282.5
    want |= {(k, 1, "stuck") for k in range(480, n, 60)}
    below = np.where(np.arange(n) % 2 == 0, -5.0, 281 + 0.01 * (np.arange(n) % 7))  # every other reading is impossible
    want |= {(k, 2, "impossible") for k in range(0, n, 2)}
    for t in (slower, outage):
        data = [(k, "s", int(t[k]), "tas-v0", (-999.0, [float(x[k]), float(rare[k]), float(below[k])]), "K") for k in range(n)]
        data += [(5000 + k, "s", int(t[k]), "ps-v0", (-999.0, [1e5 + k % 13]), "Pa") for k in range(0, n, 7)]
        df = spark.createDataFrame(data, "record_id bigint, source_id string, t bigint, element_key string, spec struct<missing:float,data:array<float>>, unit string")
        for block, halo in ((4096, 160), (50, 40), (7, 30)):
            assert {(r.record_id, r.cell_no, r.reason) for r in spikes.bad_readings(df, F.col("unit"), block, halo).collect()} == want
    sizes = [r["count"] for r in spikes._blocks(df.selectExpr("source_id source", "element_key element", "t"), 50).groupBy("source", "element", "block").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == len(data)


def test_blocks_keep_one_time_together(spark):
    data = [("s", "tas-v0", 5)] * 300 + [("s", "tas-v0", 6 + k) for k in range(5)] + [("s", "ps-v0", 5)] * 300
    out = spikes._blocks(spark.createDataFrame(data, "source string, element string, t bigint"), 20).groupBy("element", "block", "split").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("t").alias("n")).collect()
    assert sorted((r.element, r.a, r.z, r.n, r.split) for r in out) == [("ps-v0", 5, 5, 300, False), ("tas-v0", 5, 5, 300, True), ("tas-v0", 6, 10, 5, True)]


def test_nine_equal_readings_of_repeats_are_not_stuck(spark):
    x = [[280 + (k * 37 % 11) / 10] for k in range(40)]
    for k in range(10, 19):
        x[k] = [281.5]
    x[9], x[19] = [280.1], [280.2]
    df = frame(spark, x)
    assert spikes.bad_readings(df.unionByName(df.withColumn("record_id", F.col("record_id") + 100)), F.col("unit")).count() == 0


@pytest.mark.parametrize("variable,unit,bad,good", [("tas", "degC", -273.15, -273.1), ("ps", "hPa", 0.0, 0.1), ("hur", "%", 100.5, 100.0), ("hur", "1", 1.01, 1.0), ("siconc", "fraction", -0.01, 0.0), ("huss", "g/kg", -1e-6, 0.0), ("pr", None, -1.0, 0.0)])
def test_bounds(variable, unit, bad, good):
    a, b, c = (np.float32(x) for x in spikes.bounds(variable, unit))
    out = [bool(x <= a or x < b or x > c) for x in (np.float32(bad), np.float32(good))]
    assert out == [True, False]


def test_groups_that_straddle_batches():
    t = spikes_table(200)
    whole = spikes._judge(t).to_pylist()
    pieces = [b for lo in range(0, t.num_rows, 37) for b in t.slice(lo, 37).to_batches()]
    assert [r for b in spikes._judged(iter(pieces)) for r in b.to_pylist()] == whole and whole
    assert list(spikes._judged(iter([]))) == []


def spikes_table(n):
    data = [[280 + (k * 37 % 11) / 10] if k % 50 != 25 else [400.0] for k in range(n)]
    return pa.table({"record_id": pa.array(range(n), pa.int64()), "source": ["a"] * (n // 2) + ["b"] * (n - n // 2), "t": pa.array(range(n), pa.int64()), "element": ["tas-v0"] * n, "unit": pa.array(["K"] * n), "missing": pa.array([np.nan] * n, pa.float32()), "data": pa.array(data, pa.list_(pa.float32())), "block": pa.array([0] * n, pa.int64()), "core": [True] * n})


# 4 units
@pytest.mark.parametrize("text,value,common", [("°F", 32.0, 273.15), ("deg. C", 0.0, 273.15), ("0.1 hPa", 5.0, 50.0), ("tenths of a hPa", 5.0, 50.0), ("mm/day", 86400.0, 1.0), ("inches per day", 1.0, 25.4 / 86400), ("MJ m-2 day-1", 0.0864, 1.0), ("kt", 1.0, 1852 / 3600), ("gpdm", 2.0, 20.0), ("10^-3 kg/kg", 1.0, 0.001), ("per mille", 1.0, 0.001), ("milliwatts per square centimetre", 1.0, 10.0), ("hours since 1970-01-02", 1.0, 1500.0), ("N m-2", 3.0, 3.0), ("mm/s", 2.0, 2.0)])
def test_units(text, value, common):
    q, f, o = parse_unit(text)
    assert value * f + o == pytest.approx(common)


@pytest.mark.parametrize("text", ["", None, "-", "n/a", "unknown", "undefined", "model output", "0", "deg since 1970", "hours since 1970-13-01"])
def test_no_units(text):
    assert parse_unit(text) is None


def test_places_in_text():
    assert resolve_unit("n/a", "Sea Level Pressure [kPa]")[0::3] == ("pressure", "text")
    assert resolve_unit("hPa", "given in kPa")[1::2] == (100, "column")
    assert resolve_unit(None, "Values of x are given in deg. C.")[2] == 273.15
    assert resolve_unit(None, "long_name: Total Cloud Cover; comment: run 5") == (None, None, None, None)
    assert resolve_unit("rad", None, "Y")[0] == "latitude" and resolve_unit("rad", None) [0] is None


def test_harmonised_names_and_predicts(spark):
    rng = random.Random(1)
    data = []
    for k in range(900):
        kelvin = k % 2 == 0
        value = rng.uniform(260, 300) if kelvin else rng.uniform(-10, 25)
        named = k % 9 != 0
        data.append(("t", k, "valid_max", value, None, ("K" if kelvin else "degC") if named else None, None, "", "s", "air temperature"))
    data += [("t", 2000, "valid_max", None, None, "K", None, "", "s", "c"), ("t", 2001, "valid_max", float("nan"), None, "degC", None, "", None, None)]
    df = spark.createDataFrame(data, "src_table string, rec_id bigint, field_name string, value double, other double, units string, text string, hint string, source string, category string")
    common = spark.createDataFrame([("temperature", "K", 1000)], "quantity string, common_unit string, steps_per_unit bigint")
    out = {r.rec_id: r for r in harmonise.harmonised(df, common).collect()}
    assert len(out) == 901 and 2000 not in out and out[2001].common_steps is None
    assert out[1].common_steps == round((data[1][3] + 273.15) * 1000)
    predicted = [out[k] for k in range(0, 900, 9)]
    assert all(r.named_by == "predicted" for r in predicted)
    right = [abs(r.common_value - (data[r.rec_id][3] + (0 if r.rec_id % 2 == 0 else 273.15))) < 1e-6 for r in predicted if r.route == "convert"]
    assert len(right) > 80 and all(right)
    assert harmonise.harmonised(df.limit(0), common).count() == 0


# 5 intervals
def plain_periods(data):
    out = []
    for key in {d[0] for d in data}:
        spans = sorted({(s, e) for k, s, e in data if k == key and s is not None and e is not None and s < e})
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged] + [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_periods(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "b", None]), s, s + rng.choice([-2, 0, 1, 3, 9])) for s in (rng.randint(-60, 60) for _ in range(80))]
    data += [("a", None, 4), ("b", 3, None), ("a", -200, 200) if seed == 2 else ("c", 1, 2)] + data[:9]
    df = spark.createDataFrame(data, "k string, s bigint, e bigint").withColumn("kind", F.lit(1))
    assert rows(intervals.periods_and_gaps(df, ["k"], "s", "e", block=7)) == plain_periods(data)
    assert intervals.periods_and_gaps(df.limit(0), ["k"], "s", "e").count() == 0
