"""Percentiles: exact against sorting, mergeable summaries within their bounds, and the SQL of the query."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gridloom.llm")

from gridloom.llm import percentiles  # noqa: E402


def test_percentiles_exact_and_merged(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.normal(0, 1e-3, 300)] + [("b", float(x)) for x in rng.choice([-5.5, 0.0, -0.0, 7.25], 50)] + [("c", float(x)) for x in rng.lognormal(0, 40, 200)] + [(None, 1.0), ("d", None), ("d", float("nan")), ("a", float("inf")), ("e", 5e-324), ("e", -5e-324)]
    df = spark.createDataFrame(data, "k string, v double").withColumn("bucket", F.lit("clash"))
    want = {}
    for key in ("a", "b", "c", None, "e"):
        v = sorted(x for k, x in data if k == key and x is not None and np.isfinite(x))
        for p in (1, 50, 95, 100):
            want[key, p] = v[max(1, -(-len(v) * p // 100)) - 1]
    got = {(r.k, r.pct): r.value for r in percentiles.percentiles(df, ["k"], "v", [1, 50, 95, 100], grid=2).collect()}
    assert got == want
    halves = [percentiles.summary(df.where(c), ["k"], "v") for c in ("v < 0.001 or v is null", "v >= 0.001")]
    merged = percentiles.located(percentiles.merge(halves, ["k"]), ["k"], [1, 50, 95, 100]).collect()
    for r in merged:
        assert r.lo <= want[r.k, r.pct] <= r.hi and (r.hi - r.lo) <= 1 / 1024 * max(abs(r.lo), abs(r.hi))
    assert len(merged) == len(want)
    assert percentiles.percentiles(df.limit(0), ["k"], "v", [50]).count() == 0


def test_intervals_order_like_values(spark):
    values = sorted({0.0, 1.0, 1.5, 2.0, 1e300, -1e300, 3.4e38, 1e-320, -1e-320, 5e-324, 0.1, -0.1, 8.0, 1e15, 1.7e308, -1.7e308})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    codes = [r[0] for r in df.select(percentiles.interval_of(F.col("v")), "v").orderBy("v").collect()]
    assert codes == sorted(set(codes)) and len(codes) == len(values)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_sql(spark):
    import duckdb

    from gridloom.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view cdrecords as from '{folder}/cdrecords.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["p6_percentiles"]).fetchall(), key=repr)
    assert sorted(map(tuple, queries.queries()["p6_percentiles"](spark, folder).collect()), key=repr) == want


def test_groups_whose_numbers_collide_go_by_their_keys(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(v)) for k in "abc" for v in range(7)], "k string, v double")
    want = sorted(map(tuple, percentiles.percentiles(df, ["k"], "v", [10, 50], grid=2).collect()))
    monkeypatch.setattr(percentiles.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    assert sorted(map(tuple, percentiles.percentiles(df, ["k"], "v", [10, 50], grid=2).collect())) == want == sorted((k, p, 7, v) for k in "abc" for p, v in ((10, 0.0), (50, 3.0)))
