"""The driver's contract: every query runs on the smallest tables and has the rows of its SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("GRIDLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SOME = ["ave_xy_cosine", "reduce_stddev_t", "lowpass_6month", "season_filter_complete", "asof_events", "time_convert_linear", "regrid_uniform_bilinear", "workflow_request_anomaly", "group_season", "p5_found", "kernel_capabilities", "p1_log", "p1_read_union", "workflow_groupby_anomaly", "workflow_two_variables", "workflow_regrid_to_input", "lowpass_month_of_daily", "eof_reconstruct", "netcdf_roundtrip", "stream_sessions"]


def normal(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v != v else round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        if str(want[c].dtype).startswith(("int", "uint")):
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert normal(got) == normal(want)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["member", "t", "time", "value"]
