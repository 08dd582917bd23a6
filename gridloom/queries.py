"""Queries of the cube operators over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.calendar import calendar_bin, cycle_bin
from gridloom.operators import cube as C
from gridloom.operators import records as R
from gridloom.operators.cube import Cube, Span
from gridloom.operators.linalg import Eof, rescaled_vectors, row_vectors
from gridloom.operators.regrid import axis_table, gaussian_axis, regridded, uniform_axis
from gridloom.plans.execute import execute
from gridloom.plans.kernels import capabilities, record_udf, reduce_udf
from gridloom.sources.catalog import Catalog, aggregation_rows
from gridloom.sources.netcdf3 import cube_of, write_cube
from gridloom.sources.tables import epoch_millis, shared_folder, table
from gridloom.streaming.windows import drained, sessions, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The cube of the relational tables: members are return flags, t months, y nations, x a quarter of the globe; a cell whose lines all have no discount is missing.
CUBE_SQL = """with cube as (
  select member, t, time, y, lat, x, lon, avg(v) as value from (
    select l_returnflag as member, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as integer) as t, cast(date_trunc('month', l_shipdate) as timestamp) as time,
           cast(s_nationkey as integer) as y, s_nationkey * cast(7.2 as double) - cast(86.4 as double) as lat, cast(l_suppkey % 4 as integer) as x, cast(l_suppkey % 4 as double) * 90 as lon,
           case when l_discount = 0 then null else l_quantity end as v
    from lineitem join supplier on l_suppkey = s_suppkey) group by all)"""

LATS, LONS = [k * 7.2 - 86.4 for k in range(25)], uniform_axis(0.0, 90.0, 4)


def cells(spark: SparkSession, d: str) -> Cube:
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_suppkey", "l_discount", "l_quantity")
    joined = lines.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    ship = F.col("l_shipdate")
    time = F.make_timestamp_ntz(F.year(ship), F.month(ship), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    flat = joined.select(F.col("l_returnflag").alias("member"), ((F.year(ship) - 1995) * 12 + F.month(ship) - 1).alias("t"), time.alias("time"), F.col("s_nationkey").cast("int").alias("y"), (F.col("l_suppkey") % 4).cast("int").alias("x"), F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("v"))
    df = flat.groupBy("member", "t", "time", "y", "x").agg(F.avg("v").alias("value")).withColumns({"lat": F.col("y") * F.lit(7.2) - F.lit(86.4), "lon": F.col("x") * F.lit(90.0)})
    return Cube(df, ("t", "y", "x"), ("member",), ("time", "lat", "lon"), axis_values={"y": LATS, "x": LONS})


def events(spark: SparkSession, d: str) -> Cube:
    """Events as a cube: members are event types, time the moment of each."""
    df = table(spark, d, "events").select(F.col("event_type").alias("member"), F.col("event_id").alias("t"), F.col("ts").alias("time"), F.col("user_id").alias("x"), "value")
    return Cube(df, ("t", "x"), ("member",), ("time",))


def shown(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show; ``nudge`` is added first where values lie halfway between two results."""
    return df.select(*[F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, base: bool = True):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{CUBE_SQL}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if base else sql
        return f

    return add


# reductions
_AGG = {
    "max": "max(value)", "min": "min(value)", "sum": "sum(value)", "ave": "avg(value)", "rms": "sqrt(sum(value * value) / nullif(count(value) - 1, 0))", "rmsum": "sqrt(sum(value) / nullif(count(value) - 1, 0))",
    "stddev": "stddev_samp(value)", "std": "stddev_pop(value)", "var": "var_pop(value)", "ptp": "max(value) - min(value)", "sqadd": "sum(value * value)",
}
_KEPT = {"t": "member, y, x, lat, lon", "xy": "member, t, time", "txy": "member", "x": "member, t, time, y, lat", "y": "member, t, time, x, lon"}


def _reduction(name: str, op: str, axes: str, weights: str | None = None, sql: str | None = None) -> None:
    QUERIES[name] = lambda s, d: shown(C.reduced(cells(s, d), op, axes, weights).cells())
    SQL[name] = f"{CUBE_SQL} select {_KEPT[axes]}, round({sql or _AGG[op]}, 6) as value from cube group by {_KEPT[axes]}"


for _op in ("max", "min", "sum", "ave", "rms", "stddev", "sqadd"):
    _reduction(f"reduce_{_op}_t", _op, "t")
for _name, _op in (("rmsum_t", "rmsum"), ("std_pop_t", "std"), ("var_pop_t", "var"), ("ptp_t", "ptp")):
    _reduction(_name, _op, "t")
for _op in ("max", "min", "sum"):
    _reduction(f"reduce_{_op}_xy", _op, "xy")
_reduction("reduce_max_x", "max", "x")
_reduction("reduce_sum_y", "sum", "y")
_reduction("ave_xy", "ave", "xy")
_reduction("ave_txy", "ave", "txy")
_COS = "sum(value * cos(radians(lat))) / nullif(sum(case when value is not null then cos(radians(lat)) end), 0)"
_reduction("ave_xy_cosine", "ave", "xy", "cosine", _COS)
_reduction("ave_txy_cosine", "ave", "txy", "cosine", _COS)
_AREA = "(sin(radians(least(lat + 3.6, 90))) - sin(radians(greatest(lat - 3.6, -90))))"
_reduction("area_weighted_mean", "ave", "xy", "area:7.2", f"sum(value * {_AREA}) / nullif(sum(case when value is not null then {_AREA} end), 0)")

def _signed(name: str, op: str, sql: str) -> None:
    """A reduction of values of both signs: the departures from 25.5."""
    QUERIES[name] = lambda s, d: shown(C.reduced(C.with_scalar(cells(s, d), "diff", 25.5), op, "t").cells())
    SQL[name] = f"{CUBE_SQL}, signed as (select * replace (value - 25.5 as value) from cube) select {_KEPT['t']}, round({sql}, 6) as value from signed group by {_KEPT['t']}"


_signed("reduce_maxmag_t", "maxmag", "case when max(value) >= -min(value) then max(value) else min(value) end")
_signed("reduce_minmag_t", "minmag", "min(value) filter (abs(value) = least_) ")
SQL["reduce_minmag_t"] = SQL["reduce_minmag_t"].replace("from signed group", "from (select *, min(abs(value)) over (partition by member, y, x) as least_ from signed) group")
_signed("reduce_sub_t", "sub", "-sum(value)")

# domains
_CELL = "member, t, y, x, time, lat, lon, round(value, 6) as value"


def _subset(name: str, spans: list[Span], where: str) -> None:
    QUERIES[name] = lambda s, d: shown(C.subset(cells(s, d), spans).cells())
    SQL[name] = f"{CUBE_SQL} select {_CELL} from cube where {where}"


_subset("subset_indices", [Span("y", 5, 10), Span("x", 1, 2), Span("t", 0, 40)], "y between 5 and 10 and x between 1 and 2 and t between 0 and 40")
_subset("subset_values", [Span("y", -20, 30, "values")], "lat between -20 and 30")
_subset("subset_values_nearest", [Span("y", 1, 3, "values")], "lat = (select min(lat) from cube where lat > 1)")
_subset("subset_values_lonwrap", [Span("x", -100, 10, "values")], "lon in (0, 270)")
_subset("subset_scalar", [Span("x", 180, None, "values")], "lon = 180")
_subset("subset_time", [Span("t", "1996-03-01", "1997-03-01", "timestamps")], "time >= timestamp '1996-03-01' and time < timestamp '1997-03-01'")
_subset("subset_time_scalar", [Span("t", "1996-03-15", None, "values")], "time = timestamp '1996-03-01'")
_subset("subset_lon_nearest", [Span("x", 100, None, "values")], "lon = 180")
_subset("subset_lon_nearest_wrapped", [Span("x", -200, -190, "values")], "lon = 180")
_subset("subset_lon_crossing", [Span("x", 260, 100, "values")], "lon in (270, 0, 90)")
_subset("subset_level_list", [Span("y", levels=(-86.4, 0.0, 14.4, 14.5))], "round(lat, 3) in (-86.4, 0, 14.4)")
_subset("subset_empty", [Span("t", 5000, 6000)], "t between 5000 and 6000")
_subset("season_filter_djf", [Span("t", season="DJF")], "month(time) in (12, 1, 2)")
_subset("season_filter_jja_year", [Span("t", "1996-01-01", "1997-01-01", "timestamps", "JJA")], "year(time) = 1996 and month(time) in (6, 7, 8)")
_subset("level_pick", [Span("y", 7, 7)], "y = 7")


@query("subset_lazy_values", f"select {_CELL} from cube where lat = (select min(lat) from cube where lat > 1) and lon = 180")
def _lazy(s, d):
    c = replace(cells(s, d), axis_values={})
    return shown(C.subset(c, [Span("y", 1, 3, "values"), Span("x", 100, None, "values")]).cells())


@query("season_filter_complete", """+ w as (select *, year(time) + case when month(time) = 12 then 1 else 0 end as sy from cube where month(time) in (12, 1, 2))
select member, t, y, x, time, lat, lon, round(value, 6) as value from w where sy in (select sy from w group by sy having count(distinct month(time)) = 3)""")
def _complete(s, d):
    return shown(C.complete_seasons(cells(s, d), "DJF").cells())


@query("mask_polygon", f"""select {_CELL} from cube where lon < 200 and lon >= -10 and lat >= -60 + (lon + 10) * 30 / 210.0 and lat < 60 - (lon + 10) * 20 / 210.0""")
def _mask(s, d):
    return shown(C.masked(cells(s, d), [[(-10, -60), (200, -30), (200, 40), (-10, 60)]]).cells())


# ensembles
_TWO = "+ a as (select t, y, x, lat, lon, time, value from cube where member = 'A'), n as (select t, y, x, value from cube where member = 'N'), r as (select t, y, x, value from cube where member = 'R')\n"
_ELEMENT = {"min": "case when a.value <= r.value then a.value when r.value < a.value then r.value end", "max": "case when a.value >= r.value then a.value when r.value > a.value then r.value end", "sum": "a.value + r.value", "diff": "a.value - r.value", "mult": "a.value * r.value", "div": "a.value / nullif(r.value, 0)"}


def _elementwise(op: str) -> None:
    def run(s, d):
        c = cells(s, d)
        return shown(C.combined(op, [C.member(c, "A"), C.member(c, "R")]).cells())

    query(f"ens_{op}", f"{_TWO} select a.t, a.y, a.x, time, lat, lon, round({_ELEMENT[op]}, 6) as value from a join r on a.t = r.t and a.y = r.y and a.x = r.x")(run)


for _op in _ELEMENT:
    _elementwise(_op)


@query("ens_sum3", f"{_TWO} select a.t, a.y, a.x, time, lat, lon, round(a.value + n.value + r.value, 6) as value from a join n on a.t = n.t and a.y = n.y and a.x = n.x join r on a.t = r.t and a.y = r.y and a.x = r.x")
def _sum3(s, d):
    c = cells(s, d)
    return shown(C.combined("sum", [C.member(c, m) for m in "ANR"]).cells())


@query("ens_ave_sum_count", "select t, y, x, round(avg(value), 6) as ave, round(sum(value), 6) as sum, count(value) as count from cube group by t, y, x")
def _ensemble(s, d):
    return shown(C.ensemble([C.member(cells(s, d), m) for m in "ANR"]))


@query("ens_std", "select t, y, x, round(avg(value), 6) as ave, round(stddev_pop(value), 6) as std, round(stddev_samp(value), 6) as stddev from cube group by t, y, x")
def _ens_std(s, d):
    return shown(C.over_members(cells(s, d), ("ave", "std", "stddev")))


@query("corr_members", """select p.member as a, q.member as b, round(corr(p.value, q.value), 6) as corr, count(*) as n from cube p join cube q on p.t = q.t and p.y = q.y and p.x = q.x
where p.member < q.member and p.value is not null and q.value is not null group by p.member, q.member""")
def _corr(s, d):
    return shown(C.correlations(replace(cells(s, d), coords=())))


# calendar groups
_BINS = {
    "year": "year(time)", "month": "(year(time) - 1970) * 12 + month(time)", "monthofyear": "month(time)", "decade": "floor(year(time) / 10)", "season": "(year(time) + case when month(time) = 12 then 1 else 0 end - 1970) * 4 + floor((month(time) % 12) / 3)",
    "seasonofyear": "floor((month(time) % 12) / 3)", "6-month": "floor(((year(time) - 1970) * 12 + month(time)) / 6)", "2-year": "floor((year(time) - 1970) / 2)", "3/1-month": "floor(((year(time) - 1970) * 12 + month(time) + 1) / 3)", "4-monthofyear": "floor((month(time) - 1) / 4)",
}
_DAYS = {"hourofday": "hour(time)", "day": "date_diff('day', date '1970-01-01', cast(time as date))", "dayofyear": "dayofyear(time)", "5-day": "floor(date_diff('day', date '1970-01-01', cast(time as date)) / 5)", "7-dayofyear": "floor((dayofyear(time) - 1) / 7)"}
_EVENTS = "with cube as (select event_type as member, event_id as t, ts as time, user_id as x, value from events)"


def _grouped(group: str, bin_: str, of_events: bool) -> None:
    name = "group_" + group.replace("-", "_").replace("/", "_")
    if of_events:
        QUERIES[name] = lambda s, d: shown(C.reduced(events(s, d), "ave", "tx", group=group).cells())
        SQL[name] = f"{_EVENTS} select member, cast({bin_} as integer) as bin, round(avg(value), 6) as value from cube group by 1, 2"
    else:
        QUERIES[name] = lambda s, d: shown(C.reduced(cells(s, d), "ave", "t", group=group).cells())
        SQL[name] = f"{CUBE_SQL} select member, cast({bin_} as integer) as bin, y, x, lat, lon, round(avg(value), 6) as value from cube group by all"
        SQL[name] = SQL[name].replace("group by all)", "group by all)")


for _g, _b in _BINS.items():
    _grouped(_g, _b, False)
for _g, _b in _DAYS.items():
    _grouped(_g, _b, True)


@query("group_month_noleap", """select event_type as member, cast((y - 1970) * 12 + case when d < 31 then 1 when d < 59 then 2 when d < 90 then 3 when d < 120 then 4 when d < 151 then 5 when d < 181 then 6 when d < 212 then 7 when d < 243 then 8 when d < 273 then 9 when d < 304 then 10 when d < 334 then 11 else 12 end as integer) as bin, round(avg(value), 6) as value
from (select *, 1970 + (epoch_ms(ts) // 86400000) // 365 as y, (epoch_ms(ts) // 86400000) % 365 as d from events) group by 1, 2""", base=False)
def _noleap(s, d):
    c = events(s, d)
    c = replace(c, df=c.df.withColumn("time", epoch_millis(F.col("time"))), calendar="noleap")
    return shown(C.reduced(c, "ave", "tx", group="month").cells())


@query("group_day_360", "select event_type as member, cast((epoch_ms(ts) // 86400000) % 360 // 30 + 1 as integer) as bin, round(max(value), 6) as value from events group by 1, 2", base=False)
def _day360(s, d):
    c = events(s, d)
    c = replace(c, df=c.df.withColumn("time", epoch_millis(F.col("time"))), calendar="360_day")
    return shown(C.reduced(c, "max", "tx", group="monthOfYear").cells())


@query("group_day_midpoint", "select event_type as member, cast(date_diff('day', date '1970-01-01', cast(ts + interval 9 hours as date)) as integer) as bin, round(avg(value), 6) as value from events group by 1, 2", base=False)
def _midpoint(s, d):
    c = events(s, d)
    c = replace(c, df=c.df.withColumn("time_end", F.col("time") + F.expr("interval 18 hours")), coords=("time", "time_end"))
    return shown(C.reduced(c, "ave", "tx", group="day").cells())


@query("group_cycle_map", """select event_type as member, cast((((date_diff('day', date '1970-01-01', cast(ts as date)) - 19723 + 1) // 3) % 4) as integer) as bin, count(value) as n from events group by 1, 2""", base=False)
def _cycle(s, d):
    b = cycle_bin(F.col("time"), "day", 3, 4, (19723 + 2) % 3, 19723)
    return events(s, d).df.groupBy("member", b.alias("bin")).agg(F.count("value").alias("n"))


@query("group_season_compat", "select member, cast((year(time) - 1970) * 4 + floor(((month(time) + 1) % 12) / 3) as integer) as bin, y, x, lat, lon, round(avg(value), 6) as value from cube group by all")
def _compat(s, d):
    return shown(C.reduced(cells(s, d), "ave", "t", group="season", compat=True).cells())


def _anomaly(name: str, axes: str, group: str | None, by: str) -> None:
    QUERIES[name] = lambda s, d: shown(C.anomaly(cells(s, d), axes, group).cells())
    SQL[name] = f"{CUBE_SQL} select member, t, y, x, time, lat, lon, round(value - avg(value) over (partition by {by}), 6) as value from cube"


_anomaly("anomaly_t", "t", None, "member, y, x")
_anomaly("anomaly_monthofyear", "t", "monthOfYear", "member, y, x, month(time)")
_anomaly("anomaly_seasonofyear", "t", "seasonOfYear", "member, y, x, floor((month(time) % 12) / 3)")
_anomaly("anomaly_year", "t", "year", "member, y, x, year(time)")
_anomaly("anomaly_spatial", "xy", None, "member, t")


@query("group_broadcast_back", "select member, t, y, x, round(value, 6) as value, round(max(value) over (partition by member, y, x, year(time)), 6) as peak from cube")
def _back(s, d):
    return shown(C.broadcast_back(cells(s, d), "max", "t", "peak", group="year").select("member", "t", "y", "x", "value", "peak"))


@query("normalize_cells", """select member, t, y, x, time, lat, lon, round(case when coalesce(stddev_samp(value) over w, 0) = 0 then case when value is not null then 0.0 end
  else (value - avg(value) over w) / stddev_samp(value) over w end, 6) as value from cube window w as (partition by member, y, x)""")
def _norm(s, d):
    return shown(C.rescaled(cells(s, d)).cells())


@query("zonal_mean_djf", "select member, y, lat, round(avg(value), 6) as value from cube where month(time) in (12, 1, 2) group by member, y, lat")
def _zonal(s, d):
    return shown(C.reduced(C.subset(cells(s, d), [Span("t", season="DJF")]), "ave", "tx").cells())


@query("diurnal_by_month", f"{_EVENTS} select member, cast(month(time) as integer) as month, cast(floor(hour(time) / 6) as integer) as part, round(avg(value), 5) as ave, count(value) as n from cube group by all", base=False)
def _diurnal(s, d):
    e = events(s, d)
    month, part = calendar_bin("monthOfYear", F.col("time")), F.floor(calendar_bin("hourOfDay", F.col("time")) / 6).cast("int")
    return shown(e.df.groupBy("member", month.alias("month"), part.alias("part")).agg(F.avg("value").alias("ave"), F.count("value").alias("n")), 5)


# broadcasting
@query("broadcast_diff_t", "+ m as (select member, y, x, avg(value) as v from cube group by all) select c.member, c.t, c.y, c.x, time, lat, lon, round(value - v, 6) as value from cube c join m on c.member = m.member and c.y = m.y and c.x = m.x")
def _bt(s, d):
    c = cells(s, d)
    return shown(C.combined("diff", [c, C.reduced(c, "ave", "t")]).cells())


@query("broadcast_diff_xy", "+ m as (select member, t, avg(value) as v from cube group by all) select c.member, c.t, c.y, c.x, time, lat, lon, round(v - value + 1e-9, 6) as value from cube c join m on c.member = m.member and c.t = m.t")
def _bxy(s, d):
    c = cells(s, d)
    return shown(C.combined("diff", [C.reduced(c, "ave", "xy"), c]).cells(), 6, 1e-9)


# along time
_LOW = """+ b as (select member, y, x, cast(floor(t / 6) as integer) as g, avg(value) as v, (min(t) + max(t) + 1) / 2.0 as m from cube group by all having count(value) > 0),
l as (select *, lead(m) over w as nm, lead(v) over w as nv, row_number() over w as k from b window w as (partition by member, y, x order by m)),
low as (select c.member, c.t, c.y, c.x, c.time, c.lat, c.lon, c.value as raw, case when l.m is null then f.v when l.nm is null then l.v else l.v + (l.nv - l.v) * (c.t + 0.5 - l.m) / (l.nm - l.m) end as value
  from cube c asof left join l on c.member = l.member and c.y = l.y and c.x = l.x and c.t + 0.5 >= l.m left join l f on c.member = f.member and c.y = f.y and c.x = f.x and f.k = 1)
"""


@query("lowpass_6month", f"{_LOW} select member, t, y, x, time, lat, lon, round(value + 1e-9, 5) as value from low")
def _low(s, d):
    return shown(C.lowpass(cells(s, d), 6).cells(), 5, 1e-9)


@query("highpass_6month", f"{_LOW} select member, t, y, x, time, lat, lon, round(raw - value + 1e-9, 5) as value from low")
def _high(s, d):
    return shown(C.highpass(cells(s, d), 6).cells(), 5, 1e-9)


@query("lowpass_month_of_daily", """with c as (select event_type as member, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as t, date_trunc('day', ts) as time, avg(value) as value from events group by all),
b as (select member, floor(date_diff('day', date '1970-01-01', cast(time as date)) / 5) as g, avg(value) as v, (epoch_ms(min(time)) + epoch_ms(max(time)) + 86400000) / 2.0 as m from c group by all),
l as (select *, lead(m) over w as nm, lead(v) over w as nv, row_number() over w as k from b window w as (partition by member order by m))
select c.member, c.t, c.time, round(case when l.m is null then f.v when l.nm is null then l.v else l.v + (l.nv - l.v) * (epoch_ms(c.time) + 43200000 - l.m) / (l.nm - l.m) end + 1e-9, 5) as value
from c asof left join l on c.member = l.member and epoch_ms(c.time) + 43200000 >= l.m left join l f on c.member = f.member and f.k = 1""", base=False)
def _low_daily(s, d):
    """Five-day bins of daily means, by the calendar and the middle of each day."""
    daily = events(s, d).df.groupBy("member", F.to_date("time").alias("day")).agg(F.avg("value").alias("value"))
    time = F.col("day").cast("timestamp_ntz")
    df = daily.select("member", F.datediff("day", F.lit("2024-01-01").cast("date")).alias("t"), time.alias("time"), (time + F.expr("interval 1 day")).alias("time_end"), "value")
    c = Cube(df, ("t",), ("member",), ("time", "time_end"))
    return shown(C.lowpass(c, "5-day").cells().select("member", "t", "time", "value"), 5, 1e-9)


@query("sliding_3_2", """+ s as (select member, t, y, x, row_number() over w as k, avg(value) over (partition by member, y, x order by t rows between current row and 2 following) as v from cube window w as (partition by member, y, x order by t))
select member, t, y, x, round(v, 6) as value from s where (k - 1) % 2 = 0""")
def _slide(s, d):
    return shown(C.sliding(cells(s, d), 3, 2).cells())


@query("asof_events", """select l.user_id, l.ts, l.event_id, r.value as last_view from (select * from events where event_type = 'purchase') l
asof left join (select user_id, ts, value from events where event_type = 'view') r on l.user_id = r.user_id and l.ts >= r.ts""", base=False)
def _asof(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_type", "event_id", "value")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return C.as_of(left, right, ["user_id"], "ts", "value", "last_view", F.to_date("ts"))


@query("asof_events_clamped", """with v as (select user_id, ts, value, row_number() over (partition by user_id order by ts, value) as k from events where event_type = 'view')
select l.user_id, l.ts, l.event_id, coalesce(r.value, f.value) as last_view from (select * from events where event_type = 'purchase') l
asof left join v r on l.user_id = r.user_id and l.ts >= r.ts left join v f on f.user_id = l.user_id and f.k = 1""", base=False)
def _asof_clamped(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_type", "event_id", "value")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return C.as_of(left, right, ["user_id"], "ts", "value", "last_view", F.to_date("ts"), clamp=True)


@query("time_convert_linear", """+ m as (select member, t, avg(value) as v from cube group by all), p as (select * from m where t % 3 = 0 and v is not null),
l as (select m.member, m.t, p.t as pt, p.v as pv from m asof left join p on m.member = p.member and m.t >= p.t),
r as (select m.member, m.t, p.t as qt, p.v as qv from m asof left join p on m.member = p.member and m.t <= p.t)
select l.member, cast(l.t as double) as t, round(case when pt is null then qv when qt is null or pt = qt then pv else pv + (qv - pv) * (l.t - pt) / (qt - pt) end + 1e-9, 5) as value from l join r on l.member = r.member and l.t = r.t""")
def _convert(s, d):
    means = C.reduced(cells(s, d), "ave", "xy").df.select("member", "t", "value")
    return shown(C.converted(means.where("t % 3 = 0"), means.select("member", "t"), ["member"], "t", "value"), 5, 1e-9)


@query("append_time", "select member, t, y, x, time, lat, lon, round(value, 6) as value from cube where t < 40 union all select member, cast(t as integer), y, x, time, lat, lon, round(value, 6) as value from cube where t >= 40")
def _append(s, d):
    c = cells(s, d)
    late = replace(c, df=c.df.where("t >= 40").withColumn("t", F.col("t") - 40))
    return shown(C.appended([replace(c, df=c.df.where("t < 40")), late], [40]).cells())


# arrays of cells
def _scalar(op: str, number: float, sql: str) -> None:
    query(f"scalar_{op}", f"select member, t, y, x, time, lat, lon, round({sql}, 6) as value from cube")(lambda s, d: shown(C.with_scalar(cells(s, d), op, number).cells()))


for _op, _n, _s in (("sum", 2.5, "value + 2.5"), ("diff", 2.5, "value - 2.5"), ("mult", 3, "value * 3"), ("div", 4, "value / 4"), ("min", 20, "case when value is not null then least(value, 20) end"), ("max", 20, "case when value is not null then greatest(value, 20) end"), ("const", 7, "case when value is not null then 7.0 end")):
    _scalar(_op, _n, _s)


@query("map_values", "select member, t, y, x, time, lat, lon, round(sqrt(value), 6) as value from cube")
def _map(s, d):
    return shown(C.mapped(cells(s, d), F.sqrt).cells())


@query("split_time", "select member, cast(t - 40 as integer) as t, y, x, time, lat, lon, round(value, 6) as value from cube where t >= 40")
def _split(s, d):
    return shown(C.split(cells(s, d), "t", 40)[1].cells())


@query("spawn_grid", "select cast(y as integer) as y, cast(x as integer) as x, cast(y * 10 + x as double) as value from range(6) a(y), range(4) b(x)", base=False)
def _spawn(s, d):
    return C.spawned(s, {"y": 6, "x": 4}, lambda a: a["y"] * 10 + a["x"]).cells()


@query("sample_cells", "select member, t, y, x, time, lat, lon, round(value, 6) as value from cube order by member, t, y, x offset 5 limit 20")
def _sample(s, d):
    return shown(C.sample(cells(s, d), 20, 5))


@query("sorted_values", "select member, t, y, x, time, lat, lon, round(value, 6) as value from cube")
def _sorted(s, d):
    return shown(C.sorted_values(cells(s, d)))


@query("bin_reduce", "select member, y, x, lat, lon, cast(t % 5 as integer) as bin, round(sum(value * (t + 1)), 5) as value, cast(sum(case when value is not null then t + 1 end) as double) as weight from cube group by all")
def _bin_reduce(s, d):
    return shown(C.bin_reduced(cells(s, d), "sum", "t", (F.col("t") % 5).cast("int"), (F.col("t") + 1).cast("double")).cells(), 5)


@query("bin_merge", "+ m as (select member, y, x, t % 5 as bin, max(value) as v from cube group by all) select c.member, c.t, c.y, c.x, time, lat, lon, round(c.value - v, 6) as value from cube c join m on c.member = m.member and c.y = m.y and c.x = m.x and c.t % 5 = m.bin")
def _bin_merge(s, d):
    c, by = cells(s, d), (F.col("t") % 5).cast("int")
    return shown(C.bin_merged(c, C.bin_reduced(c, "max", "t", by), "diff", by).cells())


@query("scaled_difference", "select round(avg(c.value), 6) as mean, round(max(abs(c.value - r.value)) / avg(c.value), 6) as max_scaled_diff from cube c join cube r on c.t = r.t and c.y = r.y and c.x = r.x where c.member = 'A' and r.member = 'R'")
def _scaled_difference(s, d):
    c = cells(s, d)
    return shown(C.scaled_difference(C.member(c, "A"), C.member(c, "R")))


@query("zip_merge", """with l as (select event_id, value, row_number() over (order by event_id) as k from events where event_type = 'purchase'), r as (select event_id, value, row_number() over (order by event_id) as k from events where event_type = 'click')
select l.event_id, l.value, r.event_id as right_event_id, r.value as right_value from l join r on l.k = r.k""", base=False)
def _zip(s, d):
    e = table(s, d, "events").select("event_id", "value", "event_type")
    part = lambda kind: e.where(F.col("event_type") == kind).select("event_id", "value")
    return C.zipped(part("purchase"), part("click"), "event_id", width=10_000)


@query("apply_mask", "select member, t, y, x, time, lat, lon, round(case when n_regionkey in (1, 3) then value end, 6) as value from cube left join nation on y = n_nationkey")
def _apply(s, d):
    mask = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("y"), F.col("n_regionkey").isin(1, 3).cast("int").alias("mask"))
    return shown(C.applied_mask(cells(s, d), mask, ["y"]).cells())


# records
def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cdrecords")


@query("record_elements", """select record_id, array_to_string(list_sort([case when k = 'tas-2m' then 'air' else k end for k in map_keys(elements) if starts_with(k, 't') or starts_with(k, 'p')]), ' ') as names from cdrecords""", base=False)
def _elements(s, d):
    kept = R.elements_renamed(R.elements_where(F.col("elements"), lambda k: F.substring(k, 1, 1).isin("t", "p")), {"tas-2m": "air"})
    return _records(s, d).select("record_id", F.array_join(F.array_sort(F.map_keys(kept)), " ").alias("names"))


@query("record_merge", """select record_id, len([k for k in map_keys(elements) if not starts_with(k, 't')]) + len([k for k in map_keys(elements) if starts_with(k, 't')]) as n from cdrecords""", base=False)
def _merge(s, d):
    e = F.col("elements")
    both = R.elements_merged(R.elements_without(e, "none"), R.elements_where(e, lambda k: F.startswith(k, F.lit("t"))))
    return _records(s, d).select("record_id", F.size(both).cast("bigint").alias("n"))


@query("record_shapes", """with e as (select record_id, unnest(map_entries(elements)) as en from cdrecords)
select record_id, array_to_string([cast(x as varchar) for x in en.value.shape], 'x') as shape, string_agg(en.key, ' ' order by en.key) as names from e group by 1, 2""", base=False)
def _shapes(s, d):
    return _records(s, d).select("record_id", F.explode(R.by_shape(F.col("elements"))).alias("shape", "k")).select("record_id", "shape", F.array_join("k", " ").alias("names"))


@query("record_arrays", """with e as (select record_id, unnest(map_entries(elements)) as en from cdrecords),
v as (select record_id, en.key as element_key, [case when not isnan(x) and (en.value.missing is null or isnan(en.value.missing) or x <> en.value.missing) then cast(x as double) end for x in en.value.data] as a from e)
select record_id, element_key, round(list_sum([x * 2 for x in a if x is not null and not isinf(x)]), 3) as doubled, len([x for x in a if x is not null]) as n, round(list_max([x for x in a if not isinf(x)]), 3) as top from v""", base=False)
def _arrays(s, d):
    e = _records(s, d).select("record_id", F.explode("elements").alias("element_key", "spec"))
    finite = F.filter("a", lambda x: x.isNotNull() & (F.abs(x) != float("inf")))
    return e.select("record_id", "element_key", R.valid(F.col("spec")).alias("a")).select("record_id", "element_key", F.round(R.array_reduced("sum", R.array_with("mult", finite, 2.0)), 3).alias("doubled"), R.array_reduced("count", F.col("a")).cast("bigint").alias("n"), F.round(R.array_reduced("max", finite), 3).alias("top"))


@query("section_algebra", """with e as (select record_id, unnest(map_entries(elements)) as en from cdrecords), b as (select record_id, en.key as element_key, en.value.origin as o, en.value.shape as s from e where len(en.value.shape) = 3),
x as (select *, [greatest(o[1], 0), greatest(o[2], 10), greatest(o[3], 60)] as lo, [least(o[1] + s[1], 90), least(o[2] + s[2], 70), least(o[3] + s[3], 160)] as hi, [least(o[1], 0), least(o[2], 10), least(o[3], 60)] as ulo, [greatest(o[1] + s[1], 90), greatest(o[2] + s[2], 70), greatest(o[3] + s[3], 160)] as uhi from b)
select record_id, element_key, case when hi[1] > lo[1] and hi[2] > lo[2] and hi[3] > lo[3] then (hi[1] - lo[1]) * (hi[2] - lo[2]) * (hi[3] - lo[3]) + 0.0::double end as common, (uhi[1] - ulo[1]) * (uhi[2] - ulo[2]) * (uhi[3] - ulo[3]) as around from x""", base=False)
def _sections(s, d):
    e = _records(s, d).select("record_id", F.explode("elements").alias("element_key", "spec")).where(F.size("spec.shape") == 3)
    box = (F.array(F.lit(0), F.lit(10), F.lit(60)), F.array(F.lit(90), F.lit(60), F.lit(100)))
    size = lambda c: F.when(c.isNotNull(), F.aggregate(c["shape"], F.lit(1), lambda a, n: a * n))
    own = (F.col("spec.origin"), F.col("spec.shape"))
    return e.select("record_id", "element_key", size(R.section_intersection(*own, *box)).cast("double").alias("common"), size(R.section_union(*own, *box)).alias("around"))


@query("time_range_algebra", """select interval_id, case when not (end_time < 1400000000000 or 1420000000000 < start_time) then greatest(start_time, 1400000000000) end as common_start, case when not (end_time < 1400000000000 or 1420000000000 < start_time) then greatest(end_time, 1420000000000) end as merged_end,
  (end_time < 1400000000000 or 1420000000000 < start_time) as apart, cast(case when 1410000000000 < start_time then -1 when 1410000000000 >= end_time and end_time > start_time then 1 else 0 end as integer) as place from time_intervals where start_time is not null and end_time is not null""", base=False)
def _ranges(s, d):
    a, b = (F.col("start_time"), F.col("end_time")), (F.lit(1_400_000_000_000), F.lit(1_420_000_000_000))
    df = table(s, d, "time_intervals").where("start_time is not null and end_time is not null")
    return df.select("interval_id", R.range_intersection(*a, *b)["start"].alias("common_start"), R.range_merge(*a, *b)["end"].alias("merged_end"), R.ranges_disjoint(*a, *b).alias("apart"), R.range_place(*a, 1_410_000_000_000).alias("place"))


@query("metadata_merge", """with m as (select record_id, unnest(map_entries(metadata)) as en from cdrecords)
select record_id, en.key as name, case when en.key = 'units.ps' and en.value <> 'kPa' then 'diff(' || en.value || ',kPa)' else en.value end as merged from m""", base=False)
def _metadata(s, d):
    other = F.create_map(F.lit("units.ps"), F.lit("kPa"), F.lit("none"), F.lit("x"))
    return _records(s, d).select("record_id", F.explode(R.metadata_merged("diff", F.col("metadata"), other)).alias("name", "merged"))


@query("find_value", """with e as (select record_id, unnest(map_entries(elements)) as en from cdrecords) select record_id, en.key as element_key, cast(coalesce(list_position([coalesce(abs(x - 1000.0) < 0.1, false) for x in en.value.data], true), 0) - 1 as integer) as at from e""", base=False)
def _find(s, d):
    e = _records(s, d).select("record_id", F.explode("elements").alias("element_key", "spec"))
    return e.select("record_id", "element_key", R.found_value(F.transform("spec.data", lambda x: x.cast("double")), 1000.0).alias("at"))


# grids
@query("regrid_uniform_bilinear", """+ f as (select member, y, x, avg(value) as v from cube group by all),
ty as (select cast(i as integer) as y, -80.0 + i * 14.0 as lat, floor((-80.0 + i * 14.0 + 86.4) / 7.2) as j, (-80.0 + i * 14.0 + 86.4) / 7.2 - floor((-80.0 + i * 14.0 + 86.4) / 7.2) as fy from range(12) as r(i)),
tx as (select cast(i as integer) as x, i * 45.0 as lon, floor(i * 45.0 / 90) as j, i * 45.0 / 90 - floor(i * 45.0 / 90) as fx from range(8) as r(i)),
wy as (select y, lat, j as sy, 1 - fy as w from ty union all select y, lat, j + 1, fy from ty), wx as (select x, lon, j as sx, 1 - fx as w from tx union all select x, lon, (j + 1) % 4, fx from tx)
select member, wy.y, cast(lat as double) as lat, wx.x, cast(lon as double) as lon, round(sum(wy.w * wx.w * v) / sum(wy.w * wx.w), 5) as value from f join wy on f.y = sy join wx on f.x = sx where v is not null and wy.w > 0 and wx.w > 0 group by all""")
def _regrid(s, d):
    c = C.reduced(cells(s, d), "ave", "t")
    return shown(regridded(c, LATS, LONS, uniform_axis(-80.0, 14.0, 12), uniform_axis(0.0, 45.0, 8)).df.select("member", "y", "lat", "x", "lon", "value"), 5)


#: Bilinear interpolation of the mean over time, with the target axes left open.
_GRID_SQL = """+ f as (select member, y, x, avg(value) as v from cube group by all), ty as (select y, lat, floor((lat + 86.4) / 7.2) as j, (lat + 86.4) / 7.2 - floor((lat + 86.4) / 7.2) as fy from ({lats})), tx as (select x, lon, floor(lon / 90) as j, lon / 90 - floor(lon / 90) as fx from ({lons})),
wy as (select y, lat, j as sy, 1 - fy as w from ty union all select y, lat, j + 1, fy from ty), wx as (select x, lon, j as sx, 1 - fx as w from tx union all select x, lon, (j + 1) % 4, fx from tx)
select member, wy.y, cast(lat as double) as lat, wx.x, cast(lon as double) as lon, round(sum(wy.w * wx.w * v) / sum(wy.w * wx.w), 5) as value from f join wy on f.y = sy join wx on f.x = sx where v is not null and wy.w > 1e-12 and wx.w > 1e-12 group by all"""
#: The northern Gaussian latitudes of 16, in degrees.
_GAUSS = [5.452039830190821, 16.355932964839738, 27.25920765080937, 38.16121191140983, 49.06071863417398, 59.9548586431818, 70.83463975032743, 81.65059075030348]


@query("regrid_gaussian", _GRID_SQL.format(lats="select cast(row_number() over (order by lat) - 1 as integer) as y, lat from (values " + ", ".join(f"({v}), (-{v})" for v in _GAUSS) + ") r(lat)", lons="select cast(i as integer) as x, i * 45.0 as lon from range(8) r(i)"))
def _gauss(s, d):
    c = C.reduced(cells(s, d), "ave", "t")
    return shown(regridded(c, LATS, LONS, gaussian_axis(16), uniform_axis(0.0, 45.0, 8)).df.select("member", "y", "lat", "x", "lon", "value"), 5)


# vectors
@query("rescale_embeddings", """with c as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings)
select vec_id, cast(pos as integer) as pos, round((v - avg(v) over (partition by pos)) / stddev_samp(v) over (partition by pos), 4) as value from c""", base=False)
def _rescale(s, d):
    return shown(rescaled_vectors(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding"), 4)


@query("row_matrix", "select member, t, array_to_string([coalesce(cast(round(x, 3) as varchar), 'none') for x in list(value order by y, x)], ' ') as cells from cube group by member, t")
def _rows(s, d):
    """Each month of each member as one vector of its cells."""
    c = cells(s, d)
    vec = row_vectors(c.df.withColumn("row", F.struct("member", "t")), "row", ["y", "x"], "value")
    text = F.transform("vec", lambda v: F.coalesce(F.round(v, 3).cast("string"), F.lit("none")))
    return vec.select("row.member", "row.t", F.array_join(text, " ").alias("cells"))


def _zonal_eof(s: SparkSession, d: str, scale: bool = False) -> Eof:
    """The EOFs of the nations' monthly means, over the months in which every nation of the data has a value; incomplete months are left out."""
    means = C.reduced(cells(s, d), "ave", "x").df.groupBy("t", "y").agg(F.avg("value").alias("value"))
    return Eof.fit(_complete(means), "t", ["y"], "value", modes=5, scale=scale)


def _complete(means: DataFrame) -> DataFrame:
    """The steps ``t`` of ``means`` in which each ``y`` that has a value anywhere has one."""
    known = means.where("value is not null")
    all_ = known.agg(F.count_distinct("y").alias("all"))
    whole = known.groupBy("t").agg(F.count_distinct("y").alias("n")).crossJoin(F.broadcast(all_)).where(F.col("n") == F.col("all")).select("t")
    return means.join(whole, "t", "left_semi")


def _eof_sql(field: str, scale: bool, modes: int, tail: str) -> str:
    """SQL of ``modes`` EOFs of the table ``field`` (t, y, v): eigenvectors by squaring the covariance matrix again and again, one mode after the other. ``tail`` reads ``z`` (t, y, v, mu, f, z), ``modes`` (mode, eigenvalue, v as a list along y), ``names`` (y, k) and ``pcs`` (t, mode, pc)."""
    steps = f"""{field},
st as (select y, avg(v) as mu, {"coalesce(1 / nullif(stddev_samp(v), 0), 0)" if scale else "1.0"} as f from field group by y), z as (select t, field.y, v, mu, f, (v - mu) * f as z from field join st on field.y = st.y),
names as (select y, row_number() over (order by y) as k from st), zz as (select y, list(z order by t) as zl from z group by y),
c0 as (select list(r order by y) as m from (select a.y, list(list_dot_product(a.zl, b.zl) / (len(a.zl) - 1) order by b.y) as r from zz a cross join zz b group by a.y))"""
    for k in range(modes):
        steps += f""",
p{k}(i, m) as (select 0, m from c{k} union all select i + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / s)) from (select i, q, list_max(list_transform(q, lambda r: list_max(list_transform(r, lambda x: abs(x))))) as s
  from (select i, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) as q from p{k} where i < 24)) where s > 0),
w{k} as (select r, list_max(list_transform(r, lambda x: abs(x))) as big, sqrt(list_dot_product(r, r)) as n from (select unnest(m) as r from p{k} where i = 24) order by n desc limit 1),
v{k} as (select list_transform(r, lambda x: case when list_max(r) >= big then x / n else -x / n end) as v from w{k}),
l{k} as (select v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) as l from v{k}, c{k}),
c{k + 1} as (select list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) as m from l{k}, c{k})"""
    both = " union all ".join(f"select {k} as mode, l as eigenvalue, v from l{k}" for k in range(modes))
    return f"""{steps},
modes as ({both}), total as (select sum(var_) as total from (select var_samp(z) as var_ from z group by y)),
pcs as (select t, mode, sum(z * modes.v[k]) as pc from z join names on z.y = names.y cross join modes group by t, mode)
{tail}"""


_NATIONS = """, xm as (select member, t, y, avg(value) as v from cube group by all), tm as (select t, y, avg(v) as v from xm group by all having avg(v) is not null), field as (select * from tm where t in (select t from tm group by t having count(*) = (select count(distinct y) from tm)))"""


def _eof_query(name: str, scale: bool, tail: str):
    """A query of the EOFs of the nations' monthly means, with its SQL."""
    return query(name, CUBE_SQL.replace("with cube", "with recursive cube", 1) + _eof_sql(_NATIONS, scale, 5, tail), base=False)


@_eof_query("svd_cells", True, "select y, cast(mode as integer) as mode, round(v[k], 6) as eof from modes cross join names")
def _svd(s, d):
    return shown(_zonal_eof(s, d, True).maps())


@_eof_query("svd_components", True, "select t, cast(mode as integer) as mode, round(pc, 6) as pc from pcs")
def _svd_pc(s, d):
    return shown(_zonal_eof(s, d, True).components())


@_eof_query("eof_variance_fraction", False, "select cast(mode as integer) as mode, round(eigenvalue, 6) as eigenvalue, round(eigenvalue / total, 6) as fraction, round(eigenvalue * sqrt(2.0 / (select count(distinct t) from field)), 6) as typical_error from modes, total")
def _eof_var(s, d):
    e = _zonal_eof(s, d)
    rows = zip(e.values.tolist(), e.variance_fractions().tolist(), e.north_test().tolist())
    return shown(s.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "mode int, eigenvalue double, fraction double, typical_error double"))


@_eof_query("eof_reconstruct", False, "select z.t, z.y, round(max(mu) + sum(pc * modes.v[k]), 6) as value from z join names on z.y = names.y join pcs on pcs.t = z.t join modes on modes.mode = pcs.mode where modes.mode < 3 group by z.t, z.y")
def _eof_back(s, d):
    return shown(_zonal_eof(s, d).reconstructed(3))


@_eof_query("eof_correlation", False, "select y, cast(mode as integer) as mode, round(corr(pc, z.v), 6) as r from z join pcs on pcs.t = z.t group by y, mode")
def _eof_corr(s, d):
    return shown(_zonal_eof(s, d).related("correlation"))


@_eof_query("eof_covariance", False, "select y, cast(pcs.mode as integer) as mode, round(covar_samp(pc / sqrt(eigenvalue), z.v), 6) as r from z join pcs on pcs.t = z.t join modes on modes.mode = pcs.mode group by y, pcs.mode")
def _eof_cov(s, d):
    return shown(_zonal_eof(s, d).related("covariance"))


# requests, collections, user functions, streams
@query("workflow_request_anomaly", """+ s as (select * from cube where y between 5 and 10 and x between 1 and 2), m as (select member, y, x, avg(value) as v from s group by all)
select s.member, s.t, s.y, s.x, time, lat, lon, round(value - v, 6) as value from s join m on s.member = m.member and s.y = m.y and s.x = m.x""")
def _workflow(s, d):
    text = """[domain=[{"name":"d0","lat":{"start":5,"end":10,"system":"indices"},"lon":{"start":1,"end":2,"system":"indices"}}],
      variable=[{"uri":"collection:/lines","name":"q:v1","domain":"d0"}],
      operation=[{"name":"Cube.ave","input":"v1","axes":"t","id":"v1ave"},{"name":"Cube.eDiff","input":"v1,v1ave","id":"out"}]]"""
    return shown(execute(text, lambda collection, name: cells(s, d))["out"])


@query("workflow_request_cosine", f"select member, round({_COS}, 6) as value from cube where time >= timestamp '1996-01-01' and time < timestamp '1998-01-01' group by member")
def _cosine(s, d):
    text = '[domain=[{name:"d1",time:{start:"1996-01-01",end:"1998-01-01",crs:"timestamps"}}],variable=[{uri:"collection:/lines",name:"q:v1",domain:"d1"}],operation=[{name:"Cube.ave",input:"v1",axes:"txy",weights:"cosine"}]]'
    return shown(next(iter(execute(text, lambda collection, name: cells(s, d)).values())))


#: The kernels that a request can name, with title, inputs and visibility.
_KERNELS = [
    ("cube.anomaly", "Departure from the mean or from the calendar bin's mean", "1+", "public"), ("cube.ave", "Mean, optionally weighted", "1+", "public"), ("cube.compress", "Keep the listed levels", "1+", "public"), ("cube.const", "Each value that isn't missing set to a number", "1+", "public"),
    ("cube.cor", "Correlation of each pair of inputs or members", "1+", "developmental"), ("cube.count", "Number of values", "1+", "public"), ("cube.eave", "Mean over inputs, cell by cell", "2+", "public"), ("cube.ediff", "Cell by cell diff", "2+", "public"), ("cube.ediv", "Cell by cell div", "2+", "public"),
    ("cube.emax", "Cell by cell max", "2+", "public"), ("cube.emin", "Cell by cell min", "2+", "public"), ("cube.emult", "Cell by cell mult", "2+", "public"), ("cube.ensemblestats", "Mean and deviation over inputs on the grid of one of them", "2+", "developmental"), ("cube.esum", "Cell by cell sum", "2+", "public"),
    ("cube.filter", "Keep the listed levels", "1+", "public"), ("cube.highpass", "Departure from the lowpass", "1+", "public"), ("cube.lowpass", "Means of calendar bins joined by lines", "1+", "public"), ("cube.max", "Maximum", "1+", "public"), ("cube.maxmag", "Value of greatest magnitude", "1+", "public"),
    ("cube.min", "Minimum", "1+", "public"), ("cube.minmag", "Value of least magnitude", "1+", "public"), ("cube.noop", "Subset to the domain", "1+", "public"), ("cube.norm", "Standard scores per cell", "1+", "developmental"), ("cube.ptp", "Range", "1+", "public"),
    ("cube.regrid", "Interpolation onto another grid", "1+", "public"), ("cube.rescale", "Standard scores per cell", "1+", "restricted"), ("cube.rms", "Root mean square over n-1", "1+", "public"), ("cube.rmsum", "Root of the sum over n-1", "1+", "developmental"), ("cube.sdiff", "Each value and a number: diff", "1+", "public"),
    ("cube.sdiv", "Each value and a number: div", "1+", "public"), ("cube.smax", "Each value and a number: max", "1+", "public"), ("cube.smin", "Each value and a number: min", "1+", "public"), ("cube.smult", "Each value and a number: mult", "1+", "public"), ("cube.ssum", "Each value and a number: sum", "1+", "public"),
    ("cube.std", "Population deviation", "1+", "public"), ("cube.stddev", "Sample deviation", "1+", "public"), ("cube.subset", "Subset to the domain", "1+", "public"), ("cube.sum", "Sum", "1+", "public"), ("cube.svd", "Leading modes of variation of the records", "1+", "restricted"),
    ("cube.var", "Population variance", "1+", "public"), ("cube.write", "Write the input as a collection and pass it on", "1+", "restricted"), ("cube.zademo", "Zonal mean of a season's climate", "1+", "public"),
]


@query("kernel_capabilities", "select * from (values " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in _KERNELS) + ") as k(name, title, inputs, visibility)", base=False)
def _capabilities(s, d):
    own = [row for row in capabilities() if row[0].startswith("cube.")]
    return s.createDataFrame(own, "name string, title string, inputs string, visibility string")


def _asked(s: SparkSession, d: str, text: str, load: Callable[[str, str], Cube] | None = None, **settings) -> DataFrame:
    """The first result of a request; without ``load`` every collection is the cube of the lines."""
    return shown(next(iter(execute(text, load or (lambda collection, name: cells(s, d)), **settings).values())))


def _members(s: SparkSession, d: str) -> Callable[[str, str], Cube]:
    """Collections called by the members of the cube."""
    return lambda collection, name: C.member(cells(s, d), collection.upper())


@query("workflow_groupby_anomaly", "select member, t, y, x, time, lat, lon, round(value - avg(value) over (partition by member, y, x, month(time)), 6) as value from cube where lat between -20 and 40")
def _groupby_anomaly(s, d):
    return _asked(s, d, """[domain=[{"name":"d0","lat":{"start":-20,"end":40,"system":"values"}}],variable=[{"uri":"collection:/lines","name":"q:v1"}],
      operation=[{"name":"Cube.ave","input":"v1","domain":"d0","groupBy":"monthofyear","axes":"t","id":"v1ave"},{"name":"Cube.eDiff","input":"v1,v1ave","domain":"d0"}]]""")


@query("workflow_seasonal_anomaly", "select member, t, y, x, time, lat, lon, round(value - avg(value) over (partition by member, y, x, floor((month(time) % 12) / 3)), 6) as value from cube")
def _seasonal_anomaly(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.anomaly","input":"v1","groupBy":"seasonOfYear","axes":"t"}]]')


@query("workflow_two_variables", "select case member when 'A' then 'v1' else 'v2' end as input, y, x, lat, lon, round(max(value), 6) as value from cube where member in ('A', 'R') group by all")
def _two(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/a","name":"q:v1"},{"uri":"collection:/r","name":"q:v2"}],operation=[{"name":"Cube.max","input":"v1,v2","axes":"t"}]]', _members(s, d))


@query("workflow_time_scalar", f"select {_CELL} from cube where time = timestamp '1996-03-01' and lon = 180")
def _time_scalar(s, d):
    return _asked(s, d, '[domain=[{"name":"d0","time":"1996-03-20","lon":100}],variable=[{"uri":"collection:/lines","name":"q:v1","domain":"d0"}]]')


@query("workflow_highpass", f"{_LOW} select member, t, y, x, time, lat, lon, round(raw - value + 1e-9, 4) as value from low".replace("floor(t / 6)", "floor(((year(time) - 1970) * 12 + month(time)) / 6)").replace("(min(t) + max(t) + 1) / 2.0", "(epoch_ms(min(time)) + epoch_ms(max(time))) / 2.0").replace("c.t + 0.5", "epoch_ms(c.time)"))
def _workflow_highpass(s, d):
    out = execute('[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.highpass","input":"v1","groupBy":"6-month","id":"high"}]]', lambda collection, name: cells(s, d))
    return shown(out["high"], 4, 1e-9)


@query("workflow_mask", f"select {_CELL} from cube where lon < 200 and lat >= -60 and lat < 40")
def _workflow_mask(s, d):
    return _asked(s, d, '[domain=[{"name":"d0","mask":"#box"}],variable=[{"uri":"collection:/lines","name":"q:v1","domain":"d0"}]]', masks={"box": [[(-10, -60), (200, -60), (200, 40), (-10, 40)]]})


@query("workflow_levels", f"select {_CELL.replace('lat,', 'lat, lev,').replace('y, x', 'z, y, x')} from (select *, cast(x as integer) as z, lon as lev from cube) where lev in (90, 270)")
def _workflow_levels(s, d):
    def load(collection, name):
        c = cells(s, d)
        return replace(c, df=c.df.withColumns({"z": F.col("x"), "lev": F.col("lon")}), axes=("t", "z", "y", "x"), coords=("time", "lat", "lev", "lon"))

    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.compress","input":"v1","plev":"90,270"}]]', load)


@query("workflow_svd", "with recursive " + _eof_sql("field as (select date_diff('day', date '1970-01-01', cast(ts as date)) as t, event_type as y, avg(value) as v from events group by all)", True, 2, "select y as member, cast(mode as integer) as mode, round(v[k], 5) as eof from modes cross join names"), base=False)
def _workflow_svd(s, d):
    """The two leading patterns of the daily means of all event types, standardised."""
    text = '[variable=[{"uri":"collection:/events","name":"value:v1"}],operation=[{"name":"Cube.ave","input":"v1","axes":"tx","groupBy":"day","id":"daily"},{"name":"ML.svd","input":"daily","modes":"2","id":"svd"}]]'
    return shown(execute(text, lambda collection, name: events(s, d))["svd.maps"], 5)


@query("eof_from_field", "select mode, 1.0::double as spread from range(3) r(mode)", base=False)
def _spread(s, d):
    """Components divided by the roots of their eigenvalues have a deviation of 1, those of projected records too."""
    e = _zonal_eof(s, d)
    again = e.components(e.field.select(e.row, *e.cells, "value"), scaling=1)
    return shown(again.where("mode < 3").groupBy(F.col("mode").cast("bigint").alias("mode")).agg(F.stddev_samp("pc").alias("spread")))


@query("workflow_cor", """select p.member as a, q.member as b, round(corr(p.value, q.value), 6) as corr, count(*) as n from (select * replace ('v' || case member when 'A' then 1 else 2 end as member) from cube where member in ('A', 'R')) p
join (select * replace ('v' || case member when 'A' then 1 else 2 end as member) from cube where member in ('A', 'R')) q on p.t = q.t and p.y = q.y and p.x = q.x where p.member < q.member and p.value is not null and q.value is not null group by p.member, q.member""")
def _workflow_cor(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/a","name":"q:v1"},{"uri":"collection:/r","name":"q:v2"}],operation=[{"name":"Cube.cor","input":"v1,v2"}]]', _members(s, d))


@query("workflow_ensemble_stats", "select t, y, x, round(avg(value), 6) as value from cube where x in (1, 2) group by t, y, x")
def _workflow_stats(s, d):
    return _asked(s, d, """[domain=[{"name":"d0","lon":{"start":80,"end":200,"system":"values"}}],variable=[{"uri":"collection:/a","name":"q:v1","domain":"d0"},{"uri":"collection:/n","name":"q:v2","domain":"d0"},{"uri":"collection:/r","name":"q:v3","domain":"d0"}],
      operation=[{"name":"ext.ensembleStats","input":"v1,v2,v3","target":"v1"}]]""", _members(s, d))


@query("workflow_zonal_demo", "select member, y, lat, round(avg(value), 6) as value from cube where month(time) in (6, 7, 8) group by member, y, lat")
def _workflow_zonal(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"ext.zaDemo","input":"v1","season":"JJA"}]]')


@query("workflow_write_kernel", "select member, y, x, lat, lon, cast(year(time) as integer) as bin, round(max(value), 6) as value from cube where year(time) between 1996 and 1998 group by all")
def _write_kernel(s, d):
    """The write kernel, in a folder for each year, and a request over some of the folders."""
    catalog = Catalog(shared_folder(s))
    execute('[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.write","input":"v1","groupBy":"year","collection":"byyear"}]]', lambda collection, name: cells(s, d), catalog)
    kept = catalog.load(s, "byyear")
    years = replace(kept, df=kept.df.where(F.col("bin").between(1996, 1998)))
    return _asked(s, d, '[variable=[{"uri":"collection:/byyear","name":"*:v1"}],operation=[{"name":"Cube.max","input":"v1","axes":"t"}]]', lambda collection, name: years)


@query("workflow_write_collection", "select member, bin, y, x, lat, lon, round(min(value), 6) as value from (select *, cast(year(time) as integer) as bin from cube) group by all")
def _workflow_write(s, d):
    catalog = Catalog(shared_folder(s))
    execute('[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.min","input":"v1","axes":"t","groupBy":"year","id":"low"}]]', lambda collection, name: cells(s, d), catalog, run={"responseForm": "collection:yearly"})
    return _asked(s, d, '[variable=[{"uri":"collection:/yearly","name":"*:v1"}]]', lambda collection, name: catalog.load(s, collection))


@query("workflow_regrid_uniform", _GRID_SQL.format(lats="select cast(i as integer) as y, -84.0 + i * 14 as lat from range(12) r(i)", lons="select cast(i as integer) as x, i * 45.0 as lon from range(8) r(i)"))
def _workflow_regrid(s, d):
    """The mean over time on a uniform grid that its settings put before the reduction."""
    text = '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.ave","input":"v1","axes":"t","id":"m"},{"name":"Cube.noOp","input":"m","grid":"uniform","shape":"12,8","res":"14,45","origin":"-84,0"}]]'
    return shown(execute(text, lambda collection, name: cells(s, d))["op1"].select("member", "y", "lat", "x", "lon", "value"), 5)


@query("workflow_regrid_to_input", _GRID_SQL.format(lats="select cast(i as integer) as y, -70.0 + i * 20 as lat from range(8) r(i)", lons="select cast(i as integer) as x, i * 60.0 as lon from range(6) r(i)"))
def _workflow_regrid_to(s, d):
    """The mean over time on the grid of another input."""
    def load(collection, name):
        c = C.reduced(cells(s, d), "ave", "t")
        return regridded(c, LATS, LONS, uniform_axis(-70.0, 20.0, 8), uniform_axis(0.0, 60.0, 6)) if collection == "coarse" else c

    text = '[variable=[{"uri":"collection:/lines","name":"q:v1"},{"uri":"collection:/coarse","name":"q:v2"}],operation=[{"name":"Cube.noOp","input":"v1","crs":"~v2"}]]'
    return shown(next(iter(execute(text, load).values())).select("member", "y", "lat", "x", "lon", "value"), 5)


@query("workflow_regrid_to_table", _GRID_SQL.format(lats="select cast(i as integer) as y, -60.0 + i * 24 as lat from range(6) r(i)", lons="select cast(i as integer) as x, i * 72.0 as lon from range(5) r(i)"))
def _workflow_regrid_table(s, d):
    """The mean over time on a grid whose axes a catalogue holds."""
    c = C.reduced(cells(s, d), "ave", "t")
    path = Catalog(shared_folder(s)).save_grid("coarse", regridded(c, LATS, LONS, uniform_axis(-60.0, 24.0, 6), uniform_axis(0.0, 72.0, 5)))
    text = '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.regrid","input":"v1","gridSpec":"' + path + '"}]]'
    return shown(next(iter(execute(text, lambda collection, name: c).values())).select("member", "y", "lat", "x", "lon", "value"), 5)


@query("workflow_const", "select member, t, y, x, time, lat, lon, case when value is not null then 3.5 end as value from cube")
def _workflow_const(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Cube.const","input":"v1","value":3.5}]]')


@query("axis_bounds", "select 'y' as axis, cast(i as integer) as index, round(i * 7.2 - 86.4, 6)::double as value, round(greatest(i * 7.2 - 90.0, -90), 6)::double as lo, round(least(i * 7.2 - 82.8, 90), 6)::double as hi from range(25) r(i)", base=False)
def _bounds(s, d):
    return shown(axis_table(cells(s, d), "y"))


@query("collection_roundtrip", "select member, bin, y, x, lat, lon, round(avg(value), 6) as value from (select *, cast(year(time) as integer) as bin from cube) group by all")
def _roundtrip(s, d):
    catalog = Catalog(shared_folder(s))
    catalog.save("yearly", C.reduced(cells(s, d), "ave", "t", group="year"), "bin")
    return shown(catalog.load(s, "yearly").cells())


record_udf("demo.doubled", "Twice the value and one", lambda pdf: pdf.assign(value=pdf["value"] * 2 + 1))
reduce_udf("demo.largest", "Largest value by parts", lambda v: float(v.max()), merge=lambda v: float(v.max()))


@query("udf_reduce_kernel", "select member, y, lat, round(max(value), 6) as value from cube group by member, y, lat having count(value) > 0")
def _udf(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"demo.largest","input":"v1","axes":"tx"}]]')


@query("udf_record_kernel", "select member, t, y, x, time, lat, lon, round(value * 2 + 1, 6) as value from cube")
def _record(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"demo.doubled","input":"v1"}]]')


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of what the folder has now."""
    path = f"{d}/events.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path.replace("events.parquet", "events.parque*")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_event_windows", "select event_type, time_bucket(interval '6 hours', ts) as start, count(value) as count, round(sum(value), 4) as sum, max(value) as max from events group by 1, 2", base=False)
def _stream(s, d):
    out = drained(s, windowed(_event_stream(s, d), "ts", ["event_type"], "value", "6 hours", ("count", "sum", "max")), shared_folder(s))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "count", F.round("sum", 4).alias("sum"), "max")


@query("stream_sliding_windows", """with w as (select event_type, unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval 6 hours]) as start, value from events)
select event_type, start, count(value) as count, round(sum(value), 4) as sum from w group by 1, 2""", base=False)
def _stream_sliding(s, d):
    """Windows of twelve hours that begin every six."""
    out = drained(s, windowed(_event_stream(s, d), "ts", ["event_type"], "value", "12 hours", ("count", "sum"), slide="6 hours"), shared_folder(s))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "count", F.round("sum", 4).alias("sum"))


@query("stream_sessions", """with o as (select event_type, ts, case when ts < lag(ts) over (partition by event_type order by ts) + interval 5 minutes then 0 else 1 end as fresh from events),
g as (select *, sum(fresh) over (partition by event_type order by ts rows unbounded preceding) as k from o)
select event_type, min(ts) as start, max(ts) + interval 5 minutes as end_, count(*) as n from g group by event_type, k""", base=False)
def _stream_sessions(s, d):
    """Runs of events without a pause of five minutes."""
    out = drained(s, sessions(_event_stream(s, d), "ts", ["event_type"], "5 minutes"), shared_folder(s))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_"), "n")


@query("workflow_legacy_names", "select member, t, y, x, time, lat, lon, round(value - avg(value) over (partition by member, y, x), 6) as value from cube")
def _legacy(s, d):
    return _asked(s, d, '[variable=[{"uri":"collection:/lines","name":"q:v1"}],operation=[{"name":"Old.average","input":"v1","axes":"t","id":"m"},{"name":"Old.diff2","input":"v1,m"}]]')


@query("netcdf_roundtrip", "select cast(t - (select min(t) from cube where member = 'N') as integer) as t, y, x, time, lat, lon, round(value, 6) as value from cube where member = 'N' and value is not null")
def _netcdf(s, d):
    """A member written as files of some months each, and read back as a cube in order of time."""
    folder = shared_folder(s)
    one = C.member(cells(s, d), "N")
    paths = [r.path for r in write_cube(one, folder, "q", steps=24).select("path").collect()]
    return shown(cube_of(s, paths, "q").df.where("value is not null").select("t", "y", "x", "time", "lat", "lon", "value"))


@query("aggregation_texts", """select 'V' as kind, trim(var_name) as name, nullif(trim(shape), '') as shape, nullif(trim(dims), '') as dims from file_variables
where var_name is not null and coalesce(full_name, dods_name, description, shape, resolution, dims, units) is not null""", base=False)
def _aggregations(s, d):
    """The rows of variables of an aggregation text that is made of the header table."""
    folder = f"{shared_folder(s)}/texts"
    v = table(s, d, "file_variables").where(F.col("var_name").isNotNull() & F.coalesce("full_name", "dods_name", "description", "shape", "resolution", "dims", "units").isNotNull())
    safe = [F.translate(F.coalesce(c, F.lit("")), ";\n", "\u0001 ") for c in ("var_name", "full_name", "dods_name", "description", "shape", "resolution", "dims", "units")]
    v.select(F.concat_ws("; ", F.lit("V"), *safe).alias("value")).write.text(folder)
    out = aggregation_rows(s, [folder], "V")
    return out.select(F.lit("V").alias("kind"), "name", *[F.translate(c, "\u0001", ";").alias(c) for c in ("shape", "dims")])


@query("collections_listed", "select * from (values ('daily', 'Daily', 't y x'), ('means', 'Means', 'y x')) as c(id, title, axes)", base=False)
def _listed(s, d):
    catalog = Catalog(shared_folder(s))
    c = cells(s, d)
    catalog.save("Daily", c, title="Daily")
    catalog.save("Means", C.reduced(c, "ave", "t"), title="Means")
    catalog.store(s)
    return Catalog.open(s, catalog.folder).metadata(s, "collections").select("id", "title", "axes")


@query("append_longitude", "select member, t, y, cast(x as integer) as x, time, lat, lon, round(value, 6) as value from cube where x < 2 union all select member, t, y, cast(x as integer), time, lat, lon, round(value, 6) from cube where x >= 2")
def _append_x(s, d):
    low, high = C.split(cells(s, d), "x", 2)
    return shown(C.appended([low, high], [2], "x").cells())


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    # a rounded negative number may be -0 there, which is 0 here
    return {k: f"select * replace (value + 0.0::double as value) from ({q})" if q.rfind("as value") > q.rfind("select") else q for k, q in SQL.items()}
