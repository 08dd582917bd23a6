"""Operators over cells: one row per member and grid point, with axis columns, coordinates and a value.

A missing value is null. A reduced axis is the absence of its column, so two cubes combine by a join on the axes that both have, and
every operator is a plain plan of projections, aggregations, joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import CYCLIC, GREGORIAN, calendar_bin, parts_of, season_months
from gridloom.operators.blocks import carried, join_same, ranked

#: Columns that come and go with an axis.
COORDINATES = {"t": ("time", "time_end"), "z": ("lev",), "y": ("lat",), "x": ("lon",)}


@dataclass(frozen=True)
class Cube:
    """Cells: ``axes`` are the axis columns of ``df``, ``tags`` further keys (member, bin), ``coords`` coordinate columns, and ``value`` holds doubles."""

    df: DataFrame
    axes: tuple[str, ...] = ("t", "y", "x")
    tags: tuple[str, ...] = ("member",)
    coords: tuple[str, ...] = ()
    value: str = "value"
    more: tuple[str, ...] = field(default=())
    #: Coordinates of axes, where known: spans of values then resolve without reading data.
    axis_values: dict = field(default_factory=dict)
    #: Calendar of the times; in a model calendar they are milliseconds since its own 1970-01-01.
    calendar: str = "gregorian"
    #: The calendar group whose bins the tag ``bin`` holds.
    bins: str | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.tags, *self.axes]

    @property
    def moment(self) -> Column:
        """The middle of each time step where its end is known, else its start."""
        time = F.col("time")
        if "time_end" not in self.coords:
            return time
        if self.calendar.strip().lower() in GREGORIAN:
            return time + (F.col("time_end") - time) / 2
        return F.floor((time + F.col("time_end")) / 2)

    def bin_of(self, group: str, compat: bool = False) -> Column:
        return calendar_bin(group, self.moment, compat, self.calendar)

    def cells(self) -> DataFrame:
        return self.df.select(*self.keys, *self.coords, self.value, *self.more)


def normalised(value: Column, missing: float | Column | None = None) -> Column:
    """Doubles with the sentinel and NaN as null."""
    v = value.cast("double")
    v = F.when(~F.isnan(v), v)
    return v if missing is None else F.when(v != (missing if isinstance(missing, Column) else F.lit(float(missing))), v)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


#: Reductions by name: the column of an aggregate over non-missing values. All give null for a group without any. ``sub`` and ``div`` fold from 0 and 1.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "ave": F.avg,
    "rms": lambda v: F.sqrt(F.sum(v * v) / F.nullif(F.count(v) - 1, F.lit(0))),
    "rmsum": lambda v: F.when(F.sum(v) >= 0, F.sqrt(F.sum(v) / F.nullif(F.count(v) - 1, F.lit(0)))),
    "sqadd": lambda v: F.sum(v * v),
    "mult": lambda v: F.product(v),
    "sub": lambda v: -F.sum(v),
    "div": lambda v: _ratio(F.lit(1.0), F.product(v)),
    "stddev": F.stddev_samp,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "ptp": lambda v: F.max(v) - F.min(v),
    "maxmag": lambda v: F.max_by(v, F.struct(F.abs(v), v)),
    "minmag": lambda v: F.min_by(v, F.when(v.isNotNull(), F.struct(F.abs(v), v))),
    "count": F.count,
}


def _without(cube: Cube, axes: str) -> Cube:
    gone = set(axes)
    if not gone or not gone <= set("tzyx"):
        raise ValueError(f"axes must name some of t, z, y, x: {axes!r}")
    kept = tuple(a for a in cube.axes if a not in gone)
    return replace(cube, axes=kept, coords=tuple(c for c in cube.coords if any(c in COORDINATES[a] for a in kept)), more=())


def weights_of(cube: Cube, kind: str | None, axes: str) -> Column:
    """Cell weights: cosine of latitude if asked and y is reduced; ``area`` takes the sine difference of cell bounds of a grid with ``dlat`` degrees between rows."""
    if kind == "cosine" and "y" in axes:
        return F.cos(F.radians("lat"))
    if kind and kind.startswith("area:") and "y" in axes:
        half = float(kind[5:]) / 2
        return F.sin(F.radians(F.least(F.col("lat") + half, F.lit(90.0)))) - F.sin(F.radians(F.greatest(F.col("lat") - half, F.lit(-90.0))))
    if kind in (None, "", "cosine") or kind.startswith("area:"):
        return F.lit(1.0)
    raise ValueError(f"no weights: {kind}")


def reduced(cube: Cube, op: str, axes: str, weights: str | None = None, group: str | None = None, compat: bool = False) -> Cube:
    """The cube without ``axes``: ``op`` over the cells that share the other keys, or also the calendar bin ``group`` of their time (then tag ``bin``).

    Missing cells are skipped; a group of missing cells only gives null. Partial aggregates are combined before the shuffle.
    """
    out = _without(cube, axes)
    df = cube.df
    tags = out.tags
    if group:
        if "t" not in axes:
            raise ValueError("calendar groups need the axis t to be reduced")
        df, tags = df.withColumn("bin", cube.bin_of(group, compat)), (*tags, "bin")
    v = F.col(cube.value)
    if weights and op == "ave":
        w = weights_of(cube, weights, axes)
        agg = _ratio(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
    elif op in REDUCTIONS:
        agg = REDUCTIONS[op](v)
    else:
        raise ValueError(f"no reduction: {op}")
    return replace(out, df=df.groupBy(*tags, *out.axes, *out.coords).agg(agg.alias(cube.value)), tags=tags, bins=group)


def _with_groups(cube: Cube, axes: str, group: str | None, aggregates: dict[str, Column]) -> DataFrame:
    """The cells with the aggregates of the group that each is in (the keys without ``axes``, and the calendar bin).

    Groups are aggregated, partial sums before the shuffle, and joined back to the cells; a small table of groups is sent to all
    tasks by the optimizer, which measures it, so neither a hot group nor a single one makes one task sort all cells.
    """
    if not set(axes) <= set("tzyx"):
        raise ValueError(f"axes must name some of t, z, y, x: {axes!r}")
    df, by = cube.df, [*cube.tags, *(a for a in cube.axes if a not in axes)]
    if group:
        df, by = df.withColumn("_bin", cube.bin_of(group)), [*by, "_bin"]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))  # one row
    groups = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return join_same(df, groups, by).drop("_bin")


def broadcast_back(cube: Cube, op: str, axes: str, name: str, weights: str | None = None, group: str | None = None) -> DataFrame:
    """The cells with the column ``name``: the reduction of the group that each is in."""
    v = F.col(cube.value)
    if op == "ave" and weights:
        w = weights_of(cube, weights, axes)
        agg = _ratio(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
    else:
        agg = REDUCTIONS[op](v)
    return _with_groups(cube, axes, group, {name: agg})


def anomaly(cube: Cube, axes: str, group: str | None = None, weights: str | None = None) -> Cube:
    """Each value less the mean of its group (all of ``axes``, or its calendar bin)."""
    df = broadcast_back(cube, "ave", axes, "_mean", weights, group)
    return replace(cube, df=df.withColumn(cube.value, F.col(cube.value) - F.col("_mean")).drop("_mean"))


def rescaled(cube: Cube, axes: str = "t") -> Cube:
    """Each value less its cell's mean, divided by its sample deviation; a constant cell gives 0."""
    v = F.col(cube.value)
    df = _with_groups(cube, axes, None, {"_m": F.avg(v), "_d": F.stddev_samp(v)})
    return replace(cube, df=df.withColumn(cube.value, F.when(F.coalesce("_d", F.lit(0.0)) == 0, F.when(v.isNotNull(), 0.0)).otherwise((v - F.col("_m")) / F.col("_d"))).drop("_m", "_d"))


#: Element-wise operators; all give null if an operand is missing, division also for a zero divisor.
ELEMENTWISE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b,
    "diff": lambda a, b: a - b,
    "mult": lambda a, b: a * b,
    "div": _ratio,
    "min": lambda a, b: F.when(a <= b, a).when(b < a, b),
    "max": lambda a, b: F.when(a >= b, a).when(b > a, b),
}


def combined(op: str, cubes: list[Cube]) -> Cube:
    """``op`` of the cubes, cell by cell in the order given.

    Cubes join on the keys that both have: an axis that one lacks counts as length 1 and is broadcast, in either direction; so is
    the one cell of a cube without keys. If one cube holds the calendar bins of a group, each cell of the other meets the bin that its
    time is in. Keys that neither contains the other are incommensurate. Cells absent from a cube drop out.
    """
    if len(cubes) < 2:
        raise ValueError("two or more inputs are needed")

    def binned(cube: Cube, other: Cube) -> Cube:
        """``cube`` with the bins of ``other`` as a further tag, if only ``other`` has such."""
        if not other.bins or "bin" in cube.tags or "bin" not in other.tags or "t" not in cube.axes:
            return cube
        return replace(cube, df=cube.df.withColumn("bin", cube.bin_of(other.bins)), tags=(*cube.tags, "bin"))

    def two(a: Cube, b: Cube) -> Cube:
        added = ("bin" in a.tags) != ("bin" in b.tags)
        a, b = binned(a, b), binned(b, a)
        if not (set(a.keys) <= set(b.keys) or set(b.keys) <= set(a.keys)):
            raise ValueError(f"incommensurate axes: {a.keys} and {b.keys}")
        wide = a if len(a.keys) >= len(b.keys) else b
        common = [k for k in wide.keys if k in a.keys and k in b.keys]
        left = a.df.select(*a.keys, *(a.coords if wide is a else ()), F.col(a.value).alias("_a"))
        right = b.df.select(*b.keys, *(b.coords if wide is b else ()), F.col(b.value).alias("_b"))
        if common:
            joined = left.join(right, common)
        else:  # one side is fully reduced, a single cell
            joined = left.crossJoin(F.broadcast(right)) if wide is a else right.crossJoin(F.broadcast(left))
        tags = tuple(t for t in wide.tags if t != "bin") if added else wide.tags
        keys = [*tags, *wide.axes]
        known = {**b.axis_values, **a.axis_values}
        return Cube(joined.select(*keys, *wide.coords, ELEMENTWISE[op](F.col("_a"), F.col("_b")).alias("value")), wide.axes, tags, wide.coords, axis_values={x: known[x] for x in wide.axes if x in known}, calendar=wide.calendar, bins=None if added else wide.bins)

    return fold(two, cubes)


def with_scalar(cube: Cube, op: str, number: float) -> Cube:
    """Each value and a number under ``sum``, ``diff``, ``mult``, ``div``, ``min`` or ``max``; ``const`` sets each value that isn't missing."""
    v, n = F.col(cube.value), F.lit(float(number))
    new = F.when(v.isNotNull(), n) if op == "const" else ELEMENTWISE[op](v, n)
    return replace(cube, df=cube.df.withColumn(cube.value, new))


def mapped(cube: Cube, f: Callable[[Column], Column]) -> Cube:
    """``f`` of each value that isn't missing."""
    v = F.col(cube.value)
    return replace(cube, df=cube.df.withColumn(cube.value, F.when(v.isNotNull(), f(v))))


def split(cube: Cube, axis: str, at: int) -> tuple[Cube, Cube]:
    """The cells before index ``at`` of an axis and those from it on, which count from 0 again."""
    if axis not in cube.axes:
        raise ValueError(f"no axis {axis}")
    return replace(cube, df=cube.df.where(F.col(axis) < at)), replace(cube, df=cube.df.where(F.col(axis) >= at).withColumn(axis, F.col(axis) - at))


def spawned(spark: SparkSession, shape: dict[str, int], f: Callable[[dict[str, Column]], Column] | float | None) -> Cube:
    """A cube of the given length along each axis: a constant, all missing (None), or a function of the axis columns."""
    df = spark.range(1)
    for axis, n in shape.items():
        df = df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(axis, F.lit(0)).limit(0)
    value = f({a: F.col(a) for a in shape}) if callable(f) else F.lit(f)
    return Cube(df.select(*shape, value.cast("double").alias("value")), tuple(shape), ())


def sample(cube: Cube, n: int, start: int = 0) -> DataFrame:
    """The cells number ``start`` to ``start + n - 1`` in the order of their keys."""
    return cube.cells().orderBy(*cube.keys).offset(start).limit(n)


def sorted_values(cube: Cube, descending: bool = False) -> DataFrame:
    """All cells in order of value, missing ones last, equal ones in order of their keys. The sort is by range, so no task sees all."""
    v = F.col(cube.value)
    return cube.cells().orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last(), *cube.keys)


def bin_reduced(cube: Cube, op: str, axes: str, by: Column, weights: Column | None = None) -> Cube:
    """As ``reduced``, with the cells of each group scattered into bins ``by`` (tag ``bin``; a null bin takes no part). With ``weights`` the sum is weighted, and their own sum is the column ``weight``."""
    out = _without(cube, axes)
    df = cube.df.withColumn("bin", by).where("bin is not null")
    v, tags = F.col(cube.value), (*out.tags, "bin")
    grouped = df.groupBy(*tags, *out.axes, *out.coords)
    if weights is None:
        return replace(out, df=grouped.agg(REDUCTIONS[op](v).alias(cube.value)), tags=tags)
    w = F.when(v.isNotNull(), weights)
    return replace(out, df=grouped.agg(F.sum(v * w).alias(cube.value), F.sum(w).alias("weight")), tags=tags, more=("weight",))


def bin_merged(cube: Cube, binned: Cube, op: str, by: Column) -> Cube:
    """``op`` of each cell and the value of the bin ``by`` that it lies in, of a cube with the tag ``bin``; cells without such a bin are missing."""
    own = replace(cube, df=cube.df.withColumn("bin", by))
    keys = [k for k in binned.keys if k in (*cube.keys, "bin")]
    other = binned.df.select(*keys, F.col(binned.value).alias("_b"))
    joined = join_same(own.df, other, keys, "left")
    return replace(cube, df=joined.withColumn(cube.value, ELEMENTWISE[op](F.col(cube.value), F.col("_b"))).drop("bin", "_b"))


def scaled_difference(a: Cube, b: Cube) -> DataFrame:
    """One row ``(mean, max_scaled_diff)``: the mean of ``a``, and the largest absolute difference of two cells divided by it."""
    both = join_same(a.df.select(*a.keys, F.col(a.value).alias("_a")), b.df.select(*a.keys, F.col(b.value).alias("_b")), a.keys)
    return both.agg(F.avg("_a").alias("mean"), _ratio(F.max(F.abs(F.col("_a") - F.col("_b"))), F.avg("_a")).alias("max_scaled_diff"))


def zipped(left: DataFrame, right: DataFrame, on: str, prefix: str = "right_", width: float | None = None) -> DataFrame:
    """The rows of two tables side by side, the k-th by ``on`` with the k-th; what one has more drops out. Columns of the right get a prefix.

    With ``width`` a numeric ``on`` is cut into blocks of that width, so that no task orders a whole table.
    """
    place = lambda df, c: ranked(df, [], c, F.floor(F.col(c) / F.lit(width)) if width else F.lit(0), "_k")
    b = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    return place(left, on).join(place(b, prefix + on), "_k").drop("_k")


def member(cube: Cube, name: str) -> Cube:
    """One member of an ensemble, without the member key."""
    return replace(cube, df=cube.df.where(F.col("member") == name).drop("member"), tags=tuple(t for t in cube.tags if t != "member"))


def ensemble(cubes: list[Cube], stats: tuple[str, ...] = ("ave", "sum", "count")) -> DataFrame:
    """Per cell over all inputs, missing ones skipped: one column per statistic."""
    first = cubes[0]
    cells = fold(DataFrame.unionByName, [c.df.select(*first.keys, F.col(c.value).alias("value")) for c in cubes])
    return cells.groupBy(*first.keys).agg(*[REDUCTIONS[s](F.col("value")).alias(s) for s in stats])


def over_members(cube: Cube, stats: tuple[str, ...]) -> DataFrame:
    """As ``ensemble`` for the members of one cube."""
    keys = [k for k in cube.keys if k != "member"]
    return cube.df.groupBy(*keys).agg(*[REDUCTIONS[s](F.col(cube.value)).alias(s) for s in stats])


@dataclass(frozen=True)
class Span:
    """One axis of a domain: inclusive bounds in indices, coordinate values or (time only, end exclusive) timestamps; ``season`` keeps months."""

    axis: str
    start: float | str | None = None
    end: float | str | None = None
    system: str = "indices"
    season: str | None = None
    #: Coordinate values to keep, each within a relative distance of 1e-4.
    levels: tuple[float, ...] = ()


def subset(cube: Cube, spans: list[Span]) -> Cube:
    """The cells inside all spans.

    Bounds become plain comparisons that the scan can take over. A span of values includes both bounds; where no coordinate falls
    into it, the first one above its start counts, and none if there is none. Longitudes are shifted by whole circles onto the axis, so
    -30 to 30 wraps. Time bounds are half open; a single instant picks the step that it falls into (without known ends the last step
    that begins by then, or the first of all). Where the coordinates of an axis are known, spans resolve without reading data;
    otherwise the choice is part of the plan, one row that is sent to all tasks. A span over an axis that is absent is an error.
    """
    df, known = cube.df, dict(cube.axis_values)
    for s in spans:
        if s.axis not in cube.axes:
            raise ValueError(f"no axis {s.axis}")
        start, end = s.start, s.start if s.end is None else s.end
        table = known.get(s.axis)
        table = dict(enumerate(table)) if isinstance(table, list) else table
        if s.season:
            df = df.where(parts_of(cube.moment, cube.calendar)["month"].isin(season_months(s.season)))
        c = F.col(COORDINATES[s.axis][0])
        if s.levels:
            df = df.where(fold(lambda a, b: a | b, [F.abs(c - F.lit(float(x))) <= F.lit(abs(float(x)) * 1e-4) for x in s.levels]))
            table = table and {k: v for k, v in table.items() if any(abs(v - float(x)) <= abs(float(x)) * 1e-4 for x in s.levels)}
            known.update({s.axis: table} if table else {})
        if start is None:
            continue
        if s.system == "indices":
            df = df.where(F.col(s.axis).between(int(start), int(end)))
            known.update({s.axis: {k: v for k, v in table.items() if int(start) <= k <= int(end)}} if table else {})
        elif s.system in ("timestamps", "values") and s.axis == "t":
            df = _at_times(df, cube, start, s.end)
        elif s.system == "values" and table:
            chosen = _chosen(table, float(start), float(end), s.axis == "x")
            df = df.where(c.between(float(start), float(end))) if s.axis != "x" and len(chosen) > 1 else df.where(F.col(s.axis).isin(list(chosen)))
            known[s.axis] = chosen
        elif s.system == "values":
            df = _at_values(df, c, float(start), float(end), s.axis == "x")
        else:
            raise ValueError(f"no coordinate system: {s.system}")
    return replace(cube, df=df, axis_values={a: v for a, v in known.items() if v})


def _at_times(df: DataFrame, cube: Cube, start: float | str, end: float | str | None) -> DataFrame:
    kind = "timestamp_ntz" if cube.calendar.strip().lower() in GREGORIAN else "long"
    point = lambda x: F.lit(str(x)).cast("string").cast(kind)
    time = F.col("time")
    if end is not None and end != start:
        return df.where((time >= point(start)) & (time < point(end)))
    if "time_end" in cube.coords:
        return df.where((time <= point(start)) & (F.col("time_end") > point(start)))
    step = df.agg(F.coalesce(F.max(F.when(time <= point(start), time)), F.min(time)).alias("_step"))
    return df.crossJoin(F.broadcast(step)).where(time == F.col("_step")).drop("_step")


def _chosen(table: dict[int, float], start: float, end: float, cyclic: bool) -> dict[int, float]:
    """The part of an axis table that a span of values picks."""
    width = (end - start) % 360.0 if cyclic and end < start else end - start
    inside = {k: v for k, v in table.items() if ((v - start) % 360.0 if cyclic else v - start) <= width and (cyclic or v >= start)}
    first = min(table.values()) + (start - min(table.values())) % 360.0 if cyclic else start
    above = {k: v for k, v in table.items() if v > first}
    return inside or {k: v for k, v in above.items() if v == min(above.values())}


def _at_values(df: DataFrame, c: Column, start: float, end: float, cyclic: bool) -> DataFrame:
    """As ``_chosen`` where the coordinates aren't known: the choice is a row of the plan."""
    width = (end - start) % 360.0 if cyclic and end < start else end - start
    within = F.pmod(c - F.lit(start), F.lit(360.0)) <= width if cyclic else c.between(start, end)
    ends = df.agg(F.max(within.cast("int")).alias("_hit"), F.min(c).alias("_low"))
    shifted = F.col("_low") + F.pmod(F.lit(start) - F.col("_low"), F.lit(360.0)) if cyclic else F.lit(start)
    coordinates = df.select(c.alias("_c")).distinct()
    chosen = coordinates.crossJoin(F.broadcast(ends)).agg(F.max("_hit").alias("_hit"), F.min(F.when(F.col("_c") > shifted, F.col("_c"))).alias("_next"))
    return df.crossJoin(F.broadcast(chosen)).where(F.when(F.col("_hit") == 1, within).otherwise(c == F.col("_next"))).drop("_hit", "_next")


def complete_seasons(cube: Cube, season: str) -> Cube:
    """Cells in the season, of those season-years only in which every month of it occurs; a season that crosses the year's end belongs to the year it ends in."""
    months = season_months(season)
    late = months[: months.index(1)] if 1 in months and months[0] != 1 else []
    p = parts_of(cube.moment, cube.calendar)
    df = cube.df.withColumn("_m", p["month"]).where(F.col("_m").isin(months)).withColumn("_sy", p["year"] + F.when(F.col("_m").isin(late), 1).otherwise(0) if late else p["year"])
    whole = df.groupBy("_sy").agg(F.count_distinct("_m").alias("_n")).where(F.col("_n") == len(months)).select("_sy")
    return replace(cube, df=df.join(whole, "_sy", "left_semi").drop("_sy", "_m"))


def masked(cube: Cube, rings: list[list[tuple[float, float]]]) -> Cube:
    """Cells inside a polygon of (lon, lat) rings by the even-odd rule; a point on a lower or left edge counts as inside."""
    crossings = F.lit(0)
    lon, lat = F.col("lon"), F.col("lat")
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 == y2:
                continue
            straddles = (lat >= min(y1, y2)) & (lat < max(y1, y2))
            crossings = crossings + F.when(straddles & (lon < F.lit(float(x1)) + (lat - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return replace(cube, df=cube.df.where(crossings % 2 == 1))


def applied_mask(cube: Cube, mask: DataFrame, axes: list[str], flag: str = "mask") -> Cube:
    """Cells whose entry in ``mask`` (``axes``, ``flag``) is 0 become missing; cells without an entry, too. Entries are one each."""
    joined = join_same(cube.df, mask.select(*axes, F.col(flag).alias("_mask")), axes, "left")
    return replace(cube, df=joined.withColumn(cube.value, F.when(F.col("_mask") != 0, F.col(cube.value))).drop("_mask"))


def _along(cube: Cube, group: int | str) -> tuple[Column, Column, Column, Column]:
    """Where a step begins, ends and has its middle along time, as numbers, and its bin: of ``group`` steps, or a calendar group's."""
    if isinstance(group, int):
        t = F.col("t").cast("double")
        return t, t + 1, t + 0.5, F.floor(F.col("t") / group)
    number = lambda c: c.cast("double") if cube.calendar.strip().lower() not in GREGORIAN else F.unix_micros(c.cast("timestamp")) / 1000.0
    start = number(F.col("time"))
    end = number(F.col("time_end")) if "time_end" in cube.coords else start
    return start, end, (start + end) / 2, cube.bin_of(group)


def lowpass(cube: Cube, group: int | str) -> Cube:
    """Means of successive bins, joined by straight lines between the middles of the bins and evaluated at the middle of each step; flat before the first and after the last middle.

    A bin is ``group`` steps of index ``t``, or a non-cyclic calendar group such as 6-month or season. Its middle lies between the
    start of its first and the end of its last step. Bins without values are skipped. Each cell joins its own bin, which knows the bins on
    either side, so only bins are ordered, never steps.
    """
    if isinstance(group, str) and (group.replace(" ", "").lower() in CYCLIC or group.replace(" ", "").lower().endswith("ofyear")):
        raise ValueError(f"a cycle has no course in time: {group}")
    rest = [*cube.tags, *(a for a in cube.axes if a != "t")]
    start, end, middle, bin_ = _along(cube, group)
    df = cube.df.withColumns({"_at": middle, "_g": bin_, "_s": start, "_e": end})
    bins = df.groupBy(*rest, "_g").agg(F.avg(cube.value).alias("_v"), ((F.min("_s") + F.max("_e")) / 2).alias("_m"))
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col("_m").alias("m"), F.col("_v").alias("v")))
    ahead, behind = Window.partitionBy(*rest).orderBy("_g"), Window.partitionBy(*rest).orderBy(F.col("_g").desc())
    before = lambda w: F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("_p", point).withColumns({"_l": before(ahead), "_r": before(behind)}).select(*rest, "_g", "_p", "_l", "_r")
    both = join_same(df, bins, [*rest, "_g"])
    here, at = F.col("_p"), F.col("_at")
    left = F.when(here.isNotNull() & (at >= here["m"]), here).otherwise(F.col("_l"))
    right = F.when(here.isNotNull() & (at < here["m"]), here).otherwise(F.col("_r"))
    value = _between(at, left, right)
    return replace(cube, df=both.withColumn(cube.value, value).drop("_at", "_g", "_s", "_e", "_p", "_l", "_r"))


def _between(at: Column, left: Column, right: Column) -> Column:
    """The value at ``at`` on the line from the point ``left`` to ``right`` (structs m, v); flat where one is null."""
    return F.when(left.isNull(), right["v"]).when(right.isNull() | (left["m"] == right["m"]), left["v"]).otherwise(left["v"] + (right["v"] - left["v"]) * (at - left["m"]) / (right["m"] - left["m"]))


def highpass(cube: Cube, group: int | str) -> Cube:
    """Each value less its lowpass."""
    kept = replace(cube, df=cube.df.withColumn("_raw", F.col(cube.value)))
    low = lowpass(kept, group)
    return replace(cube, df=low.df.withColumn(cube.value, F.col("_raw") - F.col(cube.value)).drop("_raw"))


#: Steps per block when the steps of a series are numbered.
STEPS = 1 << 16


def sliding(cube: Cube, size: int, step: int) -> Cube:
    """Means of ``size`` successive steps from every ``step``-th step on, labelled by the first; the last windows may be shorter.

    Each row goes to the windows that it is in, and these are aggregated, so a long series spreads over many tasks.
    """
    rest = [*cube.tags, *(a for a in cube.axes if a != "t")]
    placed = ranked(cube.df.select(*rest, "t", cube.value), rest, "t", F.floor(F.col("t") / STEPS), "_n")
    last = F.floor((F.col("_n") - 1) / step)
    first = F.greatest(F.ceil((F.col("_n") - size) / F.lit(step)), F.lit(0))
    rows = placed.where(first <= last).withColumn("_w", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    out = rows.groupBy(*rest, "_w").agg(F.min("t").alias("t"), F.avg(cube.value).alias("value"))
    return Cube(out.select(*rest, "t", "value"), cube.axes, cube.tags)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, name: str, bucket: Column | None = None, clamp: bool = False) -> DataFrame:
    """``left`` with ``name``: the right ``value`` of the latest row with equal keys at or before ``on``; before the first one null, or the first one's with ``clamp``.

    Both sides run through one window. With ``bucket``, a column that does not decrease along ``on``, a hot key is split into its
    buckets, and the last value of each earlier bucket is carried over.
    """
    cols = [c for c in left.columns if c not in keys and c != on]
    a = left.select(*keys, on, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*keys, on, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = a.unionByName(b).withColumn("_p", F.when(F.col("_side") == 0, F.struct("_v")))
    block = bucket if bucket is not None else F.lit(0)
    both = carried(both, keys, [on, "_side", "_v"], block, "_p", "_hit")
    hit = F.col("_hit._v")
    if clamp:
        first = right.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("_v")), F.struct(on, value)).alias("_first"))
        both = join_same(both, first, keys, "left")
        hit = F.when(F.col("_hit").isNotNull(), hit).otherwise(F.col("_first._v"))
    return both.where("_side = 1").select(*[F.col(k) for k in keys], F.col(on), *[F.col("_row")[c].alias(c) for c in cols], hit.alias(name))


def converted(source: DataFrame, targets: DataFrame, keys: list[str], on: str, value: str, width: float = 65536.0) -> DataFrame:
    """Values of ``source`` at the positions ``on`` (numbers) of ``targets``: linear between the bracketing points, the nearest beyond them.

    Series are cut into blocks of ``width`` along ``on``; the nearest points are carried over the borders.
    """
    at = F.col(on).cast("double")
    a = targets.select(*keys, at.alias(on), F.lit(None).cast("struct<m:double,v:double>").alias("_p"), F.lit(1).alias("_side"))
    b = source.where(F.col(value).isNotNull()).select(*keys, at.alias(on), F.struct(at.alias("m"), F.col(value).cast("double").alias("v")).alias("_p"), F.lit(0).alias("_side"))
    block = F.floor(at / F.lit(width))
    both = carried(a.unionByName(b), keys, [on], block, "_p", "_l", ties=["_side"])
    both = carried(both, keys, [on], block, "_p", "_r", ties=["_side"], following=True)
    return both.where("_side = 1").select(*keys, on, _between(F.col(on), F.col("_l"), F.col("_r")).alias("value"))


def correlations(cube: Cube) -> DataFrame:
    """``(a, b, corr, n)``: the correlation of each pair of members over the cells that both have."""
    keys = [k for k in cube.keys if k != "member"]
    left = cube.df.select(*keys, F.col("member").alias("a"), F.col(cube.value).alias("_x"))
    right = cube.df.select(*keys, F.col("member").alias("b"), F.col(cube.value).alias("_y"))
    both = left.join(right, keys).where("a < b and _x is not null and _y is not null")
    return both.groupBy("a", "b").agg(F.corr("_x", "_y").alias("corr"), F.count(F.lit(1)).alias("n"))


def appended(cubes: list[Cube], steps: list[int], axis: str = "t") -> Cube:
    """The cubes one after the other along an axis; ``steps`` are the lengths of all but the last."""
    start, parts = 0, []
    for c, n in zip(cubes, [*steps, 0]):
        parts.append(c.df.withColumn(axis, F.col(axis) + start))
        start += n
    return replace(cubes[0], df=fold(DataFrame.unionByName, parts), axis_values={a: v for a, v in cubes[0].axis_values.items() if a != axis})
