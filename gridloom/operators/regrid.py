"""Other grids: target axes, bilinear interpolation, area weights."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cube import COORDINATES, Cube


def uniform_axis(start: float, step: float, n: int) -> list[float]:
    return [start + step * k for k in range(n)]


def gaussian_axis(n: int) -> list[float]:
    """The ``n`` Gaussian latitudes from south to north."""
    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(n)[0])).tolist()


Axis = dict[int, float]
Grid = tuple[Axis, Axis]


def _indexed(values: list[float] | Axis) -> Axis:
    return values if isinstance(values, dict) else dict(enumerate(values))


def _brackets(source: list[float] | Axis, target: list[float], cyclic: float | None = None) -> list[tuple]:
    """``(target index, target coordinate, source index, weight)`` of linear interpolation.

    Beyond the ends the nearest point counts. An axis that goes all around its circle has no ends; targets further than half a step
    from a part of a circle have no rows.
    """
    at = sorted(_indexed(source).items(), key=lambda kv: kv[1])
    index, s = [k for k, _ in at], np.asarray([v for _, v in at], float)
    step = float(np.max(np.diff(s))) if len(s) > 1 else 0.0
    around = bool(cyclic) and len(s) > 1 and s[-1] - s[0] + step >= cyclic - 1e-6
    rows = []
    for k, x in enumerate(target):
        if cyclic:
            x0 = (x - s[0] + (0 if around else step / 2)) % cyclic + s[0] - (0 if around else step / 2)
        else:
            x0 = x
        if cyclic and not around and not s[0] - step / 2 - 1e-9 <= x0 <= s[-1] + step / 2 + 1e-9 and len(s) > 1:
            continue
        x0 = x0 if around else min(max(x0, s[0]), s[-1])
        j = min(int(np.searchsorted(s, x0, "right")) - 1, len(s) - (1 if around else 2) if len(s) > 1 else 0)
        if len(s) == 1:
            rows.append((k, float(x), index[0], 1.0))
            continue
        low, high = s[j], s[j + 1] if j + 1 < len(s) else s[0] + cyclic
        f = (x0 - low) / (high - low)
        rows += [(k, float(x), i, float(w)) for i, w in ((index[j], 1 - f), (index[(j + 1) % len(s)], f)) if w > 0]
    return rows


def regridded(cube: Cube, lats: list[float] | Axis, lons: list[float] | Axis, to_lats: list[float], to_lons: list[float]) -> Cube:
    """Bilinear interpolation onto other latitudes and longitudes: each target is the weighted mean of up to four cells, missing ones left out.

    The weight tables have at most two rows per target row or column, whatever the data, so they are broadcast; interpolation runs
    along y and then x, with a partial aggregate before each shuffle. Targets off a source that spans part of the circle have no cells.
    """
    spark = cube.df.sparkSession
    wy = spark.createDataFrame(_brackets(lats, to_lats), "_ty int, _tlat double, y int, _wy double")
    wx = spark.createDataFrame(_brackets(lons, to_lons, 360.0), "_tx int, _tlon double, x int, _wx double")
    rest = [*cube.tags, *(a for a in cube.axes if a not in "yx")]
    keep = [c for c in cube.coords if c not in ("lat", "lon")]
    df = cube.df.where(F.col(cube.value).isNotNull()).join(F.broadcast(wy), "y").join(F.broadcast(wx), "x")
    w = F.col("_wy") * F.col("_wx")
    out = df.groupBy(*rest, *keep, F.col("_ty").alias("y"), F.col("_tlat").alias("lat"), F.col("_tx").alias("x"), F.col("_tlon").alias("lon")).agg((F.sum(w * F.col(cube.value)) / F.sum(w)).alias(cube.value))
    return replace(cube, df=out, coords=(*keep, "lat", "lon"), more=(), axis_values={**cube.axis_values, "y": list(to_lats), "x": list(to_lons)})


def same_grid(a: Grid | tuple[list[float], list[float]], b: Grid | tuple[list[float], list[float]], eps: float = 1e-6) -> bool:
    """Whether two (latitudes, longitudes) pairs are one grid, so that interpolation can be skipped."""
    return all(len(x) == len(y) and all(abs(p - q) <= eps for p, q in zip(_indexed(x).values(), _indexed(y).values())) for x, y in zip(a, b))


def axis_values(cube: Cube, axis: str, coordinate: str) -> Axis:
    """Coordinates of an axis by index; an axis table is as long as the axis, not as the data."""
    known = cube.axis_values.get(axis)
    if known:
        return _indexed(known)
    return {r[0]: r[1] for r in cube.df.select(axis, coordinate).distinct().orderBy(axis).collect()}


def grid_of(cube: Cube) -> Grid:
    """Latitudes and longitudes of a cube by index."""
    return axis_values(cube, "y", "lat"), axis_values(cube, "x", "lon")


axis_grid = grid_of


def axis_table(cube: Cube, axis: str) -> DataFrame:
    """``(axis, index, value, lo, hi)`` of an axis, with bounds halfway between neighbours (latitudes end at the poles)."""
    own = axis_values(cube, axis, COORDINATES[axis][0])
    index, v = list(own), list(own.values())
    half = [(b - a) / 2 for a, b in zip(v, v[1:])] or [0.5]
    clip = (lambda x: min(max(x, -90.0), 90.0)) if axis == "y" else float
    rows = [(axis, k, float(x), clip(x - half[max(n - 1, 0)]), clip(x + half[min(n, len(half) - 1)])) for n, (k, x) in enumerate(zip(index, v))]
    return cube.df.sparkSession.createDataFrame(rows, "axis string, index int, value double, lo double, hi double")


def _list(v: object) -> list[float]:
    return [float(x) for x in (v if isinstance(v, list) else str(v).split(",")) if str(x).strip()] if v not in (None, "") else []


def target_grid(config: dict, own: Grid, grids: dict) -> tuple[list[float], list[float]]:
    """The grid that settings ask for: ``grid`` gaussian (``shape`` gives the latitudes) or uniform (``shape`` or ``res``, ``origin``), or the one of an input (``target``, or ``crs`` ~name) or of a table of axes (``gridspec``, a path).

    A uniform grid begins at the first cell of ``own`` unless an origin is given; without ``res`` it reaches from there to 90 north and
    once around; if its first cell straddles the edge of the input's first cell, it is shifted to that edge.
    """
    kind = str(config.get("grid", "")).lower()
    name = str(config.get("target", "")).lower() or str(config.get("crs", "")).removeprefix("~").lower() or str(config.get("gridspec", ""))
    shape, res, origin = [int(x) for x in _list(config.get("shape"))], _list(config.get("res")), _list(config.get("origin"))
    if "gaussian" in kind:
        if not shape:
            raise ValueError("a Gaussian grid needs a shape")
        lats = gaussian_axis(shape[0])
        n = shape[1] if len(shape) > 1 else 2 * shape[0]
        return lats, uniform_axis(0.0, 360.0 / n, n)
    if "uniform" in kind:
        lats, lons = (list(_indexed(a).values()) for a in own)
        origin = origin or [min(lats), min(lons)]
        if any(len(x) not in (0, 2) for x in (shape, res, origin)) or not (shape or res):
            raise ValueError("a uniform grid needs two numbers for shape or res, and for an origin")
        res = res or [(90.0 - origin[0]) / shape[0], (360.0 - origin[1]) / shape[1]]
        shape = shape or [round((90.0 - origin[0]) / res[0]), round((360.0 - origin[1]) / res[1])]
        for k, axis in enumerate((lats, lons)):
            axis = sorted(axis)
            step = axis[1] - axis[0] if len(axis) > 1 else res[k]
            edge = max(axis[0] - step / 2, -90.0) if k == 0 else axis[0] - step / 2
            low, high = origin[k] - res[k] / 2, origin[k] + res[k] / 2
            low = max(low, -90.0) if k == 0 else low
            origin[k] += edge - low if low < edge < high else 0.0
        return uniform_axis(origin[0], res[0], shape[0]), uniform_axis(origin[1], res[1], shape[1])
    if kind:
        raise ValueError(f"no kind of grid: {kind}")
    if not name:
        raise ValueError("no grid is named")
    return tuple(list(_indexed(a).values()) for a in grids[name])


def onto(cube: Cube, grid: Grid | tuple[list[float], list[float]]) -> Cube:
    """The cube on another grid; on its own one it stays as it is."""
    own = grid_of(cube)
    if same_grid(own, grid):
        return cube
    return regridded(cube, *own, *(list(_indexed(a).values()) for a in grid))
