"""NetCDF classic files (CDF-1 and CDF-2) without a library: headers, time slices as records, and a writer for results."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import GREGORIAN, YEAR_DAYS
from gridloom.functions.units import parse_unit
from gridloom.operators.cube import Cube
from gridloom.sources.files import created, opened, size_of

#: Type codes of the format and their big-endian NumPy types.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: list[str]
    attributes: dict
    dtype: str
    begin: int
    shape: list[int]
    is_record: bool


@dataclass
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    n_records: int
    record_size: int


def read_header(path: str) -> Header:
    """The header of a file; sizes and offsets only, no data."""
    with opened(path) as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError(f"{path}: not a NetCDF classic file")
        u4 = lambda: struct.unpack(">i", f.read(4))[0]

        def name() -> str:
            n = u4()
            s = f.read(n).decode()
            f.read(-n % 4)
            return s

        def attributes() -> dict:
            tag, n = u4(), u4()
            out = {}
            for _ in range(n if tag == _ATTRIBUTE else 0):
                k, t, m = name(), u4(), u4()
                size = np.dtype(TYPES[t]).itemsize * m
                raw = f.read(size)
                f.read(-size % 4)
                out[k] = raw.decode(errors="replace") if t == 2 else np.frombuffer(raw, TYPES[t]).astype(np.dtype(TYPES[t]).newbyteorder("=")).tolist()
            return out

        n_records = u4()
        tag, n = u4(), u4()
        dims = {}
        for _ in range(n if tag == _DIMENSION else 0):
            k = name()
            dims[k] = u4()
        names = list(dims)
        attrs = attributes()
        tag, n = u4(), u4()
        variables, size = {}, 0
        for _ in range(n if tag == _VARIABLE else 0):
            k = name()
            own = [names[u4()] for _ in range(u4())]
            va, t, vsize = attributes(), u4(), u4()
            begin = u4() if magic[3] == 1 else struct.unpack(">q", f.read(8))[0]
            record = bool(own) and dims[own[0]] == 0
            variables[k] = Variable(k, own, va, TYPES[t], begin, [dims[x] for x in own[1 if record else 0 :]], record)
            size += vsize if record else 0
        records = [v for v in variables.values() if v.is_record]
        if len(records) == 1:  # a single record variable isn't padded
            size = math.prod(records[0].shape) * np.dtype(records[0].dtype).itemsize
        if n_records < 0 and records:  # a file that was written as a stream doesn't say how many records it has
            n_records = (size_of(path) - min(v.begin for v in records)) // size if size else 0
        return Header(dims, attrs, variables, n_records, size)


def header_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, names)``: the variables of each file that are no coordinates, read by the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = [read_header(p) for p in pdf["path"]]
            yield pdf.assign(names=[sorted(v for v in h.variables if v not in h.dims) for h in heads])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism * 4), "path")
    return listed.mapInPandas(read, "path string, names array<string>")


def read_slices(path: str, head: Header, name: str, first: int, last: int) -> np.ndarray:
    """Steps ``first`` to ``last`` (exclusive) of a variable along its first dimension, missing values as NaN."""
    v = head.variables[name]
    shape = v.shape if v.is_record else v.shape[1:]
    n, kind = math.prod(shape), np.dtype(v.dtype)
    out = np.empty((last - first, n), np.float64)
    with opened(path) as f:
        for k in range(first, last):
            f.seek(v.begin + k * (head.record_size if v.is_record else n * kind.itemsize))
            out[k - first] = np.frombuffer(f.read(n * kind.itemsize), kind)
    for a in ("_FillValue", "missing_value"):
        if a in v.attributes and v.attributes[a]:
            out[out == v.attributes[a][0]] = np.nan
    scale, offset = (v.attributes.get(a) or [x] for a, x in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return out * scale[0] + offset[0] if (scale[0], offset[0]) != (1.0, 0.0) else out


def read_values(path: str, head: Header, name: str) -> np.ndarray:
    """All values of a variable with one dimension."""
    v = head.variables[name]
    n = head.n_records if v.is_record else v.shape[0]
    return read_slices(path, head, name, 0, n)[:, 0]


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, with nulls for NaN."""
    flat = pa.array(x.ravel(), pa.float64(), mask=np.isnan(x.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)


def records(spark: SparkSession, paths: list[str], variable: str, steps: int = 256) -> DataFrame:
    """``(path, t, shape array<int>, data array<double>)``: one row per file and time step, nulls for missing values.

    Headers are read in parallel and cut into ranges of ``steps`` time steps, which are spread over the cluster before any data is
    read. The files must lie where all executors see them. Files without the variable give no rows.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                h = read_header(p)
                if variable in h.variables:
                    v = h.variables[variable]
                    n = h.n_records if v.is_record else (v.shape[0] if v.shape else 0)
                    out += [(p, k, min(k + steps, n)) for k in range(0, n, steps)]
            yield pd.DataFrame(out, columns=["path", "first", "last"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, first, last in zip(*(c.to_pylist() for c in b.columns)):
                h = read_header(p)
                v = h.variables[variable]
                x = read_slices(p, h, variable, first, last)
                shape = pa.array([v.shape if v.is_record else v.shape[1:]] * len(x), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(x)), pa.array(np.arange(first, last), pa.int32()), shape, _lists(x)], ["path", "t", "shape", "data"])

    if not paths:
        return spark.createDataFrame([], "path string, t int, shape array<int>, data array<double>")
    width = spark.sparkContext.defaultParallelism * 3
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), width), "path")
    cut = listed.mapInPandas(ranges, "path string, first int, last int").repartition(width, "path", "first")
    return cut.mapInArrow(slices, "path string, t int, shape array<int>, data array<double>")


def cells_of(df: DataFrame) -> DataFrame:
    """Records of rank 2 grids (y, x) as cells ``(path, t, y, x, value)``."""
    width = F.element_at("shape", -1)
    return df.select("path", "t", "shape", F.posexplode("data").alias("i", "value")).select("path", "t", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "value")


#: Names of the dimensions of time, level, latitude and longitude.
_AXES = (("t", r"tim"), ("z", r"p?lev"), ("y", r"lat"), ("x", r"lon"))


def epoch_of(units: str, calendar: str = "gregorian") -> tuple[float, float]:
    """``(factor, base)`` with value * factor + base in milliseconds since 1970-01-01 of the calendar, for units such as days since 1850-01-01."""
    found = parse_unit(units)
    if not found or found[0] != "time":
        raise ValueError(f"no unit of time: {units}")
    factor, base = found[1] * 60_000, found[2] * 60_000
    kind = calendar.strip().lower().replace(" ", "_")
    if kind in GREGORIAN:
        return factor, base
    if kind not in YEAR_DAYS:
        raise ValueError(f"no calendar: {calendar}")
    n = YEAR_DAYS[kind]
    y, m, d = (int(x) for x in re.search(r"since\s+(-?\d{1,4})-(\d{1,2})-(\d{1,2})", units).groups())
    months = [31, 29 if n == 366 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31] if n != 360 else [30] * 12
    return factor, float((y - 1970) * n + sum(months[: m - 1]) + d - 1) * 86_400_000 + base % 86_400_000


def cube_of(spark: SparkSession, paths: list[str], variable: str, steps: int = 256) -> Cube:
    """The variable of a set of files as a cube with one series of steps, in order of the files' times.

    Latitudes, longitudes and levels come from the first file with the variable; each file's times from its own time variable, with
    the bounds that it names as start and end. Files must have one grid. Only headers and axes reach the driver.
    """
    if not paths:
        raise ValueError("no files")
    head = next((h for h in (read_header(p) for p in paths) if variable in h.variables), None)
    if head is None:
        raise ValueError(f"no variable {variable}")
    home = next(p for p in paths if variable in read_header(p).variables)
    own = head.variables[variable]
    axes = [next((a for a, pattern in _AXES if re.match(pattern, d.lower())), None) for d in own.dims]
    if None in axes or axes[0] != "t" or len(set(axes)) < len(axes):
        raise ValueError(f"axes must be time, level, latitude and longitude: {own.dims}")
    tables = {a: read_values(home, head, d).tolist() if d in head.variables else [float(k) for k in range(head.dims[d])] for a, d in zip(axes[1:], own.dims[1:])}
    time = own.dims[0]
    calendar = str((head.variables[time].attributes if time in head.variables else {}).get("calendar", "gregorian"))

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                h = read_header(p)
                if variable not in h.variables or time not in h.variables:
                    continue
                v = h.variables[time]
                factor, base = epoch_of(str(v.attributes.get("units", "")), calendar)
                at = read_values(p, h, time) * factor + base
                bounds = v.attributes.get("bounds")
                ends = read_slices(p, h, bounds, 0, len(at)) * factor + base if bounds in h.variables else np.c_[at, np.r_[at[1:], at[-1:] + (at[-1] - at[-2] if len(at) > 1 else 0)]]
                yield pd.DataFrame({"path": p, "k": np.arange(len(at), dtype=np.int32), "start_ms": ends[:, 0].astype(np.int64), "end_ms": ends[:, 1].astype(np.int64)})

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism * 3), "path")
    stamps = listed.mapInPandas(times, "path string, k int, start_ms bigint, end_ms bigint")
    per_file = stamps.groupBy("path").agg(F.min("start_ms").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row a file: the number of steps in the files before it
    before = Window.orderBy("_first", "path").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("path", "_before")
    rows = records(spark, paths, variable, steps).withColumnRenamed("t", "k").join(stamps, ["path", "k"]).join(per_file, "path")
    cells = rows.select((F.col("_before") + F.col("k")).cast("int").alias("t"), "start_ms", "end_ms", F.posexplode("data").alias("_i", "value"))
    columns, size = [], 1
    for a in reversed(axes[1:]):
        n = len(tables[a])
        index = F.floor(F.col("_i") / size) % n
        columns = [index.cast("int").alias(a), F.element_at(F.array(*[F.lit(float(v)) for v in tables[a]]), (index + 1).cast("int")).alias({"z": "lev", "y": "lat", "x": "lon"}[a]), *columns]
        size *= n
    clock = lambda c: F.timestamp_millis(c).cast("timestamp_ntz") if calendar.strip().lower() in GREGORIAN else F.col(c)
    times_of = [clock("start_ms").alias("time"), clock("end_ms").alias("time_end")]
    coords = ("time", "time_end", *({"z": "lev", "y": "lat", "x": "lon"}[a] for a in axes[1:]))
    return Cube(cells.select("t", *columns, *times_of, "value"), tuple(axes), (), coords, axis_values=tables, calendar=calendar)


def write_cube(cube: Cube, folder: str, name: str, steps: int = 256, missing: float = 1e20) -> DataFrame:
    """Write a cube without tags as files of up to ``steps`` time steps each under ``folder``, which all executors see; ``(path, first, n)`` of each file, in any order.

    A file holds the coordinates of its axes and the variable ``name`` with ``missing`` for missing cells. Each file is made by one task
    of its steps only, whatever the length of the cube.
    """
    if cube.tags or "t" not in cube.axes:
        raise ValueError("a cube to be written has the axis t and no tags")
    tables = {a: cube.axis_values.get(a) for a in cube.axes if a != "t"}
    if any(v is None for v in tables.values()):
        raise ValueError("the coordinates of the axes must be known")
    tables = {a: dict(enumerate(v)) if isinstance(v, list) else v for a, v in tables.items()}
    order = [a for a in "zyx" if a in tables]
    long = {"z": "lev", "y": "lat", "x": "lon"}
    has_time = "time" in cube.coords and cube.calendar.strip().lower() in GREGORIAN

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = t.column("t").to_numpy()
        first, n = int(at.min()), int(at.max() - at.min()) + 1
        shape = [n, *(len(tables[a]) for a in order)]
        x = np.full(shape, missing)
        place = [at - first]
        for a in order:
            place.append(np.searchsorted(list(tables[a]), t.column(a).to_numpy()))
        v = t.column("value").to_numpy(zero_copy_only=False)
        x[tuple(place)] = np.where(np.isnan(v), missing, v)
        times = np.arange(first, first + n, dtype=float)
        if has_time:
            times[at - first] = t.column("_ms").to_numpy() / 60_000
        path = f"{folder}/{name}-{first:010d}.nc"
        units = {"units": "minutes since 1970-01-01"} if has_time else {}
        write_file(path, {"time": 0, **{long[a]: len(tables[a]) for a in order}}, {**{long[a]: ([long[a]], np.array(list(tables[a].values())), {}) for a in order}, "time": (["time"], times, units), name: (["time", *(long[a] for a in order)], x, {"missing_value": missing})})
        return pa.table({"path": [path], "first": pa.array([first], pa.int32()), "n": pa.array([n], pa.int32())})

    millis = F.unix_millis(F.col("time").cast("timestamp")) if has_time else F.lit(0).cast("long")
    df = cube.df.select("t", *order, F.col(cube.value).cast("double").alias("value"), millis.alias("_ms"))
    return df.groupBy(F.floor(F.col("t") / steps).alias("_file")).applyInArrow(run, "path string, first int, n int")


def write_file(path: str, dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None) -> None:
    """A CDF-2 file of double variables; ``dims`` gives each length, 0 for the record dimension. For results of the size of one request."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def attrs(a: dict) -> bytes:
        if not a:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", _ATTRIBUTE, len(a))
        for k, v in a.items():
            out += text(k)
            out += struct.pack(">ii", 2, len(v.encode())) + pad(v.encode()) if isinstance(v, str) else struct.pack(">ii", 6, 1) + struct.pack(">d", float(v))
        return out

    names = list(dims)
    growing = [k for k, v in variables.items() if v[0] and dims[v[0][0]] == 0]
    n_records = len(variables[growing[0]][1]) if growing else 0
    sizes = {k: 8 * math.prod(v[1].shape[1:] if k in growing else v[1].shape) for k, v in variables.items()}

    def head(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", n_records) + struct.pack(">ii", _DIMENSION if dims else 0, len(dims))
        for k, n in dims.items():
            out += text(k) + struct.pack(">i", n)
        out += attrs(attributes or {}) + struct.pack(">ii", _VARIABLE if variables else 0, len(variables))
        for k, (own, _, a) in variables.items():
            out += text(k) + struct.pack(">i", len(own)) + b"".join(struct.pack(">i", names.index(x)) for x in own) + attrs(a) + struct.pack(">iiq", 6, sizes[k], begins[k])
        return out

    at = len(head(dict.fromkeys(variables, 0)))
    begins = {}
    fixed = [k for k in variables if k not in growing]
    for k in [*fixed, *growing]:
        begins[k] = at
        at += sizes[k]
    with created(path) as f:
        f.write(head(begins))
        for k in fixed:
            f.write(np.asarray(variables[k][1], ">f8").tobytes())
        for t in range(n_records):
            for k in growing:
                f.write(np.asarray(variables[k][1][t], ">f8").tobytes())
