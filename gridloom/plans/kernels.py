"""Named operators for requests: a registry that users can extend, and the kernels of the library."""

from __future__ import annotations

import importlib
import os
import pkgutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import cube as C
from gridloom.operators.cube import Cube, Span
from gridloom.operators.linalg import Eof
from gridloom.operators.regrid import grid_of, onto, target_grid

#: What an operator may give: one cube or table, or several by name.
Result = Cube | DataFrame | dict[str, Cube | DataFrame]


@dataclass
class Context:
    """What a kernel sees beside its inputs: their ids, the grids of all inputs of the request by id, and the catalog to write to."""

    inputs: list[str] = field(default_factory=list)
    grids: dict[str, tuple[list[float], list[float]]] = field(default_factory=dict)
    catalog: object = None


@dataclass(frozen=True)
class Kernel:
    """A registered operator: ``run(inputs, config, context)``; ``keys`` are the settings that it reads, ``outputs`` the names of its results."""

    name: str
    title: str
    inputs: str
    visibility: str
    run: Callable[[list[Cube], dict, Context], Result]
    keys: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ("value",)
    description: str = ""


REGISTRY: dict[str, Kernel] = {}
LEVELS = ["experimental", "developmental", "restricted", "public"]
#: Settings that put a regridding before a kernel, and those that say how.
GRID_KEYS = ("grid", "shape", "res", "origin", "target", "gridspec", "gridsection", "regridtool", "method")


def kernel(name: str, title: str, inputs: str = "1+", visibility: str = "public", keys: tuple[str, ...] = (), outputs: tuple[str, ...] = ("value",)):
    """Register a function of cubes, configuration and context as an operator for requests."""
    if visibility not in LEVELS:
        raise ValueError(f"no visibility: {visibility}")

    def add(f):
        REGISTRY[name.lower()] = Kernel(name, title, inputs, visibility, f, keys, outputs, (f.__doc__ or "").strip())
        return f

    return add


def stacked(cubes: list[Cube], ids: list[str]) -> Cube:
    """Several inputs as one cube with the tag ``input``, the id of each; a single one as it is. They must have the same keys."""
    if len(cubes) == 1:
        return cubes[0]
    first = cubes[0]
    if any(set(c.keys) != set(first.keys) for c in cubes):
        raise ValueError("inputs of one operator must have the same axes")
    coords = tuple(c for c in first.coords if all(c in x.coords for x in cubes))
    cells = [c.df.select(F.lit(i).alias("input"), *first.keys, *coords, F.col(c.value).alias("value")) for c, i in zip(cubes, ids)]
    return replace(first, df=fold(DataFrame.unionByName, cells), tags=("input", *first.tags), coords=coords, value="value", more=())


def reducing(name: str, title: str, agg: Callable[[Column], Column], visibility: str = "public") -> None:
    """Register a reduction over ``axes`` and calendar groups from an aggregate of the values; it takes any number of inputs, each reduced by itself."""
    C.REDUCTIONS[name.rpartition(".")[2].lower()] = agg
    _register_reduction(name, title, name.rpartition(".")[2].lower(), visibility)


def combining(name: str, title: str, f: Callable[[Column, Column], Column], visibility: str = "public") -> None:
    """Register a cell by cell operator of two or more inputs."""
    op = name.rpartition(".")[2].lower()
    C.ELEMENTWISE[op] = f
    kernel(name, title, "2+", visibility)(lambda cubes, cfg, ctx: C.combined(op, cubes))


def macro(name: str, title: str, steps: Callable[[Cube, dict], Cube], keys: tuple[str, ...] = (), visibility: str = "public") -> None:
    """Register an operator made of others: a function of the stacked input and the configuration."""
    kernel(name, title, "1+", visibility, keys)(lambda cubes, cfg, ctx: steps(stacked(cubes, ctx.inputs), cfg))


def record_udf(name: str, title: str, f: Callable[[pd.DataFrame], pd.DataFrame], visibility: str = "developmental") -> None:
    """Register a Python function from cells to cells, which runs on Arrow batches; it may change values and drop cells, not keys."""

    def run(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
        cube = stacked(cubes, ctx.inputs)
        df = cube.df.select(*cube.keys, *cube.coords, F.col(cube.value).cast("double").alias("value"))

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield f(part)

        return replace(cube, df=df.mapInPandas(batches, df.schema), value="value", more=())

    kernel(name, title, "1+", visibility)(run)


def reduce_udf(name: str, title: str, f: Callable[[pd.Series], float], merge: Callable[[pd.Series], float] | None = None, visibility: str = "developmental") -> None:
    """Register a Python reduction of the values of a group (missing ones left out).

    With ``merge``, which reduces results of parts, each group is reduced in parts first, so no task sees a whole hot group.
    """

    def run(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
        cube = stacked(cubes, ctx.inputs)
        out = C._without(cube, str(cfg.get("axes", "")))
        df = cube.df.where(F.col(cube.value).isNotNull()).select(*out.keys, *out.coords, F.col(cube.value).cast("double").alias("value"))
        by = [*out.keys, *out.coords]
        whole, parts = F.pandas_udf(_plain(f), "double"), F.pandas_udf(_plain(merge or f), "double")
        if merge:
            df = df.withColumn("_part", F.spark_partition_id()).groupBy(*by, "_part").agg(whole("value").alias("value"))
        return replace(out, df=df.groupBy(*by).agg((parts if merge else whole)("value").alias("value")), value="value")

    kernel(name, title, "1+", visibility, ("axes",))(run)


def _plain(f: Callable[[pd.Series], float]) -> Callable[[pd.Series], float]:
    """``f`` with the hints that mark a reduction."""

    def call(v: pd.Series) -> float:
        return f(v)

    call.__annotations__ = {"v": pd.Series, "return": float}
    return call


def discovered(package: str | None = None) -> list[str]:
    """Import all modules of a package, or of those that GRIDLOOM_KERNELS names (separated by commas), so that they register their kernels; the names registered."""
    before = set(REGISTRY)
    for name in [package] if package else [x.strip() for x in os.environ.get("GRIDLOOM_KERNELS", "").split(",") if x.strip()]:
        top = importlib.import_module(name)
        for m in pkgutil.iter_modules(getattr(top, "__path__", [])):
            importlib.import_module(f"{name}.{m.name}")
    return sorted(set(REGISTRY) - before)


# reductions and combinations
def _register_reduction(name: str, title: str, op: str, visibility: str) -> None:
    @kernel(name, title, "1+", visibility, ("axes", "groupby", "weights"))
    def run(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
        return C.reduced(stacked(cubes, ctx.inputs), op, str(cfg.get("axes", "")), cfg.get("weights"), cfg.get("groupby"))


for _op, _title in {"max": "Maximum", "min": "Minimum", "sum": "Sum", "ave": "Mean, optionally weighted", "rms": "Root mean square over n-1", "rmsum": "Root of the sum over n-1", "std": "Population deviation", "var": "Population variance", "ptp": "Range", "stddev": "Sample deviation", "maxmag": "Value of greatest magnitude", "minmag": "Value of least magnitude", "count": "Number of values"}.items():
    _register_reduction(f"cube.{_op}", _title, _op, "developmental" if _op == "rmsum" else "public")
for _op in list(C.ELEMENTWISE):
    kernel(f"cube.e{_op}", f"Cell by cell {_op}", "2+")(lambda cubes, cfg, ctx, op=_op: C.combined(op, cubes))


@kernel("cube.subset", "Subset to the domain", keys=("plev", "levels"))
@kernel("cube.noop", "Subset to the domain")
def _noop(cubes: list[Cube], cfg: dict, ctx: Context) -> Result:
    cube = stacked(cubes, ctx.inputs)
    return C.subset(cube, [Span("z", levels=_numbers(cfg.get("plev", cfg.get("levels"))))]) if set(cfg) & {"plev", "levels"} else cube


@kernel("cube.compress", "Keep the listed levels", keys=("plev",))
@kernel("cube.filter", "Keep the listed levels", keys=("plev",))
def _levels(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.subset(stacked(cubes, ctx.inputs), [Span("z", levels=_numbers(cfg.get("plev")))])


def _numbers(v: object) -> tuple[float, ...]:
    """The numbers of a setting: a list, or a text with commas."""
    return tuple(float(x) for x in (v if isinstance(v, list) else str(v).split(",")) if str(x).strip()) if v is not None else ()


@kernel("cube.const", "Each value that isn't missing set to a number", keys=("value",))
def _const(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.with_scalar(stacked(cubes, ctx.inputs), "const", float(cfg["value"]))


for _op in ("sum", "diff", "mult", "div", "min", "max"):
    kernel(f"cube.s{_op}", f"Each value and a number: {_op}", keys=("value",))(lambda cubes, cfg, ctx, op=_op: C.with_scalar(stacked(cubes, ctx.inputs), op, float(cfg["value"])))


@kernel("cube.eave", "Mean over inputs, cell by cell", "2+", outputs=("value", "sum", "count"))
def _eave(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    coords = tuple(c for c in cubes[0].coords if all(c in x.coords for x in cubes))
    cells = fold(DataFrame.unionByName, [c.df.select(*cubes[0].keys, *coords, F.col(c.value).alias("value")) for c in cubes])
    v = F.col("value")
    # coordinates follow from the keys; the least of them stands for all
    stats = [F.min(c).alias(c) for c in coords]
    df = cells.groupBy(*cubes[0].keys).agg(*stats, F.avg(v).alias("_ave"), F.sum(v).alias("sum"), F.count(v).alias("count")).withColumnRenamed("_ave", "value")
    return replace(cubes[0], df=df, coords=coords, value="value", more=("sum", "count"))


@kernel("cube.anomaly", "Departure from the mean or from the calendar bin's mean", keys=("axes", "groupby", "weights"))
def _anomaly(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.anomaly(stacked(cubes, ctx.inputs), str(cfg.get("axes", "t")), cfg.get("groupby"), cfg.get("weights"))


def _group(cfg: dict) -> str:
    if "groupby" not in cfg:
        raise ValueError("lowpass and highpass need groupBy")
    return str(cfg["groupby"])


@kernel("cube.lowpass", "Means of calendar bins joined by lines", keys=("groupby",))
def _lowpass(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.lowpass(stacked(cubes, ctx.inputs), _group(cfg))


@kernel("cube.highpass", "Departure from the lowpass", keys=("groupby",))
def _highpass(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.highpass(stacked(cubes, ctx.inputs), _group(cfg))


@kernel("cube.rescale", "Standard scores per cell", "1+", "restricted", ("axes",))
@kernel("cube.norm", "Standard scores per cell", "1+", "developmental", ("axes",))
def _rescale(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.rescaled(stacked(cubes, ctx.inputs), str(cfg.get("axes", "t")))


@kernel("cube.cor", "Correlation of each pair of inputs or members", "1+", "developmental", outputs=("corr", "n"))
def _cor(cubes: list[Cube], cfg: dict, ctx: Context) -> DataFrame:
    cube = stacked(cubes, ctx.inputs)
    return C.correlations(replace(cube, df=cube.df.withColumn("member", F.concat_ws(".", *cube.tags)).drop(*[t for t in cube.tags if t != "member"]), tags=("member",)))


@kernel("cube.svd", "Leading modes of variation of the records", "1+", "restricted", ("modes", "norm", "compu"), ("maps", "components", "fractions"))
def _svd(cubes: list[Cube], cfg: dict, ctx: Context) -> dict[str, DataFrame]:
    """Cells of all inputs and members together form a record for each step t, or each calendar bin. ``maps`` has the loadings of each mode, ``components`` its series (unless compu is false), ``fractions`` its eigenvalue and share of the variance in percent."""
    cube = stacked(cubes, ctx.inputs)
    yes = lambda k: str(cfg.get(k, "true")).lower() != "false"
    row = "t" if "t" in cube.axes else "bin"
    if row not in cube.keys:
        raise ValueError("svd needs records along time")
    e = Eof.fit(cube.df, row, [k for k in cube.keys if k != row], cube.value, int(cfg.get("modes", 9)), scale=yes("norm"))
    rows = [(k, float(v), float(f) * 100) for k, (v, f) in enumerate(zip(e.values, e.variance_fractions()))]
    out = {"maps": e.maps(), "fractions": cube.df.sparkSession.createDataFrame(rows, "mode int, eigenvalue double, percent double")}
    return {**out, "components": e.components()} if yes("compu") else out


@kernel("cube.regrid", "Interpolation onto another grid", keys=(*GRID_KEYS, "crs"))
def _regrid(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return stacked([onto(c, target_grid(cfg, grid_of(c), ctx.grids)) for c in cubes], ctx.inputs)


@kernel("cube.ensemblestats", "Mean and deviation over inputs on the grid of one of them", "2+", "developmental", ("target", "plev", *[k for k in GRID_KEYS if k != "target"]), ("ave", "std"))
def _ensemble_stats(cubes: list[Cube], cfg: dict, ctx: Context) -> dict[str, Cube]:
    """Picks the levels ``plev``, brings all inputs to the grid of the input ``target``, and gives the mean and the population deviation over inputs."""
    if str(cfg.get("target", "")).lower() not in ctx.inputs:
        raise ValueError("target must name the input whose grid counts")
    home = cubes[ctx.inputs.index(str(cfg["target"]).lower())]
    levels = _numbers(cfg.get("plev"))
    picked = [C.subset(c, [Span("z", levels=levels)]) if levels else c for c in cubes]
    same = [onto(c, grid_of(home)) for c in picked]
    stats = C.ensemble(same, ("ave", "std"))
    return {s: replace(home, df=stats.select(*same[0].keys, F.col(s).alias("value")), coords=(), value="value", more=()) for s in ("ave", "std")}


@kernel("cube.zademo", "Zonal mean of a season's climate", keys=("season",))
def _zonal(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    return C.reduced(C.subset(stacked(cubes, ctx.inputs), [Span("t", season=str(cfg.get("season", "DJF")))]), "ave", "tx")


@kernel("cube.write", "Write the input as a collection and pass it on", "1+", "restricted", ("collection", "groupby"))
def _write(cubes: list[Cube], cfg: dict, ctx: Context) -> Cube:
    """The collection is called by the setting ``collection``, or like the first input; with ``groupBy`` it has a folder for each calendar bin."""
    cube = stacked(cubes, ctx.inputs)
    if ctx.catalog is None:
        raise ValueError("write needs a catalog")
    name = str(cfg.get("collection", ctx.inputs[0]))
    if group := cfg.get("groupby"):
        ctx.catalog.save(name, replace(cube, df=cube.df.withColumn("bin", cube.bin_of(str(group))), tags=(*cube.tags, "bin"), bins=str(group)), "bin")
    else:
        ctx.catalog.save(name, cube)
    return cube


#: Names of older clients.
ALIASES = {"binave": "ave", "average": "ave", "avew": "ave", "multiaverage": "eave", "diff2": "ediff"}


def find(name: str) -> Kernel:
    """The kernel of a name, or of its last part under any module prefix."""
    last = name.lower().rpartition(".")[2]
    own = REGISTRY.get(name.lower()) or REGISTRY.get(f"cube.{ALIASES.get(last, last)}")
    if own is None:
        raise ValueError(f"no kernel {name}")
    return own


def capabilities(least: str = "experimental") -> list[tuple[str, str, str, str]]:
    """``(name, title, inputs, visibility)`` of the kernels of at least that status."""
    return sorted((k.name, k.title, k.inputs, k.visibility) for k in REGISTRY.values() if LEVELS.index(k.visibility) >= LEVELS.index(least))


def modules() -> list[tuple[str, int]]:
    """``(module, kernels)``: the prefixes of kernel names and how many kernels each has."""
    names = [k.name.rpartition(".")[0] for k in REGISTRY.values()]
    return sorted((m, names.count(m)) for m in set(names))


def describe(name: str) -> dict:
    """Title, description, inputs, settings and outputs of a kernel."""
    k = find(name)
    return {"name": k.name, "title": k.title, "description": k.description, "inputs": k.inputs, "settings": list(k.keys), "outputs": list(k.outputs), "visibility": k.visibility}
