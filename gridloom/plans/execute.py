"""From a bound request to lazy results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from gridloom.operators import cube as C
from gridloom.operators.cube import Cube
from gridloom.operators.regrid import axis_grid, onto, target_grid
from gridloom.plans.kernels import GRID_KEYS, Context, Result, find
from gridloom.plans.request import Domain, bind, parse

Load = Callable[[str, str], Cube]


def _inside(cube: Cube, domain: Domain, masks: dict) -> Cube:
    """The cells of a domain; of a domain's spans those count whose axes the cube has."""
    cube = C.subset(cube, [s for s in domain.spans if s.axis in cube.axes])
    if domain.mask is None:
        return cube
    if domain.mask not in masks:
        raise ValueError(f"no mask {domain.mask}")
    return C.masked(cube, masks[domain.mask])


def _shown(result: Cube | DataFrame) -> DataFrame:
    return result.cells() if isinstance(result, Cube) else result


def execute(text: str, load: Load, catalog=None, masks: dict | None = None, run: dict | None = None) -> dict[str, DataFrame]:
    """The results of a request by operation id, for operations that no other consumes; ``load(collection, variable)`` gives a lazy cube.

    An operator with several results gives them as ``id.name``, and others may take them as inputs under that name. Every node is
    planned once, whoever uses it; nothing runs before a result is written or collected. An operation with ``grid``, or with a
    ``crs`` such as ~v1 (an input, or a collection, by whose grid the inputs are meant), has its inputs regridded first; inputs
    already on that grid stay as they are. Settings that a kernel doesn't read are an error, and so are index domains over inputs of
    different collections. ``masks`` holds polygons by name. ``run`` holds settings of the run: responseform ``collection[:name]``
    saves each result to ``catalog``, which then holds it under that name (or the operation's id), and savelocalfile does so beside
    giving the result.
    """
    req, masks = bind(parse(text)), {k.lower(): v for k, v in (masks or {}).items()}
    run = {k.lower(): str(v) for k, v in (run or {}).items()}
    nodes: dict[str, Result] = {}
    homes: dict[str, str] = {}
    for uid, (place, name) in req.variables.items():
        cube = load(place, name)
        homes[uid] = place.lower()
        nodes[uid] = _inside(cube, req.domains[req.variable_domain[uid]], masks) if uid in req.variable_domain else cube
    grids = {}
    for uid in req.variables:
        if isinstance(nodes[uid], Cube) and {"y", "x"} <= set(nodes[uid].axes):
            grids[uid] = nodes[uid]
    used = set()
    for o in req.operations:
        k = find(o.name)
        domain = req.domains[o.domain] if o.domain else None
        own = {homes[i] for i in o.inputs if i in homes}
        if domain and len(own) > 1 and any(s.system == "indices" and s.start is not None for s in domain.spans):
            raise ValueError("indices mean different places in different collections; use values")
        inputs = []
        for i in o.inputs:
            used.add(i.partition(".")[0] if i not in nodes else i)
            cube = _picked(nodes, i)
            if domain and i in req.variables and req.variable_domain.get(i) != o.domain:
                cube = _inside(cube, domain, masks)
            inputs.append(cube)
        context = Context(list(o.inputs), _Grids(grids, homes), catalog)
        config = dict(o.config)
        if k.name != "cube.regrid" and ("grid" in config or str(config.get("crs", "")).startswith("~")):
            asked = {a: config.pop(a) for a in (*GRID_KEYS, "crs") if a in config and (a not in k.keys or a in ("grid", "crs", "shape", "res", "origin"))}
            inputs = [onto(c, target_grid(asked, axis_grid(c), context.grids)) if {"y", "x"} <= set(c.axes) else c for c in inputs]
        elif "crs" in config and k.name != "cube.regrid":
            raise ValueError("crs must begin with ~ and name an input or a collection")
        if unknown := set(config) - set(k.keys):
            raise ValueError(f"{k.name} has no setting {', '.join(sorted(unknown))}")
        if k.inputs == "2+" and len(inputs) < 2:
            raise ValueError(f"{k.name} needs two or more inputs")
        nodes[o.id] = k.run(inputs, config, context)
    out: dict[str, DataFrame] = {}
    form, _, wanted = run.get("responseform", "object").partition(":")
    for o in req.operations:
        if o.id in used:
            continue
        result = nodes[o.id]
        for name, part in result.items() if isinstance(result, dict) else [("", result)]:
            out[f"{o.id}.{name}" if name else o.id] = _shown(part)
            if form == "collection" or run.get("savelocalfile", "").lower() == "true":
                if catalog is None:
                    raise ValueError("a catalog is needed to keep results")
                kept = part if isinstance(part, Cube) else Cube(part.withColumnRenamed(part.columns[-1], "value"), (), tuple(part.columns[:-1]))
                catalog.save("-".join(x for x in (wanted or o.id, name) if x), replace(kept, more=()))
    return out


def _picked(nodes: dict[str, Result], i: str) -> Cube:
    """The cube of an input, which may be one of several results of an operation."""
    result = nodes[i] if i in nodes else nodes[i.partition(".")[0]]
    if isinstance(result, dict):
        name = i.partition(".")[2]
        result = result[name] if name in result else next(iter(result.values()))
    if not isinstance(result, Cube):
        raise ValueError(f"{i} is a table, not a cube")
    return result


class _Grids(dict):
    """Grids of the inputs by id or collection, found when asked for."""

    def __init__(self, cubes: dict[str, Cube], homes: dict[str, str]):
        super().__init__()
        self.cubes = {**{homes[u]: c for u, c in reversed(cubes.items())}, **cubes}

    def __missing__(self, name: str) -> tuple[list[float], list[float]]:
        if "/" in name and self.cubes:  # a table of axes that a catalogue wrote
            rows = next(iter(self.cubes.values())).df.sparkSession.read.parquet(name).where("axis in ('y', 'x')").collect()
            self[name] = tuple({r["index"]: r["value"] for r in sorted(rows, key=lambda r: r["index"]) if r["axis"] == a} for a in "yx")
            return self[name]
        if name not in self.cubes:
            raise ValueError(f"no grid of {name}")
        self[name] = axis_grid(self.cubes[name])
        return self[name]
