"""Collections of cubes in a shared folder: registration, ingest, results as collections, metadata queries."""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha1
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.cube import Cube
from gridloom.operators.drift import file_schemas
from gridloom.sources.netcdf3 import header_names
from gridloom.sources.tables import removed


@dataclass
class Catalog:
    """Collections by id. The entries are metadata only: one small JSON text each, kept by the driver."""

    folder: str
    entries: dict[str, dict] = field(default_factory=dict)

    def register(self, name: str, path: str, cube: Cube, title: str = "") -> None:
        tables = {a: {str(k): x for k, x in (enumerate(v) if isinstance(v, list) else v.items())} for a, v in cube.axis_values.items()}
        self.entries[name.lower()] = {"path": path, "axes": list(cube.axes), "tags": list(cube.tags), "coords": list(cube.coords), "value": cube.value, "more": list(cube.more), "axis_values": tables, "calendar": cube.calendar, "bins": cube.bins, "title": title}

    def save(self, name: str, cube: Cube, partition: str | None = None, title: str = "") -> str:
        """Write a cube as Parquet, optionally partitioned by a column such as a calendar bin, and register it. Rows are clustered by time, so time spans prune row groups; a large bin is split over several tasks."""
        path = f"{self.folder}/{name.lower()}"
        df = cube.cells()
        if partition:
            df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)
        elif "t" in cube.axes:
            df.sortWithinPartitions("t").write.mode("overwrite").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        self.register(name, path, cube, title)
        return path

    def load(self, spark: SparkSession, name: str) -> Cube:
        e = self.entries.get(name.lower())
        if e is None:
            raise ValueError(f"no collection {name}")
        tables = {a: {int(k): x for k, x in v.items()} for a, v in e.get("axis_values", {}).items()}
        return Cube(spark.read.parquet(e["path"]), tuple(e["axes"]), tuple(e["tags"]), tuple(e["coords"]), e["value"], tuple(e.get("more", ())), tables, e.get("calendar", "gregorian"), e.get("bins"))

    def loader(self, spark: SparkSession):
        """The ``load`` of requests: collections of this catalog, ``file:`` paths of NetCDF files (or Parquet tables of cells) and ``fragment:`` keys of kept fragments."""
        from gridloom.sources.netcdf3 import cube_of

        def load(place: str, name: str) -> Cube:
            scheme, colon, rest = place.partition(":")
            if not colon:
                return self.load(spark, place)
            if scheme == "file" and re.search(r"\.(nc|cdf)$", rest):
                return cube_of(spark, [rest], name)
            if scheme == "fragment":
                return self.load(spark, rest.strip("/"))
            df = spark.read.parquet(rest)
            axes = tuple(a for a in "tzyx" if a in df.columns)
            coords = tuple(x for x in ("time", "time_end", "lev", "lat", "lon") if x in df.columns)
            value = name if name in df.columns else "value"
            return Cube(df, axes, tuple(x for x in df.columns if x not in (*axes, *coords, value)), coords, value)

        return load

    def fragment(self, spark: SparkSession, collection: str, variable: str, cube: Cube) -> Cube:
        """A part of a collection, written once and found again under its collection, variable and the box that its plan asks for."""
        plan = cube.df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        key = f"{variable}-{collection}-{sha1(plan.encode()).hexdigest()[:16]}".lower()
        if key not in self.entries:
            self.save(key, cube, title="fragment")
        return self.load(spark, key)

    def save_grid(self, name: str, cube: Cube) -> str:
        """Write the axes of a cube, without data, as a table ``(axis, index, value, lo, hi)`` with the bounds of each cell."""
        from gridloom.operators.regrid import axis_table

        path = f"{self.folder}/{name.lower()}-grid"
        reduce(DataFrame.unionByName, [axis_table(cube, a) for a in cube.axes if a != "t"]).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    def drop(self, name: str, spark: SparkSession | None = None) -> None:
        """Forget a collection; with a session its files are deleted too."""
        e = self.entries.pop(name.lower(), None)
        if e and spark is not None:
            removed(spark, e["path"])

    def clear(self, spark: SparkSession | None = None, title: str | None = None) -> None:
        """Drop all collections, or those with a title, such as fragment."""
        for name in [n for n, e in self.entries.items() if title is None or e["title"] == title]:
            self.drop(name, spark)

    def store(self, spark: SparkSession) -> str:
        """Write the entries into the folder, so that ``Catalog.open`` finds them in another process."""
        path = f"{self.folder}/_entries"
        spark.createDataFrame([(self.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return path

    @staticmethod
    def loads(folder: str, text: str) -> Catalog:
        return Catalog(folder, json.loads(text))

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Catalog:
        """The catalog that was stored in a folder."""
        return Catalog.loads(folder, spark.read.text(f"{folder}/_entries").first()[0])

    def metadata(self, spark: SparkSession, what: str, jobs: Jobs | None = None) -> DataFrame:
        """What there is: ``ker`` kernels, ``op`` modules of kernels, ``col`` collections (``col:id`` the columns of one), ``var:id,...`` variables of collections, ``frag`` fragments, ``res`` or ``job`` results."""
        from gridloom.plans import kernels

        kind, _, names = what.lower().replace("|", ":").partition(":")
        if kind.startswith("ker"):
            return spark.createDataFrame(kernels.capabilities(), "name string, title string, inputs string, visibility string")
        if kind.startswith("op"):
            return spark.createDataFrame(kernels.modules(), "module string, kernels int")
        if kind.startswith("col") and not names:
            return spark.createDataFrame(self.listed(), "id string, title string, axes string, path string")
        if kind.startswith(("col", "var")) and names:
            rows = [(n, f.name, f.dataType.simpleString()) for n in names.split(",") for f in self.load(spark, n.strip()).df.schema.fields if kind.startswith("col") or f.name in (self.entries[n.strip()]["value"], *self.entries[n.strip()].get("more", ()))]
            return spark.createDataFrame(rows, "id string, name string, type string")
        if kind.startswith("frag"):
            return spark.createDataFrame([r for r in self.listed() if r[1] == "fragment"], "id string, title string, axes string, path string")
        if kind.startswith(("res", "job")):
            return spark.createDataFrame([(j, jobs.status(j)) for j in jobs.results] if jobs else [], "job string, status string")
        raise ValueError(f"no metadata: {what}")

    def listed(self) -> list[tuple[str, str, str, str]]:
        return sorted((n, e["title"], " ".join(e["axes"]), e["path"]) for n, e in self.entries.items())

    def ingest(self, spark: SparkSession, paths: list[str], pattern: str = ".*") -> dict[str, list[str]]:
        """Group Parquet or NetCDF files by identical sets of variables, read from their headers in parallel: group id to paths, which are the result."""
        chosen = [p for p in paths if re.search(pattern, p)]
        grids = [p for p in chosen if re.search(r"\.(nc|cdf)$", p)]
        heads = file_schemas(spark, [p for p in chosen if p not in set(grids)]).select("path", F.array_join(F.array_sort("names"), "-").alias("id"))
        if grids:
            heads = heads.unionByName(header_names(spark, grids).select("path", F.array_join(F.array_sort("names"), "-").alias("id")))
        return {r.id: sorted(r.paths) for r in heads.groupBy("id").agg(F.collect_list("path").alias("paths")).collect()}

    def ingest_lists(self, spark: SparkSession, lists: list[str], paths: list[str]) -> dict[str, dict[str, list[str]]]:
        """Many collections at once, from lists with id, pattern, title and folder: for each id the groups of its files among ``paths``."""
        return {r.id: self.ingest(spark, [p for p in paths if p.startswith(r.path)], r.pattern) for r in collection_list(spark, lists).collect()}

    def dumps(self) -> str:
        return json.dumps(self.entries, sort_keys=True)


#: The fields of the rows of an aggregation text, by their first letter.
AGGREGATION_ROWS = {"P": ["key", "value"], "A": ["name", "dods_name", "ctype", "shape", "units", "minval", "maxval"], "C": ["name", "shape"], "V": ["name", "full_name", "dods_name", "description", "shape", "resolution", "dims", "units"], "F": ["start_minutes", "n_rows", "path"]}


def aggregation_rows(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """The rows of one kind (P, A, C, V or F) of aggregation texts, one ``;``-separated row a line; missing fields are null."""
    part = F.split("value", r"\s*;\s*")
    names = AGGREGATION_ROWS[kind]
    return spark.read.text(paths).where(F.trim(part[0]) == kind).select(F.input_file_name().alias("agg_file"), *[F.nullif(F.trim(F.get(part, F.lit(k + 1))), F.lit("")).alias(n) for k, n in enumerate(names)])


def collection_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(id, pattern, title, path)`` of lists of collections with four comma-separated columns; lines that begin with # are left out."""
    part = F.split("value", r"\s*,\s*")
    return spark.read.text(paths).where(~F.ltrim("value").startswith("#") & (F.size(part) >= 4)).select(*[F.trim(part[k]).alias(n) for k, n in enumerate(("id", "pattern", "title", "path"))])


@dataclass
class Jobs:
    """Results of requests by id, the least recently used dropped beyond ``most``."""

    most: int = 128
    results: OrderedDict = field(default_factory=OrderedDict)

    def submit(self, run: Callable[[], DataFrame], job: str | None = None) -> str:
        job = job or uuid4().hex[:12]
        try:
            self.results[job] = ("planned", run())
        except Exception as e:  # a failed request is a result too
            self.results[job] = ("failed", str(e))
        while len(self.results) > self.most:
            self.results.popitem(last=False)
        return job

    def status(self, job: str) -> str:
        return self.results[job][0] if job in self.results else "unknown"

    def result(self, job: str) -> DataFrame:
        state, out = self.results[job]
        if state != "planned":
            raise ValueError(f"{job}: {out}")
        self.results.move_to_end(job)
        return out

    def clear(self) -> None:
        self.results.clear()
