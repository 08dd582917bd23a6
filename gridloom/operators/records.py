"""Operators over records, which hold named arrays (``elements map<string, struct<missing, shape, origin, data>>``), and over sections, ranges and metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# elements
def elements_where(elements: Column, keep: Callable[[Column], Column]) -> Column:
    """The elements whose key satisfies ``keep``."""
    return F.map_filter(elements, lambda k, v: keep(k))


def elements_renamed(elements: Column, names: dict[str, str]) -> Column:
    """The elements with new keys where ``names`` has the old one; if two meet in one key, the last in order of old keys stays."""
    if not names:
        return elements
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    entries = F.array_sort(F.map_entries(elements), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return _from_entries(F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at(table, e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))


def elements_without(elements: Column, *names: str) -> Column:
    return F.map_filter(elements, lambda k, v: ~k.isin(*names)) if names else elements


def elements_merged(left: Column, right: Column) -> Column:
    """All elements of both; of equal keys the right one. A null map holds none."""
    empty = lambda x: F.coalesce(F.map_entries(x), F.array())
    taken = F.coalesce(F.map_keys(right), F.array())
    return F.map_from_entries(F.concat(F.filter(empty(left), lambda e: ~F.array_contains(taken, e["key"])), empty(right)))


def _from_entries(entries: Column) -> Column:
    """A map of entries, the last of equal keys counting."""
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])))


def by_shape(elements: Column) -> Column:
    """``map<shape text, array of keys>``: the elements parted by the shape of their arrays, keys in order."""
    shapes = F.transform(F.map_entries(elements), lambda e: F.struct(F.array_join(e["value"]["shape"].cast("array<string>"), "x").alias("s"), e["key"].alias("k")))
    kinds = F.array_sort(F.array_distinct(F.transform(shapes, lambda x: x["s"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda s: F.array_sort(F.transform(F.filter(shapes, lambda x: x["s"] == s), lambda x: x["k"]))))


def valid(spec: Column) -> Column:
    """The data of an array with its missing values (the sentinel, NaN, null) as null, in doubles."""
    return F.transform(spec["data"], lambda x: F.when(~F.isnan(x) & (spec["missing"].isNull() | F.isnan(spec["missing"]) | (x != spec["missing"])), x.cast("double")))


def array_with(op: str, a: Column, b: Column | float) -> Column:
    """Two arrays element by element, or an array and a number, under sum, diff, mult or div; missing if either is missing, or the divisor is 0."""
    f = {"sum": lambda x, y: x + y, "diff": lambda x, y: x - y, "mult": lambda x, y: x * y, "div": lambda x, y: F.when(y != 0, x / y)}[op]
    if isinstance(b, Column):
        return F.zip_with(a, b, f)
    return F.transform(a, lambda x: f(x, F.lit(float(b))))


def array_reduced(op: str, a: Column) -> Column:
    """Sum, mean, maximum, minimum or count of an array without its missing values; null for none (count: 0)."""
    seen = F.filter(a, lambda x: x.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x)
    some = F.size(seen) > 0
    return {"sum": F.when(some, total), "ave": F.when(some, total / F.size(seen)), "max": F.array_max(seen), "min": F.array_min(seen), "count": F.size(seen)}[op]


def section_of(data: Column, shape: Column, origin: list[int], size: list[int]) -> Column:
    """The part of a row-major array of rank 1 or 2 from ``origin`` on with ``size`` entries along each axis, cut off at its ends."""
    if len(origin) == 1:
        return F.slice(data, origin[0] + 1, size[0])
    width = F.element_at(shape, -1)
    return F.filter(data, lambda x, i: F.floor(i / width).between(origin[0], origin[0] + size[0] - 1) & (i % width).between(origin[1], origin[1] + size[1] - 1))


def found_value(data: Column, value: float, eps: float = 1e-4) -> Column:
    """The first position whose value is within a relative distance ``eps`` of ``value``; -1 for none."""
    near = F.transform(data, lambda x: F.coalesce(F.abs(x - F.lit(value)) < F.lit(abs(value) * eps), F.lit(False)))
    return (F.array_position(near, True) - 1).cast("int")


def records_joined(left: DataFrame, right: DataFrame, on: list[str], elements: str = "elements") -> DataFrame:
    """Records of two tables with equal ``on``, with the elements of both (the right one's of equal keys); other columns come from the left."""
    b = right.select(*on, F.col(elements).alias("_right"))
    return left.join(b, on).withColumn(elements, elements_merged(F.col(elements), F.col("_right"))).drop("_right")


# sections: origins and shapes as arrays of one length
def section_intersection(origin_a: Column, shape_a: Column, origin_b: Column, shape_b: Column) -> Column:
    """``struct<origin, shape>`` of the common box of two sections, null if they have none."""
    low = F.zip_with(origin_a, origin_b, lambda a, b: F.greatest(a, b))
    high = F.zip_with(F.zip_with(origin_a, shape_a, lambda o, s: o + s), F.zip_with(origin_b, shape_b, lambda o, s: o + s), lambda a, b: F.least(a, b))
    shape = F.zip_with(low, high, lambda a, b: b - a)
    return F.when(~F.exists(shape, lambda n: n <= 0), F.struct(low.alias("origin"), shape.alias("shape")))


def section_union(origin_a: Column, shape_a: Column, origin_b: Column, shape_b: Column) -> Column:
    """``struct<origin, shape>`` of the least box around two sections."""
    low = F.zip_with(origin_a, origin_b, lambda a, b: F.least(a, b))
    high = F.zip_with(F.zip_with(origin_a, shape_a, lambda o, s: o + s), F.zip_with(origin_b, shape_b, lambda o, s: o + s), lambda a, b: F.greatest(a, b))
    return F.struct(low.alias("origin"), F.zip_with(low, high, lambda a, b: b - a).alias("shape"))


@dataclass(frozen=True)
class Section:
    """A box of indices at plan time."""

    origin: tuple[int, ...]
    shape: tuple[int, ...]

    @staticmethod
    def parse(text: str) -> Section:
        inner = text[text.index("{") + 1 : text.rindex("}")]
        return Section(*(tuple(int(x) for x in part.split(",")) for part in inner.split(":")))

    def __str__(self) -> str:
        return f"Section{{{','.join(map(str, self.origin))}:{','.join(map(str, self.shape))}}}"

    def _ends(self) -> list[int]:
        return [o + s for o, s in zip(self.origin, self.shape)]

    def union(self, other: Section) -> Section:
        low = tuple(map(min, self.origin, other.origin))
        return Section(low, tuple(max(a, b) - o for a, b, o in zip(self._ends(), other._ends(), low)))

    def intersection(self, other: Section) -> Section | None:
        low = tuple(map(max, self.origin, other.origin))
        shape = tuple(min(a, b) - o for a, b, o in zip(self._ends(), other._ends(), low))
        return Section(low, shape) if min(shape, default=0) > 0 else None


# ranges of time
def ranges_disjoint(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether one range ends before the other begins; ranges that share an end are not disjoint."""
    return (end_a < start_b) | (end_b < start_a)


def range_intersection(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """``struct<start, end>`` of the common part, null for disjoint ranges."""
    low, high = F.greatest(start_a, start_b), F.least(end_a, end_b)
    return F.when(~ranges_disjoint(start_a, end_a, start_b, end_b), F.struct(low.alias("start"), high.alias("end")))


def range_merge(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """``struct<start, end>`` around two ranges, null for disjoint ones."""
    return F.when(~ranges_disjoint(start_a, end_a, start_b, end_b), F.struct(F.least(start_a, start_b).alias("start"), F.greatest(end_a, end_b).alias("end")))


def range_place(start: Column, end: Column, at: Column | int) -> Column:
    """-1, 0 or 1: whether a point lies before, in or after a range, which holds its start and not its end."""
    point = F.lit(at) if isinstance(at, int) else at
    return F.when(point < start, -1).when((point >= end) & (end > start), 1).otherwise(0)


# metadata
def metadata_merged(op: str, left: Column, right: Column) -> Column:
    """The left map; where the right one has another value, ``op(left,right)``, or for ``roi`` the union of both sections."""
    other = lambda k: F.try_element_at(right, k)
    joined = lambda k, v: F.concat(F.lit(f"{op}("), v, F.lit(","), other(k), F.lit(")"))
    return F.transform_values(left, lambda k, v: F.when(other(k).isNull() | (other(k) == v), v).when(k == "roi", _roi(v, other(k))).otherwise(joined(k, v)))


def _roi(a: Column, b: Column) -> Column:
    numbers = lambda t, i: F.transform(F.split(F.split(F.regexp_extract(t, r"\{([^}]*)\}", 1), ":")[i], ","), lambda x: x.try_cast("int"))
    both = section_union(numbers(a, 0), numbers(a, 1), numbers(b, 0), numbers(b, 1))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return F.concat(F.lit("Section{"), text(both["origin"]), F.lit(":"), text(both["shape"]), F.lit("}"))


def merge_metadata(op: str, maps: list[dict[str, str]]) -> dict[str, str]:
    """As ``metadata_merged`` for maps at plan time, from left to right."""
    out = dict(maps[0]) if maps else {}
    for other in maps[1:]:
        for k, v in out.items():
            if k in other and other[k] != v:
                out[k] = str(Section.parse(v).union(Section.parse(other[k]))) if k == "roi" else f"{op}({v},{other[k]})"
    return out
