"""Schemas that drift from file to file: an ordered report of changes, and one consistent table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.blocks import ranked
from gridloom.sources.tables import shared_checkpoints, written

#: Files per block when the headers of an aggregation are folded.
FILES = 4096

#: Numeric types from narrow to wide; the join of two is the wider one, but an int or long with a float needs a double.
LADDER = ["bool", "byte", "short", "int", "long", "float", "double"]


def promote(a: str | None, b: str | None) -> str | None:
    """The join of two types in the promotion lattice: null below all, string above all, unlike non-numeric types meet in string."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if a not in LADDER or b not in LADDER:
        return "string"
    low, high = sorted((a, b), key=LADDER.index)
    return "double" if high == "float" and low in ("int", "long") else high


def promoted(types: Column) -> Column:
    """As ``promote``, folded over an array column of type names (nulls in it are skipped; an empty array gives null)."""
    known = F.array(*[F.lit(x) for x in LADDER])
    seen = F.filter(types, lambda x: x.isNotNull())
    rank = F.array_max(F.transform(seen, lambda x: F.array_position(known, x)))
    whole = F.exists(seen, lambda x: x.isin("int", "long"))
    numeric = F.when((rank == LADDER.index("float") + 1) & whole, F.lit("double")).otherwise(F.element_at(known, rank.cast("int")))
    return F.when(F.size(seen) == 0, F.lit(None)).when(F.size(F.array_distinct(seen)) == 1, seen[0]).when(F.exists(seen, lambda x: ~x.isin(*LADDER)), F.lit("string")).otherwise(numeric)


def extents(text: Column) -> Column:
    """The numbers of a written list, as whole numbers with one space between; null for null, an empty text for a scalar."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)")), lambda x: x.cast("double").cast("long").cast("string")), " ")


def dimension_names(text: Column) -> Column:
    """The names of a written list in lower case with one space between; null for null, an empty text for a scalar."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([^\s,;()\[\]]+)")), " ")


def header_items(df: DataFrame, kind: str, name: str, full_name: str | None = None, dtype: str | None = None) -> DataFrame:
    """One row per distinct header entry: ``(kind, file_id, item_name, full_norm, dims, shape, dtype)``. Rows without a file or a name are no items.

    Entries of one file and item that still differ are merged where they are used: a null gives way to a known value, and of two
    known ones the greater text counts. Copies are dropped before the shuffle.
    """
    text = F.lit(None).cast("string")
    return (
        df.where(F.col("file_id").isNotNull() & F.col(name).isNotNull())
        .select(
            F.lit(kind).alias("kind"),
            "file_id",
            F.col(name).alias("item_name"),
            F.regexp_replace(F.lower(F.trim(full_name)), r"[\s_]+", " ").alias("full_norm") if full_name else text.alias("full_norm"),
            dimension_names(F.col("dims")).alias("dims"),
            extents(F.col("shape")).alias("shape"),
            F.lower(F.trim(dtype)).alias("dtype") if dtype else text.alias("dtype"),
        )
        .distinct()
    )


#: Columns of the rows that folding a block of files gives: ``tag`` is log, open, head or tail. A value that a block inherits is
#: named by the item of its first file that inherits it (``*_of``).
_ROW = ["tag", "agg_id", "block", "file_index", "file_id", "kind", "item_name", "change_type", "before", "after", "full_norm", "dims", "dims_of", "shape", "shape_of", "old_dims", "old_dims_of", "old_shape", "old_shape_of", "dtype", "union_dtype", "root"]
_ROW_TYPE = "tag string, agg_id string, block bigint, file_index int, file_id bigint, " + ", ".join(f"{c} string" for c in _ROW[5:])
_LOG = ["agg_id", "block", "file_index", "file_id", "kind", "item_name", "change_type", "before", "after", "union_dtype", "root"]
_LOG_TYPE = "agg_id string, block bigint, file_index int, file_id bigint, " + ", ".join(f"{c} string" for c in _LOG[4:])


class _Inherited(str):
    """The value that an item of a block's first file inherits from the block before; the text is the item's name."""


@dataclass
class _Item:
    """A header entry as a file shows it, and what is known of the item by then: dims and shape, the join of its types, and the item of the block's first file that it goes back to."""

    kind: str
    name: str
    full: str | None
    dims: str | None
    shape: str | None
    dtype: str | None
    union: str | None = None
    root: str | None = None

    def follow(self, before: _Item | None) -> None:
        """Take over what the item before knows."""
        self.union = self.dtype
        if before is not None:
            self.dims = before.dims if self.dims is None else self.dims
            self.shape = before.shape if self.shape is None else self.shape
            self.union, self.root = promote(before.union, self.dtype), before.root


Header = dict[tuple[str, str], _Item]


def _matched(now: Header, before: Header) -> list[tuple[_Item | None, _Item | None, str]]:
    """The entries of two successive headers in pairs, each with kept, renamed, added or removed; of one full name, names that leave and names that come are paired in order."""
    out, came, left = [], {}, {}
    for k, x in now.items():
        if k in before:
            out.append((x, before[k], "kept"))
        else:
            came.setdefault((x.kind, x.full) if x.kind == "V" and x.full is not None else k + ("",), []).append(x)
    for k, x in before.items():
        if k not in now:
            left.setdefault((x.kind, x.full) if x.kind == "V" and x.full is not None else k + ("",), []).append(x)
    for token in came.keys() | left.keys():
        for x, y in zip_longest(sorted(came.get(token, []), key=lambda i: i.name), sorted(left.get(token, []), key=lambda i: i.name)):
            out.append((x, y, "added" if y is None else "removed" if x is None else "renamed"))
    return out


def _still(shape: str, dims: str) -> list[str]:
    """The extents other than that of time."""
    extent, names = shape.split(), dims.split()
    return [e for e, n in zip(extent, names) if n != "time"] if len(extent) == len(names) else extent


def _altered(dims: str | None, old_dims: str | None, shape: str | None, old_shape: str | None) -> list[tuple[str, str, str]]:
    """``(change_type, before, after)`` of dims or shape; what was never known is not compared."""
    if dims is None or old_dims is None:
        return []
    if dims != old_dims:
        return [("dims", old_dims, dims)]
    if shape is None or old_shape is None or _still(shape, dims) == _still(old_shape, dims):
        return []
    return [("shape", old_shape, shape)]


def _stepped(now: Header, before: Header) -> Iterator[tuple[_Item, str, str | None, str | None, tuple | None]]:
    """One step of the fold: ``(item, change_type, before, after, open)`` for each difference, ordered; ``now`` takes over what was known.

    ``open`` holds the values of a comparison that needs something inherited (then there is no change type yet).
    """
    found = []
    for x, y, how in _matched(now, before):
        if x is None:
            found.append((y, "removed", y.name, None, None))
            continue
        x.follow(y)
        if how == "added":
            found.append((x, "added", None, x.name, None))
        if how == "renamed":
            found.append((x, "renamed", y.name, x.name, None))
        if y is None:
            continue
        if x.kind == "V" and x.dtype is not None and y.dtype is not None and x.dtype != y.dtype:
            found.append((x, "dtype", y.dtype, x.dtype, None))
        values = (x.dims, y.dims, x.shape, y.shape)
        if (x.dims, x.shape) != (y.dims, y.shape) or type(x.dims) is not type(y.dims) or type(x.shape) is not type(y.shape):
            if any(isinstance(v, _Inherited) for v in values):
                found.append((x, "", None, None, values))
            else:
                found += [(x, kind, old, new, None) for kind, old, new in _altered(*values)]
    return iter(sorted(found, key=lambda f: (f[0].kind, f[0].name, f[1])))


class _Rows:
    """Rows that wait to be sent, as columns."""

    def __init__(self, names: list[str], schema: str):
        self.names, self.kinds = names, pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")])
        self.rows: list[dict] = []

    def add(self, **row) -> None:
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in self.rows], k.type) for c, k in zip(self.names, self.kinds)], schema=self.kinds)
        self.rows = []
        return out


def _split(v: str | None) -> tuple[str | None, str | None]:
    """``(value, inherited from)``."""
    return (None, str(v)) if isinstance(v, _Inherited) else (v, None)


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the headers of each block's files in order of file; what depends on the blocks before is left open. The first block of an aggregation inherits nothing, and nothing inherits from the last."""
    out = _Rows(_ROW, _ROW_TYPE)
    place = file = None
    first = last = True
    before: Header | None = None
    now: Header = {}

    def end_file() -> None:
        nonlocal before, now
        if file is None:
            return
        where = {"agg_id": place[0], "block": place[1], "file_index": file[0], "file_id": file[1]}
        if before is None and first:
            for x in now.values():
                x.follow(None)
        elif before is None:
            out.add(tag="head", **where)  # such a block has at least this row
            for x in now.values():
                out.add(tag="head", **where, kind=x.kind, item_name=x.name, full_norm=x.full, dims=x.dims, shape=x.shape, dtype=x.dtype)
                x.dims = _Inherited(x.name) if x.dims is None else x.dims
                x.shape = _Inherited(x.name) if x.shape is None else x.shape
                x.union, x.root = x.dtype, x.name
        else:
            for x, kind, old, new, values in _stepped(now, before):
                if values is None:
                    out.add(tag="log", **where, kind=x.kind, item_name=x.name, change_type=kind, before=old, after=new, union_dtype=x.union, root=x.root)
                else:
                    named = {k: v for c, value in zip(("dims", "old_dims", "shape", "old_shape"), values) for k, v in zip((c, f"{c}_of"), _split(value))}
                    out.add(tag="open", **where, kind=x.kind, item_name=x.name, union_dtype=x.union, root=x.root, **named)
        before, now = now, {}

    def end_block() -> None:
        nonlocal before
        end_file()
        if not last:
            out.add(tag="tail", agg_id=place[0], block=place[1])
        for x in (before or {}).values() if not last else ():
            named = {k: v for c, value in (("dims", x.dims), ("shape", x.shape)) for k, v in zip((c, f"{c}_of"), _split(value))}
            out.add(tag="tail", agg_id=place[0], block=place[1], kind=x.kind, item_name=x.name, full_norm=x.full, dtype=x.dtype, union_dtype=x.union, root=x.root, **named)
        before = None

    for b in batches:
        for agg, block, index, id_, kind, name, full, dims, shape, dtype, is_first, is_last in zip(*(c.to_pylist() for c in b.columns)):
            if (agg, block) != place:
                if place is not None:
                    end_block()
                place, file, first, last = (agg, block), (index, id_), is_first, is_last
            elif file != (index, id_):
                end_file()
                file = (index, id_)
            if kind is None:
                continue
            x = now.get((kind, name))
            if x is None:
                now[kind, name] = _Item(kind, name, full, dims, shape, dtype)
            else:  # entries of one item that differ
                most = lambda a, c: c if a is None else a if c is None else max(a, c)
                x.full, x.dims, x.shape, x.dtype = most(x.full, full), most(x.dims, dims), most(x.shape, shape), most(x.dtype, dtype)
        if len(out.rows) > 5000:
            yield out.batch()
    if place is not None:
        end_block()
    yield out.batch()


def _fold_ends(t: pa.Table) -> pa.Table:
    """Carry what is known along the blocks of one aggregation: the changes at the borders, the open comparisons, and (change ``start``) the joined type that each item inherits."""
    out = _Rows(_LOG, _LOG_TYPE)
    blocks: dict[int, dict[str, list[dict]]] = {}
    for r in t.to_pylist():
        blocks.setdefault(r["block"], {}).setdefault(r["tag"], []).append(r)
    before: Header | None = None
    for block in sorted(blocks):
        own = blocks[block]
        item = lambda r: _Item(r["kind"], r["item_name"], r["full_norm"], r["dims"], r["shape"], r["dtype"])
        heads: Header = {(r["kind"], r["item_name"]): item(r) for r in own.get("head", []) if r["kind"] is not None}
        starts: dict[tuple, str | None] = {}
        if before is not None:
            where = {c: own["head"][0][c] for c in ("agg_id", "block", "file_index", "file_id")}
            for x, kind, old, new, _ in _stepped(heads, before):
                out.add(**where, kind=x.kind, item_name=x.name, change_type=kind, before=old, after=new, union_dtype=x.union)
            # the joined type at the block's first file; the block's own types are joined to it
            starts = {k: x.union for k, x in heads.items()}
        value = lambda r, c, kind: r[c] if r[f"{c}_of"] is None else getattr(heads[kind, r[f"{c}_of"]], c.removeprefix("old_"))
        for r in own.get("open", []):
            for kind, old, new in _altered(*(value(r, c, r["kind"]) for c in ("dims", "old_dims", "shape", "old_shape"))):
                out.add(**{c: r[c] for c in ("agg_id", "block", "file_index", "file_id", "kind", "item_name", "union_dtype", "root")}, change_type=kind, before=old, after=new)
        for (kind, name), union in starts.items():
            out.add(agg_id=t.column("agg_id")[0].as_py(), block=block, kind=kind, change_type="start", union_dtype=union, root=name)
        before = {}
        for r in own.get("tail", []):
            if r["kind"] is None:
                continue
            x = item({**r, "dims": value(r, "dims", r["kind"]), "shape": value(r, "shape", r["kind"])})
            x.union = promote(starts.get((r["kind"], r["root"])), r["union_dtype"])
            before[x.kind, x.name] = x
    return pa.Table.from_batches([out.batch()])


def change_log(files: DataFrame, items: DataFrame) -> DataFrame:
    """``(agg_id, block, file_index, file_id, kind, item_name, change_type, before, after, union_dtype)``: every difference between a file's header and that of the file before it in its aggregation, in the order (agg_id, file_index, file_id, kind, item_name, change_type).

    ``files`` has agg_id, file_index and file_id; ``items`` comes from ``header_items``. The headers of an aggregation are folded in
    order of file: the state holds the last known dims and shape of each item, followed through renames, and the join of the types
    it has had (``union_dtype``, by the promotion lattice). Change types are added, removed, renamed, dims, shape and dtype, with
    what stood before and after.

    A null shape or dims counts as the last one known of the item; one never known is not compared. A file that appears again in an
    aggregation counts once, at its first place; a null aggregation or file has no order and is left out. No files or no items give
    no rows. Aggregations are cut into blocks of files, each folded on its own with what it inherits left as a symbol; a second fold
    over the ends of the blocks, a few rows each, resolves the symbols, so an aggregation with a third of all files is no hot key.
    """
    shared_checkpoints(files.sparkSession)
    once = files.where("agg_id is not null and file_id is not null").groupBy("agg_id", "file_id").agg(F.min("file_index").cast("int").alias("file_index"))
    once = once.withColumn("block", F.floor(F.coalesce(F.col("file_index"), F.lit(-1)) / F.lit(FILES)))
    ends = once.groupBy("agg_id").agg(F.min("block").alias("_first"), F.max("block").alias("_last"))
    once = once.join(ends, "agg_id").withColumns({"first": F.col("block") == F.col("_first"), "last": F.col("block") == F.col("_last")})
    placed = once.join(items, "file_id", "left")
    columns = ["agg_id", "block", "file_index", "file_id", "kind", "item_name", "full_norm", "dims", "shape", "dtype", "first", "last"]
    ordered = placed.select(*columns).repartition("agg_id", "block").sortWithinPartitions(*columns[:6])
    folded = written(ordered.mapInArrow(_fold_blocks, _ROW_TYPE))
    ends = folded.where("tag != 'log'").groupBy("agg_id").applyInArrow(_fold_ends, _LOG_TYPE).checkpoint()
    log = folded.where("tag = 'log'").select(*_LOG).unionByName(ends.where("change_type != 'start'"))
    starts = ends.where("change_type = 'start'").select("agg_id", "block", "kind", "root", F.col("union_dtype").alias("_inherited"))
    log = log.join(starts, ["agg_id", "block", "kind", "root"], "left")
    return log.withColumn("union_dtype", promoted(F.array("_inherited", "union_dtype"))).select(*[c for c in _LOG if c != "root"])


def changes(files: DataFrame, items: DataFrame) -> DataFrame:
    """``(file_id, kind, item_name, change_type)``: the distinct changes of ``change_log``."""
    return change_log(files, items).select("file_id", "kind", "item_name", "change_type").distinct()


def numbered(log: DataFrame) -> DataFrame:
    """``log`` (of ``change_log``) with ``log_no``, the place of each change in its aggregation's log, from 1."""
    order = F.struct("file_index", "file_id", "kind", "item_name", "change_type")
    return ranked(log.withColumn("_order", order), ["agg_id"], "_order", F.col("block"), "log_no").drop("_order", "block")


def _families(links: list, together: list | None) -> list[tuple[str, str]]:
    """``(name, root)`` of the names in ``links`` (n, old, new), most frequent links first; names that stand in one list of ``together`` stay apart."""
    family: dict[str, set[str]] = {}
    for n, old, new in sorted(links, key=lambda x: (-x[0], x[1], x[2])):
        a, b = family.setdefault(old, {old}), family.setdefault(new, {new})
        if a is not b and not any(a & set(names) and b & set(names) for names in together or []):
            a |= b
            family.update(dict.fromkeys(b, a))
    return [(name, min(names)) for name, names in family.items()]


def _indexed(files: DataFrame, items: DataFrame) -> DataFrame:
    """One row per file and item, entries that differ merged."""
    merged = items.groupBy("kind", "file_id", "item_name").agg(*[F.max(c).alias(c) for c in ("full_norm", "dims", "shape", "dtype")])
    return merged.join(files.where("agg_id is not null").groupBy("agg_id", "file_id").agg(F.min("file_index").alias("file_index")), "file_id")


def canonical_names(files: DataFrame, items: DataFrame) -> DataFrame:
    """``(agg_id, kind, item_name, name)``: for each name that takes part in a renaming, the latest one of the names linked with it.

    The links are those that ``changes`` reports, followed over any number of files and back to an earlier name. Names that stand side
    by side in a file are different items and stay apart. Of each aggregation this is the ``renamed`` of ``read_union``.
    """
    moves = change_log(files, items).where("change_type = 'renamed'")
    links = moves.groupBy("agg_id", "kind", F.col("before").alias("old"), F.col("item_name").alias("new")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    groups = links.groupBy("agg_id", "kind").agg(F.collect_list(F.struct("n", "old", "new")).alias("links"))
    named = groups.select("agg_id", "kind", F.explode(F.array_distinct(F.concat("links.old", "links.new"))).alias("item_name"))
    placed = _indexed(files, items).join(named, ["agg_id", "kind", "item_name"])
    together = placed.groupBy("agg_id", "kind", "file_id").agg(F.sort_array(F.collect_set("item_name")).alias("names")).where(F.size("names") > 1)
    together = together.groupBy("agg_id", "kind").agg(F.collect_set("names").alias("together"))
    families = F.udf(lambda links, together: _families(links, together), "array<struct<item_name: string, root: string>>")
    roots = groups.join(together, ["agg_id", "kind"], "left").select("agg_id", "kind", F.inline(families("links", "together")))
    order = F.struct("file_index", "file_id", "item_name")
    latest = placed.join(roots, ["agg_id", "kind", "item_name"]).groupBy("agg_id", "kind", "root").agg(F.max_by("item_name", order).alias("name"))
    return roots.join(latest, ["agg_id", "kind", "root"]).select("agg_id", "kind", "item_name", "name")


def union_schema(files: DataFrame, items: DataFrame) -> DataFrame:
    """One row per aggregation and item: the consistent table ``(agg_id, kind, item_name, dtype, dims, shape, n_files, first_index, last_index, old_names)`` with the joined type and the dims and shape last known.

    A renamed item is one row over all its files, under its latest name, and ``old_names`` lists the others.
    """
    placed = _indexed(files, items).join(canonical_names(files, items), ["agg_id", "kind", "item_name"], "left")
    placed = placed.withColumnRenamed("item_name", "_own").withColumn("item_name", F.coalesce("name", "_own"))
    order = F.struct("file_index", "file_id")
    return (
        placed.groupBy("agg_id", "kind", "item_name")
        .agg(
            F.collect_set("dtype").alias("_types"),
            F.max_by("dims", F.when(F.col("dims").isNotNull(), order)).alias("dims"),
            F.max_by("shape", F.when(F.col("shape").isNotNull(), order)).alias("shape"),
            F.count(F.lit(1)).alias("n_files"),
            F.min("file_index").alias("first_index"),
            F.max("file_index").alias("last_index"),
            F.sort_array(F.collect_set(F.when(F.col("_own") != F.col("item_name"), F.col("_own")))).alias("old_names"),
        )
        .select("agg_id", "kind", "item_name", promoted(F.sort_array("_types")).alias("dtype"), "dims", "shape", "n_files", "first_index", "last_index", "old_names")
    )


#: Integer types from narrow to wide, with the digits of their decimal form.
INTEGERS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def spark_type(t: pa.DataType) -> T.DataType:
    """The type under which Spark reads an Arrow or Parquet type; unsigned integers get the next wider signed one."""
    plain = {
        "null": T.NullType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
        "halffloat": T.FloatType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "large_string": T.StringType(), "binary": T.BinaryType(), "large_binary": T.BinaryType(), "date32[day]": T.DateType(), "date64[ms]": T.DateType(),
    }
    if str(t) in plain:
        return plain[str(t)]
    if pa.types.is_decimal(t):
        return T.DecimalType(t.precision, t.scale)
    if pa.types.is_timestamp(t):
        return T.TimestampType() if t.tz else T.TimestampNTZType()
    if pa.types.is_dictionary(t):
        return spark_type(t.value_type)
    if pa.types.is_fixed_size_binary(t):
        return T.BinaryType()
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return T.ArrayType(spark_type(t.value_type))
    if pa.types.is_map(t):
        return T.MapType(spark_type(t.key_type), spark_type(t.item_type))
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in t])
    return T.StringType()


def joined(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    """The join of two types in the promotion lattice, in which no value is lost.

    Null lies below all. Booleans lie below integers, these below each other by width and below decimals with as many digits; long and
    int meet float in double, decimals and floating point numbers meet in double, dates lie below timestamps, strings below binary.
    Lists and maps join their parts, structs their fields by name. What has no other join meets in string.
    """
    a, b = (T.NullType() if x is None else x for x in (a, b))
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = {type(a), type(b)}
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(joined(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(joined(a.keyType, b.keyType), joined(a.valueType, b.valueType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *[n for n in b.names if n not in a.names]]
        return T.StructType([T.StructField(n, joined(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else None)) for n in names])
    if kinds <= {T.BooleanType, *INTEGERS}:
        order = [T.BooleanType, *INTEGERS]
        return max((a, b), key=lambda t: order.index(type(t)))
    if T.DecimalType in kinds and kinds <= {T.DecimalType, *INTEGERS}:
        parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (INTEGERS[type(t)], 0) for t in (a, b)]
        whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if kinds <= {T.BooleanType, T.ByteType, T.ShortType, T.FloatType}:
        return T.FloatType()
    if kinds <= {T.BooleanType, *INTEGERS, T.FloatType, T.DoubleType, T.DecimalType}:
        return T.DoubleType()
    if kinds <= {T.DateType, T.TimestampNTZType, T.TimestampType}:
        return T.TimestampType() if T.TimestampType in kinds else T.TimestampNTZType()
    if kinds == {T.StringType, T.BinaryType}:
        return T.BinaryType()
    return T.StringType()


def _cast(c: Column, own: T.DataType, to: T.DataType) -> Column:
    """``c`` as a value of a wider type of the lattice; fields of structs go by their names."""
    if own == to:
        return c
    if isinstance(to, T.StructType) and isinstance(own, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[(_cast(c[f.name], own[f.name].dataType, f.dataType) if f.name in own.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]))
    if isinstance(to, T.ArrayType) and isinstance(own, T.ArrayType):
        return F.transform(c, lambda x: _cast(x, own.elementType, to.elementType))
    if isinstance(to, T.MapType) and isinstance(own, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(_cast(e["key"], own.keyType, to.keyType).alias("key"), _cast(e["value"], own.valueType, to.valueType).alias("value")))
        return F.map_from_entries(pairs)
    return c.cast(to)


def _footer(path: str) -> pa.Schema:
    """The schema in a file's footer; paths with a scheme go to the file system that it names."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if "://" not in path:
        return pq.read_schema(path.removeprefix("file:"))
    system, inner = fs.FileSystem.from_uri(path)
    return pq.read_schema(inner, filesystem=system)


def file_schemas(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``(path, position, names, header)`` of Parquet files, whose footers are read in parallel by the executors; ``position`` is the place in ``paths``, ``header`` the schema as Spark reads it, in JSON."""

    def read(batches: Iterator) -> Iterator:
        for pdf in batches:
            heads = [_footer(p) for p in pdf["path"]]
            yield pdf.assign(names=[h.names for h in heads], header=[T.StructType([T.StructField(f.name, spark_type(f.type)) for f in h]).json() for h in heads])

    rows = [(p, i) for i, p in enumerate(paths)]
    schema = "path string, position int, names array<string>, header string"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, position int").repartition(min(len(rows), spark.sparkContext.defaultParallelism * 4), "path")
    return listed.mapInPandas(read, schema)


def read_union(spark: SparkSession, paths: Iterable[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """All files as one table under the union of their schemas, in order of first appearance: a column missing from a file is null there, each value is cast to the joined type. ``renamed`` maps old column names to new ones.

    To the driver come the distinct headers, and for each of the paths that it gave the number of its header. Two columns of a file that
    get one name are an error.
    """
    shared_checkpoints(spark)
    renamed, paths = renamed or {}, list(paths)
    heads = file_schemas(spark, paths).select("position", "header", F.xxhash64("header").alias("key")).checkpoint() if paths else None
    if heads is None:
        raise ValueError("no files")
    texts = {r.key: r.header for r in heads.groupBy("key").agg(F.max("header").alias("header")).collect()}
    files: dict[int, list[int]] = {}
    for r in heads.select("position", "key").collect():
        files.setdefault(r.key, []).append(r.position)
    groups = sorted((sorted(positions), T.StructType.fromJson(json.loads(texts[key]))) for key, positions in files.items())
    union: dict[str, T.DataType] = {}
    for _, header in groups:
        names = [renamed.get(n, n) for n in header.names]
        if len(set(names)) < len(names):
            raise ValueError("two columns of a file have one name")
        for n, f in zip(names, header.fields):
            union[n] = joined(union.get(n), f.dataType)
    parts = []
    for positions, header in groups:
        part = spark.read.parquet(*[paths[k] for k in positions])
        own = {renamed.get(n, n): n for n in header.names}
        values = {n: _cast(F.col(f"`{own[n]}`"), part.schema[own[n]].dataType, t) if n in own else F.lit(None).cast(t) for n, t in union.items()}
        parts.append(part.select(*[c.alias(n) for n, c in values.items()]))
    return reduce(DataFrame.unionByName, parts)
