"""The queries of the training-data problems 1 to 5 over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.drift import change_log, changes, header_items, numbered, read_union, union_schema
from gridloom.operators.harmonise import converted_named, harmonised
from gridloom.operators.intervals import periods_and_gaps
from gridloom.operators.spikes import bad_readings
from gridloom.operators.times import estimated_zones, history_of_zones, parsed, resolved
from gridloom.sources.tables import epoch_millis, shared_checkpoints, table, written


#: Collections up to which the table of their zones is sent to all tasks.
FEW_ZONES = 50_000


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps of ``cdrecords`` per source and of ``time_intervals`` per cover."""
    slices = table(spark, d, "cdrecords").select(F.lit("cdrecords").alias("src_table"), F.col("source_id").alias("entity_id"), epoch_millis(F.col("time_start")).alias("s"), epoch_millis(F.col("time_end")).alias("e"))
    covers = table(spark, d, "time_intervals").select(F.lit("time_intervals").alias("src_table"), F.col("cover_id").alias("entity_id"), F.col("start_time").alias("s"), F.col("end_time").alias("e"))
    return periods_and_gaps(slices.unionByName(covers), ["src_table", "entity_id"], "s", "e").select("src_table", "entity_id", "kind", "start_ms", "end_ms")


P5_SQL = """
with iv as (
  select distinct src_table, entity_id, s, e from (
    select 'cdrecords' as src_table, source_id as entity_id, epoch_ms(time_start) as s, epoch_ms(time_end) as e from cdrecords
    union all select 'time_intervals', cover_id, start_time, end_time from time_intervals)
  where s < e),
m as (select *, max(e) over (partition by src_table, entity_id order by s, e rows between unbounded preceding and 1 preceding) as reach from iv),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by src_table, entity_id order by s, e rows unbounded preceding) as grp from m),
p as (select src_table, entity_id, grp, min(s) as start_ms, max(e) as end_ms from g group by 1, 2, 3),
n as (select *, lead(start_ms) over (partition by src_table, entity_id order by grp) as nxt from p)
select src_table, entity_id, 'period' as kind, start_ms, end_ms from n
union all select src_table, entity_id, 'gap' as kind, end_ms, nxt from n where nxt is not null
"""


def _headers(spark: SparkSession, d: str) -> DataFrame:
    variables = header_items(table(spark, d, "file_variables"), "V", "var_name", "full_name", "dtype")
    return variables.unionByName(header_items(table(spark, d, "file_coordinates"), "C", "coord_name"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change between the header of a file and the one before it in its aggregation."""
    return changes(table(spark, d, "file_inputs").select("agg_id", "file_index", "file_id"), _headers(spark, d))


def p1_log(spark: SparkSession, d: str) -> DataFrame:
    """The same changes as an ordered log of each aggregation, with what stood before and after and the joined type so far."""
    log = numbered(change_log(table(spark, d, "file_inputs").select("agg_id", "file_index", "file_id"), _headers(spark, d)))
    return log.select("agg_id", F.col("log_no").cast("bigint").alias("log_no"), "file_index", "file_id", "kind", "item_name", "change_type", "before", "after", "union_dtype")


def p1_union(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of variables and coordinates of each aggregation."""
    return union_schema(table(spark, d, "file_inputs").select("agg_id", "file_index", "file_id"), _headers(spark, d))


def p1_read_union(spark: SparkSession, d: str) -> DataFrame:
    """The header tables as files whose schemas drifted: ids and names under names of their own, a shape that is text in some and a list in others, and columns that only some have, in one table."""
    renamed = {"variable_id": "row_id", "coordinate_id": "row_id", "axis_id": "row_id", "metadata_id": "row_id", "var_name": "item_name", "coord_name": "item_name", "axis_name": "item_name", "name_and_dimensions": "item_name"}
    names = ("file_variables", "file_coordinates", "file_axes", "variable_metadata")
    return read_union(spark, [f"{d}/{n}.parquet" for n in names], renamed).select("row_id", "file_id", "collection_id", "item_name", "units", "shape", "dims", "dtype", "valid_max", "minval", "missing")


P1_READ_SQL = """
select variable_id as row_id, file_id, collection_id, var_name as item_name, units, shape, dims, dtype, valid_max, cast(null as double) as minval, cast(null as float) as missing from file_variables
union all select coordinate_id, file_id, collection_id, coord_name, units, shape, dims, null, null, null, null from file_coordinates
union all select axis_id, file_id, collection_id, axis_name, units, case when shape is not null then '[' || array_to_string(shape, ', ') || ']' end, null, null, null, minval, null from file_axes
union all select metadata_id, file_id, collection_id, name_and_dimensions, units, case when shape is not null then '[' || array_to_string(shape, ', ') || ']' end, null, null, valid_max, null, missing from variable_metadata
"""


#: The step by step fold of headers as a recursive query.
_P1_STEPS = r"""
with recursive f as (select agg_id, file_id, min(file_index) as file_index from file_inputs where agg_id is not null and file_id is not null group by 1, 2),
o as (select *, row_number() over (partition by agg_id order by file_index nulls first, file_id) as k from f),
raw as (
  select 'V' as kind, file_id, var_name as item, regexp_replace(lower(trim(full_name)), '[\s_]+', ' ', 'g') as full_norm, dims, shape, lower(trim(dtype)) as dtype from file_variables
  union all select 'C', file_id, coord_name, null, dims, shape, null from file_coordinates),
it as (
  select kind, file_id, item, max(full_norm) as full_norm, max(array_to_string(regexp_extract_all(lower(dims), '[^\s,;()\[\]]+'), ' ')) as dims,
    max(array_to_string([cast(trunc(cast(x as double)) as bigint) for x in regexp_extract_all(shape, '\d+(?:\.\d+)?')], ' ')) as shape, max(dtype) as dtype
  from raw where file_id is not null and item is not null group by 1, 2, 3),
p as (select o.agg_id, o.k, o.file_index, it.* from o join it on o.file_id = it.file_id),
came as (select *, case when kind = 'V' and full_norm is not null then 'f' || full_norm else 'n' || item end as token from p c
  where k > 1 and not exists (from p b where b.agg_id = c.agg_id and b.k = c.k - 1 and b.kind = c.kind and b.item = c.item)),
gone as (select b.agg_id, b.k + 1 as k, b.kind, b.item, case when b.kind = 'V' and b.full_norm is not null then 'f' || b.full_norm else 'n' || b.item end as token from p b join o on o.agg_id = b.agg_id and o.k = b.k + 1
  where not exists (from p c where c.agg_id = b.agg_id and c.k = b.k + 1 and c.kind = b.kind and c.item = b.item)),
cn as (select *, row_number() over (partition by agg_id, k, kind, token order by item) as n from came),
gn as (select *, row_number() over (partition by agg_id, k, kind, token order by item) as n from gone),
loose as (select coalesce(cn.agg_id, gn.agg_id) as agg_id, coalesce(cn.k, gn.k) as k, coalesce(cn.kind, gn.kind) as kind, cn.item, gn.item as old
  from cn full join gn on cn.agg_id = gn.agg_id and cn.k = gn.k and cn.kind = gn.kind and cn.token = gn.token and cn.n = gn.n),
link as (select p.*, case when l.item is not null then l.old when p.k > 1 then p.item end as old from p left join loose l on l.agg_id = p.agg_id and l.k = p.k and l.kind = p.kind and l.item = p.item),
eff as (
  select agg_id, k, kind, item, dims, shape, dtype as u from link where old is null
  union all
  select l.agg_id, l.k, l.kind, l.item, coalesce(l.dims, e.dims), coalesce(l.shape, e.shape),
    case when e.u is null or l.dtype is null or e.u = l.dtype then coalesce(l.dtype, e.u)
      when list_position(['bool', 'byte', 'short', 'int', 'long', 'float', 'double'], e.u) is null or list_position(['bool', 'byte', 'short', 'int', 'long', 'float', 'double'], l.dtype) is null then 'string'
      when 'double' in (e.u, l.dtype) or ('float' in (e.u, l.dtype) and (e.u in ('int', 'long') or l.dtype in ('int', 'long'))) then 'double'
      when list_position(['bool', 'byte', 'short', 'int', 'long', 'float', 'double'], e.u) > list_position(['bool', 'byte', 'short', 'int', 'long', 'float', 'double'], l.dtype) then e.u else l.dtype end
  from link l join eff e on e.agg_id = l.agg_id and e.k = l.k - 1 and e.kind = l.kind and e.item = l.old),
both_ as (select l.agg_id, l.k, l.kind, l.item, l.dtype, b.dtype as old_dtype, e.dims, e.shape, g.dims as old_dims, g.shape as old_shape, e.u,
    case when len(string_split(e.shape, ' ')) = len(string_split(e.dims, ' ')) then [x[1] for x in list_zip(string_split(e.shape, ' '), string_split(e.dims, ' ')) if x[2] <> 'time'] else string_split(e.shape, ' ') end as still,
    case when len(string_split(g.shape, ' ')) = len(string_split(e.dims, ' ')) then [x[1] for x in list_zip(string_split(g.shape, ' '), string_split(e.dims, ' ')) if x[2] <> 'time'] else string_split(g.shape, ' ') end as old_still
  from link l join p b on b.agg_id = l.agg_id and b.k = l.k - 1 and b.kind = l.kind and b.item = l.old
  join eff e on e.agg_id = l.agg_id and e.k = l.k and e.kind = l.kind and e.item = l.item join eff g on g.agg_id = l.agg_id and g.k = l.k - 1 and g.kind = l.kind and g.item = l.old),
log as (
  select agg_id, k, kind, item, 'dims' as change_type, old_dims as before, dims as after, u from both_ where dims <> old_dims
  union all select agg_id, k, kind, item, 'shape', old_shape, shape, u from both_ where dims = old_dims and still <> old_still
  union all select agg_id, k, kind, item, 'dtype', old_dtype, dtype, u from both_ where kind = 'V' and dtype <> old_dtype
  union all select l.agg_id, l.k, l.kind, coalesce(l.item, l.old), case when l.old is null then 'added' when l.item is null then 'removed' else 'renamed' end, l.old, l.item, e.u
  from loose l join eff e on e.agg_id = l.agg_id and e.kind = l.kind and e.item = coalesce(l.item, l.old) and e.k = case when l.item is null then l.k - 1 else l.k end)
"""
P1_SQL = _P1_STEPS + "select distinct o.file_id, kind, item as item_name, change_type from log join o on o.agg_id = log.agg_id and o.k = log.k"
P1_LOG_SQL = _P1_STEPS + """select log.agg_id, row_number() over (partition by log.agg_id order by file_index, o.file_id, kind, item, change_type) as log_no, cast(file_index as integer) as file_index, o.file_id, kind, item as item_name, change_type, before, after, u as union_dtype
from log join o on o.agg_id = log.agg_id and o.k = log.k"""


def _stamps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The parsed texts of both tables; and for each collection the zone estimated, the one stated, and whether their clocks agree.

    What a zoneless text should say is known where a file's place in its aggregation gives its instant, and where the content of a
    record was delivered again under a text with a zone.
    """
    shared_checkpoints(spark)
    sites = table(spark, d, "archive_sites").groupBy("collection_id").agg(F.max("time_zone").alias("site_zone"), F.max("day_first").alias("site_first"), F.max("site_name").alias("site_name"))
    files = table(spark, d, "file_inputs").select(F.lit("file_inputs").alias("src_table"), F.col("input_id").alias("rec_id"), "collection_id", F.col("start_time").alias("stamp"), "calendar_name", F.col("agg_id").alias("series"), (F.col("first_row_index").cast("long") * F.col("time_step_ms")).alias("_ahead"))
    content = F.hex(F.xxhash64("collection_id", "var_name", "grid_file_path", "readings"))
    records = table(spark, d, "variable_records").select(F.lit("variable_records").alias("src_table"), F.col("record_no").alias("rec_id"), "collection_id", F.col("time_stamp").alias("stamp"), content.alias("series"), F.lit(0).cast("long").alias("_ahead"))
    texts = files.unionByName(records, allowMissingColumns=True).join(sites, "collection_id", "left")
    stamps = written(parsed(texts, "stamp", "calendar_name", "site_first"))
    sure = F.coalesce("_fixed", F.when(F.col("_offset").isNotNull(), F.col("_local") - F.col("_offset") * 60_000)) - F.col("_ahead")
    placed = stamps.where("series is not null")
    anchors = placed.groupBy("src_table", "series").agg(F.percentile_approx(sure, 0.5, 1000).alias("_anchor"), (F.min(sure) == F.max(sure)).alias("_one"))
    anchors = anchors.where("_anchor is not null and (src_table = 'file_inputs' or _one)")
    placed = placed.join(anchors, ["src_table", "series"], "left").withColumn("expected", F.col("_anchor") + F.col("_ahead"))
    named = [r.time_zone for r in table(spark, d, "archive_sites").select("time_zone").distinct().collect() if r.time_zone]
    found = estimated_zones(placed, "collection_id", "site_name", named, "expected").withColumnRenamed("zone", "estimated_zone")
    stated = sites.select("collection_id", "site_zone").join(F.broadcast(history_of_zones(spark)), F.col("site_zone") == F.col("zone"), "left").select("collection_id", "site_zone", F.col("history").alias("_stated"))
    zones = stated.join(found, "collection_id", "full").withColumn("differs", F.col("history") != F.col("_stated")).checkpoint()
    return stamps, zones


def _instants(stamps: DataFrame, zones: DataFrame, zone: Column) -> DataFrame:
    homes = zones.select("collection_id", zone.alias("_home"))
    return resolved(stamps.drop("site_zone").join(F.broadcast(homes) if homes.count() <= FEW_ZONES else homes, "collection_id", "left"), "_home", "utc_ms").where("utc_ms is not null").select("src_table", "rec_id", "utc_ms").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The UTC instant of each text that determines one.

    A text without zone is read in the zone estimated for its collection. The zone that archive_sites states is the check after it:
    where the clocks of the two differ, or there is no estimate, the stated one counts, and p2_zones shows the difference.
    """
    stamps, zones = _stamps(spark, d)
    return _instants(stamps, zones, F.when(~F.col("differs"), F.col("estimated_zone")).otherwise(F.coalesce("site_zone", "estimated_zone")))


def p2_alone(spark: SparkSession, d: str) -> DataFrame:
    """As p2_found by the estimated zones alone, without a look at the stated ones."""
    stamps, zones = _stamps(spark, d)
    return _instants(stamps, zones, F.col("estimated_zone"))


def p2_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone estimated for each collection, beside the one stated, how many texts it was tried on and how many violate it, and whether the clocks of the two ever differ; null where there is no estimate."""
    _, zones = _stamps(spark, d)
    return table(spark, d, "archive_sites").select("collection_id", "time_zone").join(zones.drop("site_zone", "_stated", "history"), "collection_id", "left")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """One row per record and element of ``cdrecords``, with the unit of the element."""
    records = table(spark, d, "cdrecords").select("record_id", "source_id", "collection_id", epoch_millis(F.col("time_start")).alias("t"), F.explode("elements").alias("element_key", "spec"), "metadata")
    return records.withColumn("unit", F.try_element_at("metadata", F.concat(F.lit("units."), F.col("element_key")))).drop("metadata")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each impossible, stuck or jumping reading of ``cdrecords``."""
    return bad_readings(_elements(spark, d), F.col("unit")).select("record_id", "element_key", "cell_no").distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    """All recorded values in the form that ``harmonised`` takes."""
    category = lambda c: F.regexp_replace(F.lower(c), r"[\s_]+", " ")
    none = F.lit(None).cast("double")
    v = table(spark, d, "file_variables").select(F.lit("file_variables").alias("src_table"), F.col("variable_id").alias("rec_id"), F.lit("valid_max").alias("field_name"), F.col("valid_max").alias("value"), none.alias("other"), "units", F.col("description").alias("text"), F.lit("").alias("hint"), F.col("collection_id").alias("source"), category(F.col("full_name")).alias("category"))
    m = table(spark, d, "variable_metadata").select(F.lit("variable_metadata").alias("src_table"), F.col("metadata_id").alias("rec_id"), F.lit("valid_max").alias("field_name"), F.col("valid_max").cast("double").alias("value"), none.alias("other"), "units", F.col("metadata").alias("text"), F.lit("").alias("hint"), F.col("collection_id").alias("source"), category(F.regexp_extract("metadata", r"long_name: ([^;]+)", 1)).alias("category"))
    a = table(spark, d, "file_axes").select("axis_id", "units", "long_name", "ctype", "collection_id", "axis_name", "minval", "maxval")
    both = F.array(F.struct(F.lit("minval").alias("field_name"), F.col("minval").alias("value"), F.col("maxval").alias("other")), F.struct(F.lit("maxval").alias("field_name"), F.col("maxval").alias("value"), F.col("minval").alias("other")))
    a = a.select(F.lit("file_axes").alias("src_table"), F.col("axis_id").alias("rec_id"), F.inline(both), "units", F.col("long_name").alias("text"), F.coalesce("ctype", F.lit("")).alias("hint"), F.col("collection_id").alias("source"), F.lower("axis_name").alias("category"))
    return v.unionByName(m).unionByName(a)


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """Every value with the unit named or predicted for it, its confidence, whether it is converted or left for review, and its converted value."""
    return harmonised(_values(spark, d), table(spark, d, "common_units")).select("src_table", "rec_id", "field_name", "quantity", "factor", "offset", "named_by", "confidence", "route", "common_value", "common_steps")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value whose unit is named and is not the common unit of its quantity, in steps of the common unit. Values that need a predicted unit are no cases here, so no model is fitted; ``p4_units`` has them."""
    rows = converted_named(_values(spark, d), table(spark, d, "common_units"))
    other = (F.abs(F.col("factor") - 1) > 1e-9) | (F.abs(F.col("offset")) > 1e-9)
    return rows.where(other & F.col("common_steps").isNotNull()).select("src_table", "rec_id", "field_name", "common_steps").distinct()


def p4_hidden(spark: SparkSession, d: str) -> DataFrame:
    """How the prediction does on held-out rows: a tenth of the rows with a named unit, by hash, lose their names; of these, how many are converted, how many of those rightly, and how many are left for review."""
    values = _values(spark, d)
    hide = F.pmod(F.xxhash64("rec_id", "field_name", "src_table"), F.lit(10)) == 0
    truth = converted_named(values, table(spark, d, "common_units")).where(hide & (F.col("quantity") != "time")).select("src_table", "rec_id", "field_name", F.col("common_value").alias("true_value"))
    shown = values.withColumns({c: F.when(~hide, F.col(c)) for c in ("units", "text")})
    found = harmonised(shown, table(spark, d, "common_units")).join(truth, ["src_table", "rec_id", "field_name"])
    right = F.abs(F.col("common_value") - F.col("true_value")) <= 1e-6 * F.abs(F.col("true_value")) + 1e-12
    return found.agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("route") == "convert").alias("converted"), F.count_if((F.col("route") == "convert") & right).alias("right"), F.count_if(F.col("route") == "review").alias("review"))


def queries():
    return {"p1_found": p1_found, "p1_log": p1_log, "p1_read_union": p1_read_union, "p1_union": p1_union, "p2_found": p2_found, "p2_zones": p2_zones, "p3_found": p3_found, "p4_found": p4_found, "p4_units": p4_units, "p5_found": p5_found}


def oracle_sql():
    return {"p1_found": P1_SQL, "p1_log": P1_LOG_SQL, "p1_read_union": P1_READ_SQL, "p5_found": P5_SQL}
