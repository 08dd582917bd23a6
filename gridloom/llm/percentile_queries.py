"""The queries of the training-data problem 6 over ``cdrecords``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.percentiles import located, merge, percentiles, summary
from gridloom.sources.tables import table

#: Percentiles that the p6 queries give.
PERCENTS = [5, 25, 50, 75, 95]
_FINE = ["collection_id", "source_id", "element_key", "unit"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Every valid reading of ``cdrecords``: not null, NaN, infinite or the declared missing value."""
    records = table(spark, d, "cdrecords").select("collection_id", "source_id", F.explode("elements").alias("element_key", "spec"), "metadata", "received_at")
    unit = F.try_element_at("metadata", F.concat(F.lit("units."), F.col("element_key")))
    cells = records.select("collection_id", "source_id", "element_key", unit.alias("unit"), F.to_date(F.date_trunc("month", "received_at")).alias("batch"), F.col("spec.missing").alias("missing"), F.explode("spec.data").alias("value"))
    return cells.where("value is not null and not isnan(value) and (missing is null or value != missing)").drop("missing")


def _grouped(fine: DataFrame) -> DataFrame:
    """Rows with the fine keys, once for their collection and variable and once for their source and element."""
    variable = F.element_at(F.split("element_key", "-"), 1)
    both = F.array(F.struct(F.lit("collection").alias("group_kind"), F.col("collection_id").alias("group_id"), variable.alias("item")), F.struct(F.lit("source").alias("group_kind"), F.col("source_id").alias("group_id"), F.col("element_key").alias("item")))
    return fine.select("*", F.inline(both)).drop("collection_id", "source_id", "element_key")


_GROUP = ["group_kind", "group_id", "item", "unit"]


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the valid readings per collection, variable and unit, and per source and element."""
    return percentiles(_readings(spark, d), _GROUP, "value", PERCENTS, _FINE, _grouped)


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the same percentiles out of summaries made for each month of arrival and merged afterwards."""
    months = summary(_readings(spark, d), [*_FINE, "batch"], "value")
    return located(merge([_grouped(months)], _GROUP), _GROUP, PERCENTS).select(*_GROUP, "pct", "n", "lo", "hi")


P6_SQL = """
with r as (select collection_id, source_id, metadata, unnest(map_entries(elements)) as en from cdrecords),
c as (select collection_id, source_id, en.key as element_key, metadata['units.' || en.key] as unit, en.value.missing as missing, unnest(en.value.data) as v from r),
g as (
  select 'collection' as group_kind, collection_id as group_id, split_part(element_key, '-', 1) as item, unit, v from c
  where v is not null and not isnan(v) and not isinf(v) and (missing is null or isnan(missing) or v <> missing)
  union all
  select 'source', source_id, element_key, unit, v from c
  where v is not null and not isnan(v) and not isinf(v) and (missing is null or isnan(missing) or v <> missing)),
k as (select *, row_number() over (partition by group_kind, group_id, item, unit order by v) as rn, count(*) over (partition by group_kind, group_id, item, unit) as n from g)
select group_kind, group_id, item, unit, cast(pct as integer) as pct, n, cast(v as double) as value
from k, (values (5), (25), (50), (75), (95)) as p(pct)
where rn = greatest(1, (n * pct + 99) // 100)
"""
