"""Percentiles of very large columns by bisection over value intervals, and summaries of them that merge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.blocks import join_same
from gridloom.sources.tables import shared_checkpoints, written

#: Intervals of a summary per unit of the natural logarithm, so that one is at most a 1024th of its values wide.
GRID = 1024
#: Parts into which each further pass cuts an interval, that is twelve bisections at once.
PARTS = 1 << 12
#: Most open intervals that are sent to all tasks; beyond, they are joined by key.
SENT = 50_000


def interval_of(x: Column, grid: int = GRID) -> Column:
    """The number of the interval of a fixed grid that the finite double ``x`` lies in: it doesn't decrease along x, and 0 is one of its own. The logarithm is the exactly specified one, so all machines agree."""
    step = F.floor((F.ln(F.abs(x)) + 746) * grid) + 1
    return F.when(x > 0, step).when(x < 0, -step).otherwise(0).cast("int")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.7976931348623157e308)


def summary(df: DataFrame, keys: list[str], value: str, grid: int = GRID) -> DataFrame:
    """The mergeable form ``(*keys, bucket, n, lo, hi)``: how many values each interval of a fixed grid holds, and their extremes.

    The grid is the same for all data, so summaries of separate days, files or batches merge by addition (``merge``). Null, NaN and
    infinite values are left out; a null key is a group of its own. Counts are combined before they are shuffled.
    """
    x = F.col("_x")
    kept = df.select(*keys, F.col(value).cast("double").alias("_x")).where(_finite(x))
    return kept.groupBy(*keys, interval_of(x, grid).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One summary of several on the same grid, or of one over fewer keys."""
    return reduce(DataFrame.unionByName, [p.select(*keys, "bucket", "n", "lo", "hi") for p in parts]).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def located(counts: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """``(*keys, pct, n, bucket, rank, lo, hi)``: the interval that holds each percentile of a summary, and the rank within it.

    The percentile p of n values is the value of rank ceil(n p / 100), at least 1. Without further passes lo and hi bound it, with a
    relative error of at most 1 / GRID.
    """
    upto = Window.partitionBy(*keys).orderBy("bucket")
    placed = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    asked = placed.withColumn("pct", F.explode(F.array(*[F.lit(int(p)) for p in percents])))
    rank = F.greatest(F.floor((F.col("total") * F.col("pct") + 99) / 100), F.lit(1))
    asked = asked.withColumn("rank", rank).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return asked.select(*keys, "pct", F.col("total").alias("n"), "bucket", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi")


def _few(intervals: DataFrame) -> DataFrame:
    """``intervals``, counted, and sent to all tasks if their number allows."""
    return F.broadcast(intervals) if intervals.count() <= SENT else intervals


def percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int], fine: list[str] | None = None, regroup: Callable[[DataFrame], DataFrame] | None = None, grid: int = GRID) -> DataFrame:
    """``(*keys, pct, n, value)``: exact percentiles of each group.

    Exact bisection: each group and percentile has an interval of values; a pass counts the rows below the midpoints of its open
    intervals (twelve bisections at once) and keeps the part that holds the target rank, until it holds one value only. The first
    pass is a summary. The second reads only rows that lie in an open interval, further ones only what that gave; intervals that
    hold one value were counted already. Ties are one value, and so are 0 and -0. A group without finite values gives no rows.

    Several groupings at once: the summary is made for the columns ``fine``, and ``regroup`` turns rows with these into rows with
    ``keys``, one for each group that a row belongs to, keeping other columns.
    """
    shared_checkpoints(df.sparkSession)
    fine, regroup = fine or keys, regroup or (lambda x: x)
    base = written(summary(df, fine, value, grid))
    # groups go by a number while they are counted: their hash, if no two have the same, else their keys
    names = regroup(base.select(*fine).distinct()).select(*keys).distinct().withColumn("_group", F.xxhash64(*keys)).checkpoint()
    asked, whole = keys, regroup
    if names.count() == names.select("_group").distinct().count():
        keys, regroup = ["_group"], lambda x: whole(x).withColumn("_group", F.xxhash64(*asked)).drop(*asked)
    # one exchange by group serves the sums and the ranks; a group has at most as many rows as the grid has intervals
    together = regroup(base).select(*keys, "bucket", "n", "lo", "hi").repartition(*keys)
    found = located(merge([together], keys), keys, percents).checkpoint()
    done, open_ = [found.where("lo = hi")], found.where("lo < hi")
    if open_.limit(1).count():
        wanted = _few(open_.select(*keys, "bucket").distinct().checkpoint())
        # the summary's rows in open intervals: those of one value are counted already, the others' readings are read again
        hits = join_same(regroup(base.withColumn("_fine", F.struct(*fine))), wanted, [*keys, "bucket"], "left_semi").checkpoint()
        counted = hits.where("lo = hi").select(*keys, "bucket", F.col("lo").alias("_x"), F.col("n").alias("_w"))
        mixed = _few(hits.where("lo < hi").select("_fine.*", "bucket").distinct().checkpoint())
        raw = df.select(*fine, F.col(value).cast("double").alias("_x")).where(_finite(F.col("_x"))).withColumn("bucket", interval_of(F.col("_x"), grid))
        raw = join_same(raw, mixed, ["bucket", *fine], "left_semi").groupBy(*fine, "bucket", "_x").agg(F.count(F.lit(1)).alias("_w"))
        rows = written(counted.unionByName(join_same(regroup(raw), wanted, [*keys, "bucket"], "left_semi").select(*keys, "bucket", "_x", "_w")))
        # from here on an interval is known by its bounds; those of one bucket overlap no others
        rows, open_ = rows.withColumn("_at", F.col("bucket")), open_.withColumn("_at", F.col("bucket"))
    while open_.limit(1).count():
        spans = _few(open_.select(*keys, "_at", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct())
        inside = join_same(rows, spans, [*keys, "_at"]).where("_x >= _lo and _x <= _hi")
        # an interval has one sign, so its width is a double, and not 0
        part = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))
        part = F.when(F.col("_x") >= F.col("_hi"), PARTS).otherwise(part)
        parts = inside.groupBy(*keys, "_at", "_lo", "_hi", part.alias("part")).agg(F.sum("_w").alias("c"), F.min("_x").alias("p_lo"), F.max("_x").alias("p_hi"))
        parts = parts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "_at", "_lo", "_hi").orderBy("part"))).withColumnsRenamed({"_lo": "lo", "_hi": "hi"})
        hit = join_same(open_, parts, [*keys, "_at", "lo", "hi"]).where("rank <= upto and rank > upto - c")
        hit = hit.select(*keys, "pct", "n", "bucket", "_at", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi")).checkpoint()
        done.append(hit.where("lo = hi").drop("_at"))
        open_ = hit.where("lo < hi")
    out = reduce(DataFrame.unionByName, [x.select(*keys, "pct", "n", "lo") for x in done]).withColumnRenamed("lo", "value")
    return out if keys == asked else join_same(out, names, keys).select(*asked, "pct", "n", "value")
