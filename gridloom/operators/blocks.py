"""Ordered neighbours and ranks within groups of any size.

A plain window over ``PARTITION BY key ORDER BY t`` puts a hot key into one task. Here each group is cut into blocks along its order,
the window runs within a block, and a small table with one row a block carries ranks and edge rows across block boundaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where nulls equal each other. The result has every key once; the other columns must have different names."""
    right = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = a.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    merged = [F.coalesce(k, f"_r_{k}").alias(k) if how in ("full", "right") else F.col(k) for k in keys]
    return joined.select(*merged, *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys])


def ranked(df: DataFrame, keys: list[str], order: str, block: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the 1-based rank of each row by ``order`` among the rows with equal ``keys``.

    ``block`` must not decrease along ``order``. Ties get different ranks in any order. Null keys form groups of their own.
    """
    b = df.withColumn("_block", block)
    local = b.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return join_same(local, offsets, [*keys, "_block"]).select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def neighbour(df: DataFrame, keys: list[str], order: list[str], block: Column, values: list[str], name: str, following: bool = False) -> DataFrame:
    """``df`` with the struct ``name`` of ``values`` of the row before (or after, if ``following``) within equal ``keys``; null at the end.

    ``block`` must not decrease along ``order``.
    """
    b = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    shift = F.lead if following else F.lag
    local = b.withColumn("_near", shift(F.struct(*values)).over(inner))
    pick = F.min_by if following else F.max_by
    edges = b.groupBy(*keys, "_block").agg(pick(F.struct(*values), F.struct(*order)).alias("_edge"))
    edges = edges.withColumn("_edge", shift("_edge").over(Window.partitionBy(*keys).orderBy("_block")))
    return join_same(local, edges, [*keys, "_block"]).select(*df.columns, F.coalesce("_near", "_edge").alias(name))


def carried(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, name: str, ties: list[str] | None = None, following: bool = False) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that isn't null at or before each row along ``order`` within equal ``keys`` (the next one at or after it, if ``following``).

    ``block`` must not decrease along ``order``; only the last value of each block is carried over its border. Rows equal in ``order``
    come by ``ties``, in either direction.
    """
    b = df.withColumn("_block", block)
    direction = (lambda c: F.col(c).desc()) if following else F.col
    w = Window.partitionBy(*keys, "_block").orderBy(*[direction(c) for c in order], *(ties or []))
    local = b.withColumn("_near", F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pick = F.min_by if following else F.max_by
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    edges = b.groupBy(*keys, "_block").agg(pick(F.col(value), place).alias("_edge"))
    before = Window.partitionBy(*keys).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_edge", F.last("_edge", True).over(before))
    return join_same(local, edges, [*keys, "_block"]).select(*df.columns, F.coalesce("_near", "_edge").alias(name))
