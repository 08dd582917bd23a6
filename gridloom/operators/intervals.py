"""Continuous periods and gaps of overlapping time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.blocks import join_same, neighbour, ranked

#: Width of the blocks that a group is cut into along time, in the unit of the bounds (64 days of milliseconds).
BLOCK = 64 * 86_400_000
#: Ranks per block when the boundaries of periods are paired.
RANKS = 1 << 18


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Rows ``(*keys, kind, start_ms, end_ms)``: each longest covered period and each gap between two periods of one group.

    Starts and ends are ranked independently of each other. Between rank k and k+1 lies a gap exactly if the (k+1)th start is greater
    than the kth end, for then all intervals that have begun are over. Boundaries between gaps pair up to periods.

    Intervals hold their start and not their end, so touching ones are continuous. Those with a null bound, or an end not after the
    start, are ignored; repeated ones count once. A null key is a group of its own. An empty table gives no rows.
    """
    once = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s < _e").distinct()
    bound = lambda side, c: F.struct(F.lit(side).alias("_side"), F.col(c).alias("_t"))
    events = once.select(*keys, F.inline(F.array(bound("s", "_s"), bound("e", "_e"))))
    events = ranked(events, [*keys, "_side"], "_t", F.floor(F.col("_t") / F.lit(block)), "_k")
    starts = events.where("_side = 's'").select(*keys, (F.col("_k") - 1).alias("_k"), F.col("_t").alias("_s"))
    ends = events.where("_side = 'e'").select(*keys, "_k", F.col("_t").alias("_e"))
    edges = join_same(starts, ends, [*keys, "_k"], "full").where("_s is null or _e is null or _s > _e")
    edges = neighbour(edges, keys, ["_k"], F.floor(F.col("_k") / F.lit(RANKS)), ["_e"], "_next", following=True)
    found = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("start_ms"), F.col("_next._e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("_e").alias("start_ms"), F.col("_s").alias("end_ms")),
    )
    return edges.select(*keys, F.inline(found)).where("start_ms is not null and end_ms is not null")
