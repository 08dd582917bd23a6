"""Implausible readings of time series, judged against each source's own normal behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.units import parse_unit
from gridloom.sources.tables import shared_checkpoints

#: Rows of one source and element per block, and readings of each cell that a block sees before and after its own.
BLOCK_ROWS, HALO_ROWS = 4096, 400
#: Parts that a block too large is cut into at once, and tables of cuts up to which they are broadcast.
CUTS, FEW = 64, 50_000
#: Readings around each one whose deviations give the noise.
WINDOW = 161
#: Half width of the rolling median, equal readings that make a run stuck, and the scores beyond which a reading is a jump.
HALF, STUCK, NEAR, FAR, RAIN = 4, 10, 3.0, 11.3, 180.0
#: A reading this far from the rolling median is a jump already at the second distance from the line, as at the ends of a series.
CLEAR = (14.0, 8.5)
#: A marginal candidate, one no further than the second number from the median, that is this near one of two levels belongs to it.
LEVEL, MARGINAL = 5.0, 8.0
#: Readings beside its own that a block must see for its medians and deviations to be those of the uncut series.
REACH = 2 * WINDOW + 4 * HALF
#: The variables' kinds; a kind sets the physical bounds.
TEMPERATURE, PRESSURE, POSITIVE, SHARE, RESTING, BURSTS = ["tas", "tos"], ["ps"], ["huss", "pr"], ["hur", "siconc"], ["pr", "siconc"], ["pr"]


def bounds(variable: str, unit: str | None) -> tuple[float, float, float]:
    """``(a, b, c)``: a reading is impossible if x <= a, x < b or x > c; NaN for no bound. A unit that is not known counts as the common one."""
    _, factor, offset = parse_unit(unit) or ("", 1.0, 0.0)
    nan = float("nan")
    if variable in TEMPERATURE:
        return -offset / factor, nan, nan
    if variable in PRESSURE:
        return 0.0, nan, nan
    if variable in POSITIVE:
        return nan, 0.0, nan
    return (nan, 0.0, 1 / factor) if variable in SHARE else (nan, nan, nan)


def _middle(values: np.ndarray, seg: np.ndarray, n: int, least: int) -> np.ndarray:
    """The median of the values of each of n segments, NaN where a segment has fewer than ``least``."""
    out = np.full(n, np.nan)
    if len(values):
        order = np.lexsort((values, seg))
        v, s = values[order], seg[order]
        count = np.bincount(s, minlength=n)
        first = np.cumsum(count) - count
        has = np.flatnonzero(count >= max(least, 1))
        out[has] = (v[first[has] + (count[has] - 1) // 2] + v[first[has] + count[has] // 2]) / 2
    return out


def _run_lengths(x: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The length of the run of equal readings that each reading is in."""
    if not len(x):
        return np.zeros(0, int)
    edge = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (seg[1:] != seg[:-1]), True])
    return np.repeat(np.diff(edge), np.diff(edge))


def _rolling(values: np.ndarray, use: np.ndarray, seg: np.ndarray, n: int, least: int) -> np.ndarray:
    """For each reading the median of the ``WINDOW`` used values of its segment around it; at the ends of a segment the first or last ones; NaN where a segment has fewer than ``least``."""
    v, own = values[use].astype(np.float32), seg[use]
    count = np.bincount(own, minlength=n)
    first = np.cumsum(count) - count
    out = _middle(v.astype(np.float64), own, n, least)[seg]
    long = (count > WINDOW)[seg]
    if long.any():
        here = np.cumsum(use)[long] - 1 - WINDOW // 2
        at = np.clip(here, first[seg[long]], (first + count)[seg[long]] - WINDOW)
        starts, place = np.unique(at, return_inverse=True)
        view = np.lib.stride_tricks.sliding_window_view(v, WINDOW)
        middles = np.empty(len(starts))
        for lo in range(0, len(starts), 8192):
            middles[lo : lo + 8192] = np.partition(view[starts[lo : lo + 8192]], WINDOW // 2, axis=1)[:, WINDOW // 2]
        out[long] = middles[place]
    return out


def jumps(x: np.ndarray, seg: np.ndarray, n: int, still: np.ndarray, bursts: np.ndarray) -> np.ndarray:
    """Which readings, in order of time within ``n`` segments, are jumps.

    A Hampel filter: the distance of a reading from the rolling median of nine readings, in units of the rolling median of such
    distances, the absolute deviations of the ``WINDOW`` readings around it. Candidates beyond ``NEAR`` deviations must also lie beyond
    ``FAR`` of the deviations that the readings around have from their neighbours' line, measured from the line between the nearest
    readings that are no candidates (less if clear of the median), so that season, swells and changes of level pass; of ``bursts``
    (rain) only candidates beyond ``RAIN`` are jumps. ``still`` marks stuck readings, which like distances of zero say nothing about noise.
    """
    if not len(x):
        return np.zeros(0, bool)
    idx = np.arange(len(x))
    wide = np.full((len(x), 2 * HALF + 1), np.nan)
    for k in range(-HALF, HALF + 1):
        a, b = max(0, -k), len(x) - max(0, k)
        if a < b:
            wide[a:b, k + HALF] = np.where(seg[a:b] == seg[a + k : b + k], x[a + k : b + k], np.nan)
    wide.sort(axis=1)
    seen = (~np.isnan(wide)).sum(1)
    distance = np.abs(x - (wide[idx, (seen - 1) // 2] + wide[idx, seen // 2]) / 2)
    noise = 1.4826 * _rolling(distance, (distance > 0) & ~still, seg, n, 8)
    with np.errstate(divide="ignore", invalid="ignore"):
        near = np.nan_to_num(distance / noise)
    good = near < NEAR
    before = np.r_[-1, np.maximum.accumulate(np.where(good, idx, -1))[:-1]]
    after = np.r_[np.minimum.accumulate(np.where(good, idx, len(x))[::-1])[::-1][1:], len(x)]
    left = np.where((before >= 0) & (seg[before] == seg), before, -1)
    right = np.where((after < len(x)) & (seg[np.minimum(after, len(x) - 1)] == seg), after, -1)
    lv, rv = x[left], x[right]
    line = np.where(left < 0, rv, np.where(right < 0, lv, lv + (rv - lv) * (idx - left) / np.maximum(right - left, 1)))
    line = np.where((left < 0) & (right < 0), x, line)
    bend = np.r_[0.0, np.abs(x[1:-1] - (x[:-2] + x[2:]) / 2), 0.0] if len(x) > 2 else np.zeros(len(x))
    use = np.zeros(len(x), bool)
    use[1:-1] = (seg[2:] == seg[:-2]) & good[1:-1] & good[:-2] & good[2:] & (bend[1:-1] > 0) & ~still[1:-1]
    fine = 1.4826 * _rolling(bend, use, seg, n, 8)
    fine = np.where(np.isnan(fine), noise, fine)
    with np.errstate(divide="ignore", invalid="ignore"):
        # between two levels a reading that is near one of them is no jump
        at_level = (near < MARGINAL) & (np.minimum(np.abs(x - lv), np.abs(x - rv)) < LEVEL * fine) & (left >= 0) & (right >= 0) & (np.abs(rv - lv) > FAR * fine)
        away = np.where(at_level, 0.0, np.abs(x - line))
        far = np.nan_to_num(away / fine)
    return np.where(bursts[seg], near > RAIN, ~good & ((far > FAR) | (near > CLEAR[0]) & (far > CLEAR[1])))


def _series(t: pa.Table) -> dict[str, np.ndarray]:
    """The readings of whole groups that are not missing, in order of group, cell, time and value; rows come in order of group.

    Rows that are not ``core`` bring readings from other blocks, with a cell and a time each.
    """
    keys = [t.column(c).combine_chunks() for c in ("source", "element", "block")]
    codes = [k.dictionary_encode().indices.to_numpy() if pa.types.is_string(k.type) else k.to_numpy() for k in keys]
    start = np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)] if t.num_rows else np.zeros(0, bool)
    group = np.cumsum(start) - 1
    core = t.column("core").to_numpy()
    heads = np.flatnonzero(start)
    own = np.minimum.reduceat(np.where(core, np.arange(t.num_rows), t.num_rows - 1), heads) if len(heads) else heads
    names = t.column("element").combine_chunks().take(pa.array(heads)).to_pylist()
    units = t.column("unit").combine_chunks().take(pa.array(own)).to_pylist()
    variable = [(n or "").split("-")[0] for n in names]
    limit = np.array([bounds(v, u) for v, u in zip(variable, units)], dtype=np.float64).astype(np.float32).reshape(-1, 3)
    data = t.column("data").combine_chunks()
    counts = np.nan_to_num(pc.list_value_length(data).to_numpy(zero_copy_only=False)).astype(np.int64)
    x = data.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    row = np.repeat(np.arange(t.num_rows), counts)
    cell = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    missing = t.column("missing").to_numpy().astype(np.float32)
    time = t.column("t").to_numpy()[row]
    if not core.all():
        far = ~core[row]
        cell[far] = t.column("cells").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        time[far] = t.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    keep = ~np.isnan(x) & (x != missing[row])
    x, row, cell, time = x[keep], row[keep], cell[keep], time[keep]
    order = np.lexsort((x, time, cell, group[row]))
    x, row, cell, time = x[order], row[order], cell[order], time[order]
    g = group[row]
    # repeated deliveries, equal in time and value, stand once in a series
    fresh = np.r_[True, (x[1:] != x[:-1]) | (time[1:] != time[:-1]) | (cell[1:] != cell[:-1]) | (g[1:] != g[:-1])] if len(x) else np.zeros(0, bool)
    lim = limit[g]
    impossible = np.isinf(x) | (x <= lim[:, 0]) | (x < lim[:, 1]) | (x > lim[:, 2])
    return {"heads": heads, "variable": np.array(variable, dtype=str), "core": core, "x": x, "row": row, "cell": cell, "time": time, "g": g, "fresh": fresh, "impossible": impossible}


def _judge(t: pa.Table) -> pa.Table:
    """The bad readings of whole groups; rows come in order of group."""
    s = _series(t)
    row, cell, fresh = s["row"], s["cell"], s["fresh"]
    resting, bursts = np.isin(s["variable"], RESTING), np.isin(s["variable"], BURSTS)
    once = np.cumsum(fresh) - 1
    sx, sg, sc, impossible = s["x"][fresh], s["g"][fresh], cell[fresh], s["impossible"][fresh]
    seg = np.cumsum(np.r_[True, (sc[1:] != sc[:-1]) | (sg[1:] != sg[:-1])]) - 1 if len(sx) else sg
    stuck = (_run_lengths(sx, seg) >= STUCK) & ~resting[sg]
    v = ~impossible
    n = int(seg[-1]) + 1 if len(seg) else 0
    burst = np.zeros(n, bool)
    burst[seg] = bursts[sg]
    jump = np.zeros(len(sx), bool)
    jump[v] = jumps(sx[v].astype(np.float64), seg[v], n, stuck[v], burst)
    hit = np.flatnonzero((impossible | stuck | jump)[once] & s["core"][row])
    why = np.select([impossible, stuck], ["impossible", "stuck"], "jump")[once][hit]
    record = t.column("record_id").to_numpy()
    return pa.table({"record_id": pa.array(record[row[hit]], pa.int64()), "element_key": t.column("element").combine_chunks().take(pa.array(row[hit])), "cell_no": pa.array(cell[hit], pa.int64()), "reason": pa.array(why, pa.string())})


def _nearest(seg: np.ndarray, plausible: np.ndarray, halo: int, last: bool) -> np.ndarray:
    """Which readings, in order of segment and time, a neighbouring block must see: of each segment's last (or first) ones so many that
    a run of equal readings is known as stuck, and ``halo`` plausible ones, among which medians and lines are taken."""
    if last:
        return _nearest(seg[::-1], plausible[::-1], halo, False)[::-1]
    if not len(seg):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    size = np.diff(np.r_[first, len(seg)])
    nth = np.arange(len(seg)) - np.repeat(first, size)
    before = np.cumsum(plausible) - plausible
    return (nth < STUCK - 1) | (plausible & (before - np.repeat(before[first], size) < halo))


def _edges(t: pa.Table, halo: int) -> pa.Table:
    """Two rows per group: what the blocks after it (side 1) and before it (side -1) must see of its cells."""
    s = _series(t)
    x, cell, time, g, plausible = (v[s["fresh"]] for v in (s["x"], s["cell"], s["time"], s["g"], ~s["impossible"]))
    seg = np.cumsum(np.r_[True, (cell[1:] != cell[:-1]) | (g[1:] != g[:-1])]) if len(x) else g
    n, out = len(s["heads"]), []
    for side in (1, -1):
        keep = _nearest(seg, plausible, halo, side == 1)
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(g[keep], minlength=n))], pa.int32())
        lists = {c: pa.ListArray.from_arrays(ends, pa.array(v[keep], kind)) for c, v, kind in (("cells", cell, pa.int32()), ("times", time, pa.int64()), ("data", x, pa.float32()), ("plausible", plausible, pa.bool_()))}
        block = t.column("block").combine_chunks().take(pa.array(s["heads"]))
        same = {c: t.column(c).combine_chunks().take(pa.array(s["heads"])) for c in ("source", "element")}
        out.append(pa.table({**same, "block": block, "side": pa.array([side] * n, pa.int32()), **lists}))
    return pa.concat_tables(out)


def _carried(batches: Iterator[pa.RecordBatch], halo: int) -> Iterator[pa.RecordBatch]:
    """From edges in order of source, element and side, and outwards from the first (side 1) or last block: for each block the readings that it must see, from as many blocks as they lie in."""
    key, held = None, []
    for b in batches:
        out = []
        columns = [b.column(c).to_pylist() for c in ("source", "element", "side", "block")]
        lists = [b.column(c) for c in ("cells", "times", "data", "plausible")]
        for k, (source, element, side, block) in enumerate(zip(*columns)):
            fresh = [c[k].values.to_numpy(zero_copy_only=False) for c in lists]
            if (source, element, side) != key:
                key, held = (source, element, side), fresh
                continue
            out.append((source, element, block, *held[:3]))
            cell, time, x, plausible = (np.concatenate(v) for v in zip(held, fresh))
            order = np.lexsort((x, time, cell))
            keep = order[_nearest(cell[order], plausible[order], halo, side == 1)]
            held = [cell[keep], time[keep], x[keep], plausible[keep]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float32()))
        names = ("source", "element", "block", "cells", "times", "data")
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)


def _whole(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``work`` on whole groups at a time: the last group of what has been read waits for the rest of its rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table) -> int:
        last = [t.column(c)[t.num_rows - 1].as_py() for c in ("source", "element", "block")]
        same = np.ones(t.num_rows, bool)
        for c, v in zip(("source", "element", "block"), last):
            col = t.column(c)
            same &= (pc.is_null(col) if v is None else pc.fill_null(pc.equal(col, v), False)).to_numpy()
        return t.num_rows - int(same.sum())

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 60_000:
            t = pa.Table.from_batches(held)
            at = cut(t)
            if at:
                yield from work(t.slice(0, at)).to_batches()
                held = t.slice(at).combine_chunks().to_batches()
                rows = t.num_rows - at
    if rows:
        yield from work(pa.Table.from_batches(held)).to_batches()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _whole(batches, _judge)


_GROUP = ["source", "element", "block"]


def _few(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= FEW else df


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame | None:
    """``rows`` with ``block``, which doesn't decrease along t, and ``split``, whether its source and element have several; None if none has.

    Blocks are cut at quantiles of t, so that they hold about equally many rows however uneven the times are, and again while one is
    too large; rows of one time stay together.
    """
    whole = lambda df: df.withColumn("block", F.lit(0).cast("long"))
    keys, levels, most = whole(rows.select("source", "element", "t")), [], block_rows

    def within(df: DataFrame, level: DataFrame, how: str) -> DataFrame:
        place = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("t"))), F.lit(0))
        return df.join(level, _GROUP, how).withColumn("block", F.col("block") * CUTS + F.when(F.col("cuts").isNull(), 0).otherwise(place))

    while True:
        sizes = keys.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).where((F.col("n") > most) & (F.col("t0") < F.col("t1"))).checkpoint()
        count = sizes.count()
        if not count:
            break
        quantiles = F.percentile_approx("t", [k / CUTS for k in range(1, CUTS)], 1000)
        large = keys.join(_few(sizes, count), _GROUP).groupBy(*_GROUP, "n", "t0").agg(quantiles.alias("q"))
        parts = F.least(F.ceil(F.col("n") / F.lit(block_rows)), F.lit(CUTS)).cast("int")
        large = large.withColumn("q", F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.element_at("q", F.round(k * CUTS / parts).cast("int"))))
        # where a quantile is the first time, that time alone makes the first part
        cuts = F.array_sort(F.array_distinct(F.transform("q", lambda c: F.greatest(c, F.col("t0") + 1))))
        level = _few(large.select(*_GROUP, cuts.alias("cuts")).checkpoint(), count)
        levels.append(level)
        keys, most = within(keys, level, "inner").select("source", "element", "t", "block"), 2 * block_rows
    if not levels:
        return None
    out = whole(rows).withColumn("split", F.lit(False))
    for level in levels:
        out = within(out, level, "left").withColumn("split", F.col("split") | F.col("cuts").isNotNull()).drop("cuts")
    return out


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition(*_GROUP).sortWithinPartitions(F.xxhash64(*_GROUP), *_GROUP)


def bad_readings(df: DataFrame, unit: Column, block_rows: int = BLOCK_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """``(record_id, element_key, cell_no, reason)`` of each bad reading of ``df`` (record_id, source_id, t in ms, element_key, spec struct<missing, data>, and what ``unit`` needs).

    Each element of a source is cut into blocks of about ``block_rows`` rows along time, so a source with a third of all rows spreads
    over the cluster. A block also sees, of each cell, the ``halo_rows`` (at least ``REACH``) plausible readings and the nine readings of any kind next to it
    on either side, however far off they lie and whatever number of blocks lies between: runs of equal readings, medians and lines are
    those of the uncut series, and so is the noise, which comes from the readings around each one. Readings that are null, NaN or the declared missing value are never
    bad. Rows with a null time or source form a series of their own, in order of record_id for a null time. Reasons: impossible, stuck, jump.
    """
    shared_checkpoints(df.sparkSession)
    halo_rows = max(halo_rows, REACH)
    rows = df.select("record_id", F.coalesce("source_id", F.lit("")).alias("source"), F.coalesce("t", F.lit(-(1 << 52))).alias("t"), F.coalesce("element_key", F.lit("")).alias("element"), unit.alias("unit"), F.coalesce("spec.missing", F.lit(float("nan"))).cast("float").alias("missing"), F.coalesce("spec.data", F.array().cast("array<float>")).alias("data"))
    placed = _blocks(rows, block_rows)
    own = (rows.withColumn("block", F.lit(0).cast("long")) if placed is None else placed.drop("split")).withColumn("core", F.lit(True))
    if placed is not None:
        cut = placed.where("split").drop("split").withColumn("core", F.lit(True))
        lists = "cells array<int>, times array<bigint>, data array<float>"
        edges = _grouped(cut).mapInArrow(partial(_whole, work=partial(_edges, halo=halo_rows)), f"source string, element string, block bigint, side int, {lists}, plausible array<boolean>")
        line = ["source", "element", "side"]
        edges = edges.repartition(*line).sortWithinPartitions(*line, F.col("block") * F.col("side"))
        halo = edges.mapInArrow(partial(_carried, halo=halo_rows), f"source string, element string, block bigint, {lists}")
        halo = halo.withColumns({"record_id": F.lit(-1).cast("long"), "t": F.lit(0).cast("long"), "missing": F.lit(float("nan")).cast("float"), "core": F.lit(False)})
        # lists of core rows are empty, not null: with nulls Spark's Arrow writer takes time in the square of a batch
        own = own.withColumns({"cells": F.array().cast("array<int>"), "times": F.array().cast("array<bigint>")}).unionByName(halo.withColumn("unit", F.lit(None).cast("string")))
    return _grouped(own).mapInArrow(_judged, "record_id bigint, element_key string, cell_no bigint, reason string")
