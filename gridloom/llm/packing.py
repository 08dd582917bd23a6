"""Items of varying size in containers of fixed capacity with little unused space."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import shared_checkpoints

#: Containers per block, islands per block, rounds between migrations, and each island's individuals and crossovers a round.
BLOCK_BINS, ISLANDS, ROUNDS, POPULATION, CROSSOVERS = 64, 2, 2, 12, 100
#: Islands of blocks per task of the first round.
TASK_BLOCKS = 32
#: A container filled less than this goes to the next level, where those of many blocks are packed anew.
FULL = 0.97
#: Items without a bin, and items of one bin, that an exchange chooses among; of more, as many that are evenly spread.
FREE, HELD = 64, 16


class Packing:
    """One solution: the bin of each item, and what each bin holds."""

    __slots__ = ("bins", "fills", "fitness")

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int, fills: list[int] | None = None):
        self.bins = bins
        self.fills = [sum(map(sizes.__getitem__, b)) for b in bins] if fills is None else fills
        self.fitness = sum([f * f for f in self.fills]) / (capacity * capacity * max(len(bins), 1))


def best_fit(bins: list[list[int]], fills: list[int], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """``bins`` with ``items`` put, largest first, each into the fullest bin that it fits; new bins where none does. ``fills`` follows."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
            fills[b] += sizes[i]
        else:
            free, b = capacity, len(bins)
            bins.append([i])
            fills.append(sizes[i])
        insort(room, (free - sizes[i], b))
    return bins


def _spread(n: int, most: int) -> list[int]:
    return list(range(n)) if n <= most else [k * n // most for k in range(most)]


_NOTHING = np.zeros(1, np.int64)


@lru_cache(maxsize=256)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def exchanged(bins: list[list[int]], fills: list[int], free: list[int], sizes: list[int], capacity: int) -> list[int]:
    """What is free after each bin with room gave none, one or two of its items for one or two of ``free`` that come closest to filling it; ``bins`` and ``fills`` are changed."""
    changed = True
    for b, x in enumerate(bins):
        room = capacity - fills[b]
        if room <= 0 or not free:
            continue
        if changed:
            near = _spread(len(free), FREE)
            one = np.array([sizes[free[k]] for k in near], np.int64)
            i, j = _pairs(len(near))
            sums = np.concatenate([_NOTHING, one, one[i] + one[j]])
            ordered, changed = sums.copy(), False
            ordered.sort()
        held = _spread(len(x), HELD)
        own = [sizes[x[p]] for p in held]
        less = np.array([0, *own, *map(sum, combinations(own, 2))], np.int64)
        gain = ordered[ordered.searchsorted(less + room, "right") - 1] - less
        best = int(gain.argmax())
        if gain[best] <= 0:
            continue
        k = int((sums == gain[best] + less[best]).argmax()) - 1
        taken = {near[k]} if k < len(near) else {near[i[k - len(near)]], near[j[k - len(near)]]}
        out = [(), *((p,) for p in held), *combinations(held, 2)][best]
        bins[b] = [y for p, y in enumerate(x) if p not in out] + [free[t] for t in sorted(taken)]
        free = [y for t, y in enumerate(free) if t not in taken] + [x[p] for p in out]
        fills[b] += int(gain[best])
        changed = True
    return free


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """A child of ``a`` with whole well-filled bins of ``b``: bins of ``a`` that hold any of their items go, and so do the emptiest and two more that aren't full; bins with room exchange items with those displaced by that, and the rest are put back by best fit."""
    count = len(b.bins)
    by_fill = sorted(range(count), key=b.fills.__getitem__, reverse=True)[: max(1, count // 2)]
    taken = rng.permutation(by_fill)[: max(1, count // 16)].tolist()
    injected = [list(b.bins[k]) for k in taken]
    present = {i for x in injected for i in x}
    bins, fills, displaced = injected, [b.fills[k] for k in taken], []
    weak = min(a.fills) if a.fills else 0
    more = rng.integers(0, max(1, len(a.bins)), 2).tolist()
    for k, (x, f) in enumerate(zip(a.bins, a.fills)):
        if not present.isdisjoint(x):
            displaced += [i for i in x if i not in present]
        elif f < capacity and (f == weak or k in more):
            displaced += x
        else:
            bins.append(list(x))
            fills.append(f)
    displaced = exchanged(bins, fills, displaced, sizes, capacity)
    return Packing(best_fit(bins, fills, displaced, sizes, capacity), sizes, capacity, fills)


def evolve(sizes: list[int], capacity: int, start: list[list[list[int]]], population: int, crossovers: int, seed: int) -> list[Packing]:
    """The individuals, best first, after ``crossovers`` steps that each replace the worst individual by a better child that is like no other; ``start`` holds immigrants. Only a best individual that can't be bettered ends it before."""
    rng = np.random.default_rng(seed)
    items = list(range(len(sizes)))
    least = max(1, math.ceil(sum(sizes) / capacity))
    people = list({p.fitness: p for p in (Packing([list(x) for x in s], sizes, capacity) for s in start)}.values())
    while len(people) < population:
        if not people:
            first = best_fit([], [], items, sizes, capacity)
        else:  # an order of its own: some bins of the best kept, the rest put back after a random share was placed first
            base = people[0]
            keep = rng.random(len(base.bins)) < 0.5
            bins = [list(x) for x, k in zip(base.bins, keep) if k]
            loose = [i for x, k in zip(base.bins, keep) if not k for i in x]
            picked = [i for i, p in zip(loose, rng.random(len(loose)) < 0.3) if p]
            rest = list(set(loose) - set(picked))
            bins = best_fit(bins, [sum(sizes[i] for i in x) for x in bins], picked, sizes, capacity)
            first = best_fit(bins, [sum(sizes[i] for i in x) for x in bins], rest, sizes, capacity)
        people.append(Packing(first, sizes, capacity))
    people.sort(key=lambda p: -p.fitness)
    for _ in range(crossovers):
        if len(people[0].bins) <= least and people[0].fills.count(capacity) >= len(people[0].bins) - 1:
            break  # as few bins as the sum allows, and all but one full to the last unit
        x, y = rng.permutation(len(people))[:2] if len(people) > 1 else (0, 0)
        child = crossover(people[x], people[y], sizes, capacity, rng)
        if child.fitness > people[-1].fitness and all(child.fitness != p.fitness for p in people):
            people[-1] = child
            people.sort(key=lambda p: -p.fitness)
    return people[:population]


def _encode(p: Packing, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, x in enumerate(p.bins):
        out[x] = b
    return out


def _decode(assigned: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1 if len(assigned) else 0)]
    for i, b in enumerate(assigned.tolist()):
        bins[b].append(i)
    return [x for x in bins if x]


_ISLAND = "block bigint, island int, ids array<string>, sizes array<bigint>, bins array<array<int>>, fitness double"


def _first(capacity: int, population: int, crossovers: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        block, island = (k.as_py() for k in key)
        order = pc.sort_indices(t, sort_keys=[("size", "descending"), ("item", "ascending")])
        ids, sizes = t.column("item").take(order).to_pylist(), t.column("size").take(order).to_pylist()
        people = evolve(sizes, capacity, [], population, crossovers, (block * 131 + island * 7919) % (1 << 31))
        return pa.table({"block": [block], "island": pa.array([island], pa.int32()), "ids": pa.array([ids], pa.list_(pa.string())), "sizes": [sizes], "bins": pa.array([[_encode(p, len(sizes)) for p in people]], pa.list_(pa.list_(pa.int32()))), "fitness": [people[0].fitness]})

    return run


def _further(capacity: int, population: int, crossovers: int, turn: int):
    """One round of the islands after migration: a row that is at home brings its population, a migrant its best individuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                start = [_decode(np.asarray(x, np.int32)) for x in r["migrants"] + r["bins"]]
                seed = (r["block"] * 131 + r["island"] * 7919 + turn * 104729) % (1 << 31)
                people = evolve(r["sizes"], capacity, start, max(population, len(start)), crossovers, seed)[:population]
                yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int64()), "island": pa.array([r["island"]], pa.int32()), "ids": pa.array([r["ids"]], pa.list_(pa.string())), "sizes": pa.array([r["sizes"]], pa.list_(pa.int64())), "bins": pa.array([[_encode(p, len(r["sizes"])) for p in people]], pa.list_(pa.list_(pa.int32()))), "fitness": [people[0].fitness]})

    return run


def _level(items: DataFrame, capacity: int, level: int, islands: int, rounds: int, population: int, crossovers: int) -> DataFrame:
    """``(item, size, container, fill)`` of one level's items (item, size), each at most ``capacity``."""
    total = items.agg(F.sum("size"), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil(max((total[0] or 0) / capacity / BLOCK_BINS, total[1] / (BLOCK_BINS * 64))))
    placed = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks))).withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    # a block is little data but much work, so tasks are cut by the number of blocks
    state = placed.repartition(math.ceil(blocks * islands / TASK_BLOCKS), "block", "island").groupBy("block", "island").applyInArrow(_first(capacity, population, crossovers), _ISLAND)
    for turn in range(1, rounds):
        state = state.checkpoint()
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("bins", 1, 2).alias("migrants"))
        state = state.join(elite, ["block", "island"]).mapInArrow(_further(capacity, population, crossovers, turn), _ISLAND)
    best = state.groupBy("block").agg(F.max_by(F.struct("ids", "sizes", F.col("bins")[0].alias("b")), F.struct("fitness", F.col("island"))).alias("s"))
    rows = best.select("block", F.explode(F.arrays_zip(F.col("s.ids").alias("item"), F.col("s.sizes").alias("size"), F.col("s.b").alias("bin"))).alias("z")).select("block", "z.item", "z.size", "z.bin")
    rows = rows.withColumn("container", F.format_string("%d-%d-%d", F.lit(level), "block", "bin")).drop("bin").checkpoint()
    fills = rows.groupBy("block", "container").agg(F.sum("size").alias("fill"))
    return rows.join(fills.drop("block"), "container").select("item", "size", "container", "fill")


def packed(sizes: DataFrame, key: str, size: str, capacity: int, islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION, crossovers: int = CROSSOVERS) -> DataFrame:
    """``(key, piece_no, first, n, container)``: the container of each item, or of each piece of an item larger than ``capacity``.

    ``first`` and ``n`` tell which units of the item a piece holds; only items over the capacity have several pieces, all but the
    last as large as a container. A grouping genetic algorithm packs blocks of items, chosen by hash and sized by the capacity, on
    several islands whose best individuals migrate between rounds; containers that stay too empty are packed anew, those of many
    blocks together, as long as that takes fewer of them. Items of size 0 or null size take no room, and each is put into some
    container all the same. Repeated keys are items of their own. An empty table gives no rows. Containers are called by texts, which
    depend on keys and sizes only, so a lost task, or another partitioning, yields the same again.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    shared_checkpoints(sizes.sparkSession)
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    # equal keys of equal size are told apart by a number; they are counted, so a key that is repeated often is no hot key
    copies = sizes.select(F.col(key).alias("_key"), n.alias("_n")).groupBy("_key", "_n").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    name = F.format_string("%s/%d/%d", F.coalesce(F.col("_key").cast("string"), F.lit("\0")), "_n", "_copy")
    numbered = copies.select("_key", "_n", name.alias("item")).checkpoint()
    pieces = numbered.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.withColumns({"first": F.col("piece").cast("bigint") * capacity, "n": F.least(F.col("_n") - F.col("piece").cast("bigint") * capacity, F.lit(capacity).cast("bigint"))})
    # what fills a container by itself has one of its own
    done = [pieces.where(F.col("n") == capacity).select("item", "piece", F.format_string("whole-%s-%d", "item", "piece").alias("container"))]
    last = F.floor(F.col("_n") / capacity).cast("int")
    todo = numbered.where((F.col("_n") % capacity != 0) | (F.col("_n") == 0)).select("item", (F.col("_n") % capacity).alias("size"))
    ended, level = [], 0
    while True:
        out = _level(todo, capacity, level, islands, rounds, population, crossovers).checkpoint()
        slack = out.where(F.col("fill") < FULL * capacity)
        left, least = slack.agg(F.count_distinct("container"), F.sum("size")).first()
        # as few as their sum allows, or no fewer than they were: packing them again gains nothing
        if left <= max(1, math.ceil((least or 0) / capacity)) or (level and left >= before):
            ended.append(out)
            break
        ended.append(out.where(F.col("fill") >= FULL * capacity))
        todo, before, level = slack.select("item", "size"), left, level + 1
    for out in ended:
        done.append(out.join(numbered.select("item", last.alias("piece")), "item").select("item", "piece", "container"))
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    return pieces.join(all_, ["item", "piece"]).select(F.col("_key").alias(key), F.col("piece").alias("piece_no"), "first", "n", "container")
