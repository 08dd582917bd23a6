"""Singular vectors and empirical orthogonal functions of the records of a cube, for any number of records and cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.blocks import join_same
from gridloom.sources.tables import shared_checkpoints, written

#: Up to this length of the shorter side its whole Gram matrix is formed; beyond it, the leading modes are found by iteration.
GRAM = 2048
#: Further vectors that the iteration carries beside the modes asked for, most passes, and the relative change of the eigenvalues at which it ends.
SPARE, PASSES, SETTLED = 10, 200, 1e-10
#: Rows of a Gram matrix that are summed up together, and most partial matrices before they are summed.
TILE, PARTS = 64, 64


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of ``z zᵀ`` over the column ``z``: each of a few partitions sums its own, and tiles of rows of these are summed by key."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            g += z.T @ z
        for k in range(0, width, TILE):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([g[k : k + TILE].ravel()], pa.list_(pa.float64()))})

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        total = np.sum([v.values.to_numpy() for v in t.column("v")], axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    tiles = vectors.coalesce(PARTS).select("z").mapInArrow(partial, "k int, v array<double>").groupBy("k").applyInArrow(summed, "k int, v array<double>")
    g = np.zeros((width, width))
    for r in tiles.toLocalIterator():
        g[r.k : r.k + TILE] = np.reshape(r.v, (-1, width))
    return g


def _applied(vectors: DataFrame, q: np.ndarray) -> np.ndarray:
    """``Σ z (zᵀ q)`` over the column ``z``, in one pass."""
    width, k = q.shape
    sent = vectors.sparkSession.sparkContext.broadcast(q)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros((width, k))
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            y += z.T @ (z @ sent.value)
        for j in range(k):
            yield pa.RecordBatch.from_pydict({"k": pa.array([j], pa.int32()), "v": pa.array([y[:, j]], pa.list_(pa.float64()))})

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        total = np.sum([v.values.to_numpy() for v in t.column("v")], axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros((width, k))
    for r in vectors.coalesce(PARTS).select("z").mapInArrow(partial, "k int, v array<double>").groupBy("k").applyInArrow(summed, "k int, v array<double>").toLocalIterator():
        out[:, r.k] = r.v
    sent.destroy()
    return out


def _leading(vectors: DataFrame, width: int, modes: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) of ``Σ z zᵀ``, largest first: all of them from the matrix itself up to ``whole``, else the leading ones by orthogonal iteration."""
    if width <= whole:
        values, vec = np.linalg.eigh(_gram(vectors, width))
        return np.maximum(values[::-1], 0), vec[:, ::-1]
    k = min(width, modes + SPARE)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(width, k)))[0]
    last = np.zeros(k)
    for _ in range(PASSES):
        y = _applied(vectors, q)
        values, turn = np.linalg.eigh(q.T @ y)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        if np.all(np.abs(values - last)[:modes] <= SETTLED * max(values[0], 1e-300)):
            return values[:modes], (q @ turn)[:, :modes]
        last = values
        q = np.linalg.qr(y @ turn)[0]
    return values[:modes], (q @ turn)[:, :modes]


@dataclass
class Eof:
    """EOFs of records.

    ``field`` (row, cells, value) holds the cells that no record misses, ``stats`` (cells, mean, factor) what is taken off and
    multiplied, ``loadings`` (cells, mode, eof) unit vectors whose largest component is positive, and ``values`` the eigenvalues of the
    covariance, all of them where a whole Gram matrix was formed, else the leading ones; ``total`` is the sum of all.
    """

    field: DataFrame
    stats: DataFrame
    loadings: DataFrame
    row: str
    cells: list[str]
    values: np.ndarray
    total: float
    n: int
    ddof: int
    modes: int

    @staticmethod
    def fit(df: DataFrame, row: str, cells: list[str], value: str, modes: int = 9, centre: bool = True, scale: bool = False, weights: dict | Column | None = None, ddof: int = 1, whole: int = GRAM) -> Eof:
        """``weights`` maps a tuple of cell keys to a factor, or is a column of them (ignored with ``scale``). Constant cells scale to 0. The covariance divides by records less ``ddof``.

        Cells with a missing value in any record are left out, as their column has no covariance. The Gram matrix is that of the
        shorter side, records or cells, so a globe of any number of cells over a few records needs a small one; if both sides are
        longer than ``whole``, the leading modes come from orthogonal iteration. What reaches the driver is the shorter side times the modes.
        """
        spark = df.sparkSession
        shared_checkpoints(spark)
        # computed once, as counting, centring and each pass of the fit read it
        named = written(df.select(row, *cells, F.col(value).cast("double").alias("value")))
        n = named.select(row).distinct().count()
        v = F.col("value")
        full = named.where(v.isNotNull()).groupBy(*cells).agg(F.count_distinct(row).alias("_n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("_dev"))
        full = full.where(F.col("_n") == n)
        centred = F.col("mean") if centre else F.lit(0.0)
        if scale:
            dev = F.coalesce("_dev", F.lit(0.0))
            factor = F.when(dev > 1e-12 * F.greatest(F.lit(1.0), F.abs("mean")), 1 / dev).otherwise(0.0)
        elif isinstance(weights, dict):
            kinds = [f for f in named.schema.fields if f.name in cells]
            table = spark.createDataFrame([(*k, float(w)) for k, w in weights.items()], T.StructType([*sorted(kinds, key=lambda f: cells.index(f.name)), T.StructField("_w", T.DoubleType())]))
            full, factor = full.join(table, cells, "left"), F.coalesce("_w", F.lit(1.0))
        else:
            factor = weights if weights is not None else F.lit(1.0)
        stats = written(full.select(*cells, centred.alias("mean"), factor.cast("double").alias("factor")))
        width = stats.count()
        if n <= ddof or not width:
            raise ValueError("too few records or no complete cell")
        field = join_same(named, stats, cells)
        z = field.select(row, *cells, ((v - F.col("mean")) * F.col("factor")).alias("_z"))
        by_cell = n <= width
        side, inner = (cells, [row]) if by_cell else ([row], cells)
        # in the other key's order, which is the same in each vector, as no record misses a cell
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(*inner, "_z"))), lambda s: s._z)
        vectors = written(z.groupBy(*side).agg(ordered.alias("z")))
        total = vectors.select(F.sum(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))).first()[0] / (n - ddof)
        size = min(n, width)
        modes = min(modes, size)
        values, vec = _leading(vectors, size, modes, whole)
        values = values / (n - ddof)
        vec = vec[:, :modes]
        if by_cell:
            # a cell's loading is its vector's share in each series
            root = np.sqrt(np.maximum(values[:modes] * (n - ddof), 1e-300))
            names = [*cells, "mode", "eof"]
            kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in cells)

            def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
                    e = (x @ vec) / root
                    at = pa.array(np.repeat(np.arange(b.num_rows), modes))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(b.num_columns - 1)), pa.array(np.tile(np.arange(modes, dtype=np.int32), b.num_rows)), pa.array(e.ravel())], names)

            loadings = vectors.select(*cells, "z").mapInArrow(spread, f"{kinds}, mode int, eof double")
        else:
            keys = sorted(tuple(r) for r in stats.select(*cells).collect())
            kinds = T.StructType([*(named.schema[c] for c in cells), T.StructField("mode", T.IntegerType()), T.StructField("eof", T.DoubleType())])
            loadings = spark.createDataFrame([(*k, m, float(vec[j, m])) for j, k in enumerate(keys) for m in range(modes)], kinds)
        peak = loadings.groupBy("mode").agg(F.signum(F.max_by("eof", F.struct(F.abs("eof"), F.struct(*cells)))).alias("_sign"))
        loadings = written(loadings.join(F.broadcast(peak), "mode").select(*cells, "mode", (F.col("eof") * F.col("_sign")).alias("eof")))
        return Eof(field, stats, loadings, row, cells, values[:size], float(total or 0.0), n, ddof, modes)

    def variance_fractions(self) -> np.ndarray:
        return self.values[: self.modes] / self.total if self.total else np.zeros(self.modes)

    def total_variance(self) -> float:
        return self.total

    def north_test(self, scaled: bool = False) -> np.ndarray:
        """Typical errors of the eigenvalues, or of the variance fractions if ``scaled``."""
        base = self.variance_fractions() if scaled else self.values[: self.modes]
        return base * np.sqrt(2 / self.n)

    def _scaled(self, c: Column, scaling: int, invert: bool) -> Column:
        """``c`` divided (1) by or multiplied (2) with the root of the eigenvalue of its mode."""
        if scaling not in (0, 1, 2):
            raise ValueError("scaling is 0, 1 or 2")
        root = F.element_at(F.array(*[F.lit(float(np.sqrt(max(v, 1e-300)))) for v in self.values[: self.modes]]), F.col("mode") + 1)
        return c if scaling == 0 else c / root if (scaling == 1) != invert else c * root

    def components(self, rows: DataFrame | None = None, scaling: int = 0) -> DataFrame:
        """``(row, mode, pc)`` of these or other records (row, cells, value) over the same cells; scaling 1 divides by, 2 multiplies with the root of the eigenvalue. Other records must have a value in each cell, else their component is null."""
        z = self.field if rows is None else join_same(rows.select(self.row, *self.cells, F.col("value").cast("double").alias("value")), self.stats, self.cells)
        parts = join_same(z.select(self.row, *self.cells, ((F.col("value") - F.col("mean")) * F.col("factor")).alias("_z")), self.loadings, self.cells)
        width = F.count("_z")
        sums = parts.groupBy(self.row, "mode").agg(F.sum(F.col("_z") * F.col("eof")).alias("pc"), width.alias("_n"))
        pc = F.col("pc") if rows is None else F.when(F.col("_n") == self.stats.count(), F.col("pc"))
        return sums.select(self.row, "mode", self._scaled(pc, scaling, False).alias("pc"))

    def maps(self, scaling: int = 0) -> DataFrame:
        """``(*cells, mode, eof)``: the loadings, divided (1) or multiplied (2) by the root of the eigenvalue."""
        return self.loadings.select(*self.cells, "mode", self._scaled(F.col("eof"), scaling, False).alias("eof"))

    def related(self, kind: str = "correlation") -> DataFrame:
        """``(*cells, mode, r)``: the correlation or covariance of each component with the field at each cell."""
        both = self.field.select(self.row, *self.cells, "value").join(self.components(scaling=1), self.row)
        agg = F.corr("pc", "value") if kind == "correlation" else F.covar_samp("pc", "value")
        return both.groupBy(*self.cells, "mode").agg(agg.alias("r"))

    def reconstructed(self, modes: list[int] | int) -> DataFrame:
        """``(row, *cells, value)``: the field from some modes, with weights, scale and mean put back."""
        chosen = list(range(modes)) if isinstance(modes, int) else modes
        pc = self.components().where(F.col("mode").isin(chosen))
        parts = pc.join(self.loadings.where(F.col("mode").isin(chosen)), "mode").groupBy(self.row, *self.cells).agg(F.sum(F.col("pc") * F.col("eof")).alias("_z"))
        back = F.when(F.col("factor") == 0, 0.0).otherwise(F.col("_z") / F.col("factor")) + F.col("mean")
        return join_same(parts, self.stats, self.cells).select(self.row, *self.cells, back.alias("value"))


def row_vectors(df: DataFrame, row: str, cells: list[str], value: str) -> DataFrame:
    """``(row, vec)``: the values of each record as one array in order of its cells, missing ones as nulls. Records have as many entries as cells occur in them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*cells, F.col(value).cast("double").alias("_v")))), lambda s: s._v)
    return df.groupBy(row).agg(ordered.alias("vec"))


def vector_cells(df: DataFrame, row: str, vector: str) -> DataFrame:
    """``(row, pos, value)``: the entries of array records as cells."""
    return df.select(row, F.posexplode(vector).alias("pos", "value"))


def rescaled_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, pos, value)``: each component of array records less its mean over the records, divided by its sample deviation (0 for a constant one)."""
    cells = df.select(key, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    stats = cells.groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return cells.join(stats, "pos").select(key, "pos", F.when(F.coalesce("s", F.lit(0.0)) == 0, 0.0).otherwise((F.col("v") - F.col("m")) / F.col("s")).alias("value"))
