"""Whitening of vectors by their leading principal components, from a covariance that is summed in double-double.

Entries become whole numbers x = floor(SCALE * entry) + SHIFT. Three passes over the vectors, each one map over
batches whose sums meet in a tree of tasks:

1. n and the exact sums S of each dimension, as whole numbers.
2. The covariance. x - S/n is an unevaluated sum of two doubles (the mean is one, too). A block's outer products are
   added without error: the centred numbers are split into slices of so few bits that products of slices, and their
   sums over a block, are whole numbers below 2**53, so that matrix products of slices are exact. These go into
   double-double sums by error-free additions, and tasks hand on high and low parts, which are added in the same way.
3. The covariance of the whitened numbers, by blocks centred on their own mean, for `identity_error`.

Between them the driver takes eigenpairs of one matrix of dimension x dimension numbers (`eigen`: tridiagonal form, divide
and conquer, one refinement in extended precision that reads the low parts too). The components are sent with the tasks.

Left out: vectors that are null, empty, or hold null, NaN or infinite entries, and vectors of another length than most
vectors have (of equally frequent lengths the smaller one is taken). SCALE * entry is held within 2**51 in size, beyond which x
is no exact double. Repeated rows count each; vec_id may be null or repeated and of any type; other columns are not
read. An empty table gives an empty result. Components along which nothing varies (eigenvalues not above the rounding
of the largest) have whitened null and do not enter `identity_error`. `deviation` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, given_back
from .eigen import EPS, eigenpairs

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 51)
#: Vectors whose outer products are summed at once, and the bits of a slice: ROWS * 2**(2 * BITS) is below 2**53.
ROWS, BITS, SLICES = 1024, 21, 3
#: Tasks whose sums are added by one task; two levels.
FAN = 512


def whole_vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and x (as doubles) of a batch's vectors of `size` finite entries."""
    column = batch.column("vector")
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    flat = column.filter(pa.array(fits)).flatten().cast(pa.float64())
    values = np.asarray(pc.fill_null(flat, float("nan"))).reshape(-1, size)
    good = np.isfinite(values).all(axis=1)
    return np.flatnonzero(fits)[good], np.floor(np.clip(SCALE * values[good], -LARGEST, LARGEST)) + SHIFT


def lengths(batch: pa.RecordBatch) -> list[int]:
    return [n for n in pc.unique(pc.list_value_length(batch.column("vector"))).to_pylist() if n]


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors of the most frequent length, and the sum of x in each dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for size in lengths(batch):
                _, x = whole_vectors(batch, size)
                n[size] = n.get(size, 0) + len(x)
                total[size] = total.get(size, np.zeros(size, np.int64)) + x.astype(np.int64).sum(axis=0)
        for size in n:
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n[size]] * size, pa.int64()), pa.array(total[size])], ["size", "dim", "n", "total"])

    rows = vectors.mapInArrow(lambda batches: given_back(summed(batches)), "size int, dim int, n bigint, total bigint")
    of = cut(rows.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    best = of.where("dim = 0 and n > 0").orderBy(F.desc("n"), "size").first()
    if best is None:
        return 0, []
    return best["n"], [r["total"] for r in of.where(F.col("size") == best["size"]).orderBy("dim").collect()]  # one row a dimension


@dataclass(frozen=True)
class Mean:
    """n, the sums, and S/n as high and low parts."""

    n: int
    sums: np.ndarray
    high: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, n: int, total: list[int]) -> Mean:
        high = [s / n for s in total]
        low = [float((Fraction(s) - Fraction(h) * n) / n) for s, h in zip(total, high, strict=True)]
        return cls(n, np.array(total, np.int64), np.array(high), np.array(low))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n as high and low parts."""
        high, low = two_sum(x, -self.high)
        return two_sum(high, low - self.low)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums: (high, low) + (more, rest)."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(rest, low.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Whole-number slices of the columns, each BITS bits below the one before, and the unit of the first slice in each column (a power of two)."""
    most = np.abs(high).max(axis=0)
    unit = np.ldexp(1.0, np.frexp(most)[1] - BITS)
    out, step = [], unit.copy()
    for k in range(SLICES):
        whole = np.rint(high / step)
        out.append(whole)
        high = high - whole * step
        if k == 0:
            high, low = two_sum(high, low)
        step = step * 2.0**-BITS
    return out, unit


def products(high: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices that sum up to the outer products of the rows of high + low, each free of error; what is left out is below 2**-63 of the largest entries."""
    parts, unit = sliced(high, low)
    scale = np.outer(unit, unit)
    for i in range(SLICES):
        for j in range(i, SLICES - i):
            g = parts[i].T @ parts[j]
            yield (g if i == j else g + g.T) * 2.0 ** (-BITS * (i + j)) * scale


def tree(rows: DataFrame, keys: list[str], add: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Sums of the rows of each key over `part` (the task that made them), FAN tasks at a time and then all."""
    for part in (F.floor(F.col("part") / FAN).cast("int"), F.lit(0)):
        rows = rows.withColumn("part", part).groupBy(*keys, "part").applyInArrow(add, rows.schema)
    return rows


def covariance(vectors: DataFrame, mean: Mean) -> np.ndarray:
    """The covariance of x (divisor n), in extended precision."""
    size = len(mean.sums)
    kind = "dim int, part int, high array<double>, low array<double>"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = np.zeros((size, size))
        for batch in batches:
            _, x = whole_vectors(batch, size)
            for at in range(0, len(x), ROWS):
                for m in products(*mean.centred(x[at : at + ROWS])):
                    high, low = added(high, low, m)
        yield record(range(size), TaskContext.get().partitionId(), high, low)

    def record(dims, part: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(dims), pa.int32()), pa.array([part] * len(high), pa.int32()), pa.array(list(high), pa.list_(pa.float64())), pa.array(list(low), pa.list_(pa.float64()))], ["dim", "part", "high", "low"])

    def add(table: pa.Table) -> pa.Table:
        high = low = np.zeros(size)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("high", "low")), strict=True))  # in an order that does not depend on the shuffle
        for h, l in rows:  # noqa: E741
            high, low = added(high, low, np.array(h), np.array(l))
        return pa.Table.from_batches([record([table["dim"][0].as_py()], table["part"][0].as_py(), high[None, :], low[None, :])])

    rows = vectors.mapInArrow(lambda batches: given_back(summed(batches)), kind)
    found = tree(rows, ["dim"], add).orderBy("dim").select("high", "low").collect()  # one row a dimension
    high, low = (np.array([r[k] for r in found], np.float64).astype(np.longdouble) for k in (0, 1))
    whole = (high + low) / mean.n
    return (whole + whole.T) / 2


@dataclass(frozen=True)
class Model:
    """What turns vectors into whitened numbers; `scale` is 0 for components along which nothing varies."""

    mean: Mean
    components: np.ndarray
    scale: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, mean: Mean, cov: np.ndarray, most: int) -> Model:
        values, vectors = eigenpairs(cov)
        trace = float(np.trace(cov))
        kept, varies = values[:most], values[:most] > len(cov) * EPS * max(values[0], 0)
        scale = np.where(varies, 1 / np.sqrt(np.where(varies, kept, 1)), 0.0)
        return cls(mean, np.ascontiguousarray(vectors[:, :most]), scale, np.where(varies, kept, 0.0) / (trace or 1.0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.mean.centred(x)
        return (high @ self.components + low @ self.components) * self.scale

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - S)**2; arithmetic modulo 2**64 is exact wherever the sum fits."""
        with np.errstate(over="ignore"):
            own = self.mean.n * x.astype(np.int64) - self.mean.sums
            exact = (own * own).sum(axis=1)
        near = ((self.mean.n * (x - self.mean.high)) ** 2).sum(axis=1)
        return pa.array(exact, mask=near > 9.2e18)


def identity_error(vectors: DataFrame, model: Model) -> float:
    """The largest entry of the whitened numbers' covariance (divisor n) minus the identity."""
    own = np.flatnonzero(model.scale)
    size, kind = len(model.mean.sums), "part int, n bigint, mean array<double>, products array<double>"

    def joined(a: tuple, b: tuple) -> tuple:
        """Counts, means and centred products of two lots together."""
        n = a[0] + b[0]
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def record(part: int, lot: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lot[0]], pa.int64()), pa.array([lot[1].tolist()], pa.list_(pa.float64())), pa.array([lot[2].ravel().tolist()], pa.list_(pa.float64()))], ["part", "n", "mean", "products"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = None
        for batch in batches:
            y = model.whitened(whole_vectors(batch, size)[1])[:, own]
            for at in range(0, len(y), ROWS):
                block = y[at : at + ROWS]
                mean = block.mean(axis=0)
                one = (len(block), mean, (block - mean).T @ (block - mean))
                lot = one if lot is None else joined(lot, one)
        if lot:
            yield record(TaskContext.get().partitionId(), lot)

    def add(table: pa.Table) -> pa.Table:
        lots = sorted(zip(*(table.column(c).to_pylist() for c in ("n", "mean", "products")), strict=True))
        lot = None
        for n, mean, m in lots:
            one = (n, np.array(mean), np.array(m).reshape(len(mean), -1))
            lot = one if lot is None else joined(lot, one)
        return pa.Table.from_batches([record(table["part"][0].as_py(), lot)])

    if not len(own):
        return 0.0
    n, m = tree(vectors.mapInArrow(lambda batches: given_back(summed(batches)), kind), [], add).select("n", "products").first()
    return float(np.abs(np.array(m).reshape(len(own), -1) / n - np.eye(len(own))).max())


def fitted(vectors: DataFrame, most: int = COMPONENTS) -> Model | None:
    """The model of all vectors (a column `vector`); nothing without vectors."""
    n, total = sums(vectors)
    if not n:
        return None
    mean = Mean.of(n, total)
    return Model.of(mean, covariance(vectors, mean), most)


def whitened(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every vector and component."""
    own = rows.select(F.col(ident).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = f"vec_id {rows.schema[ident].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double"
    model = fitted(own.select("vector"), most)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"{kind}, identity_error double")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.scale)
        for batch in batches:
            at, x = whole_vectors(batch, len(model.mean.sums))
            place = pa.array(np.repeat(np.arange(len(at)), k))
            y, many = model.whitened(x), len(at)
            columns = [batch.column("vec_id").take(pa.array(at)).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, model.mean.n, np.int64)), model.deviation(x).take(place), pa.array(y.ravel(), mask=np.tile(model.scale == 0, many)), pa.array(np.tile(model.explained, many))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    error = identity_error(own.select("vector"), model)
    return own.mapInArrow(lambda batches: given_back(projected(batches)), kind).withColumn("identity_error", F.lit(error))
