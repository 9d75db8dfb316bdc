"""Least squares in closed form: moments and Gram matrix by distributed sums, the small solve on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions.scalar import clip

#: Penalties to try, and the rows below which they are judged on all rows (fixed values).
LAMBDAS = (1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3, 1e4)
LEAST_TRAINING, LEAST_HELD_OUT = 50, 10


def moments(df: DataFrame, columns: Sequence[str], floor: float = 1e-8) -> DataFrame:
    """One row per column: n, mean, sd (of the whole population; 1 where it is below ``floor``)."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))
    sd = F.stddev_pop("x")
    return df.select(F.inline(cells)).groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.when(sd < floor, 1.0).otherwise(sd).alias("sd"))


@dataclass(frozen=True)
class Packed:
    """A feature vector in one array column, for widths at which a column each would burden the planner."""

    name: str
    width: int


def _vector(columns: Sequence[str] | Packed, *more: Column) -> Column:
    own = F.col(columns.name) if isinstance(columns, Packed) else F.array(*(F.col(c).cast("double") for c in columns))
    return F.concat(own, F.array(*more)) if more else own


def _products(d: int, parts: int):
    """For mapInArrow: per part the products X'X of the task's rows, one row of the matrix a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), d)
            recorded, part = np.isfinite(x).all(1), batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(parts):
                own = x[recorded & (part == k)]
                sums[k] += own.T @ own
        at = [(k, i) for k in range(parts) for i in range(d) if sums[k, i].any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in at], pa.int32()), "i": pa.array([i for _, i in at], pa.int32()), "v": pa.array([sums[k, i] for k, i in at], pa.list_(pa.float64()))})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over whole (part, i): their arrays added up."""
    known: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = v.values.to_numpy(zero_copy_only=False)
            known[k, i] = known[k, i] + x if (k, i) in known else x
    yield pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in known], pa.int32()), "i": pa.array([i for _, i in known], pa.int32()), "v": pa.array(list(known.values()), pa.list_(pa.float64()))})


def product_rows(df: DataFrame, vector: Column, width: int, part: Column | None = None, parts: int = 1) -> DataFrame:
    """part, i, v: row ``i`` of X'X of each part (0 to ``parts`` - 1), from vectors whose entries are all finite numbers.

    A matrix product per Arrow batch, one partial matrix a task, and rows of it added up as arrays:
    the width is no matter for the plan.
    """
    rows = df.select(vector.alias("x"), (F.lit(0) if part is None else part).cast("int").alias("part")).filter(F.col("x").isNotNull())
    return rows.mapInArrow(_products(width, parts), "part int, i int, v array<double>").repartition("part", "i").mapInArrow(_added, "part int, i int, v array<double>")


def gram(df: DataFrame, columns: Sequence[str] | Packed, names: Sequence[str] | None = None) -> DataFrame:
    """i, j, v = sum of the products of columns i <= j over the rows in which all of them are recorded."""
    names = list(names or columns)
    listed = F.array(*(F.lit(c) for c in names))
    cells = product_rows(df, _vector(columns), len(names)).select(F.col("i").alias("_i"), F.posexplode("v").alias("_j", "v")).filter(F.col("_i") <= F.col("_j"))
    return cells.select(F.get(listed, F.col("_i")).alias("i"), F.get(listed, F.col("_j")).alias("j"), "v")


@dataclass
class Ridge:
    columns: Sequence[str] | Packed
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    bias: float
    penalty: float
    holdout_rmse: float | None = None

    def predict(self, low: float | None = None, high: float | None = None) -> Column:
        if isinstance(self.columns, Packed):
            slope = self.weights / self.sd
            start = float(self.bias - (self.mean * slope).sum())
            out = F.aggregate(F.zip_with(self.columns.name, F.array(*(F.lit(float(w)) for w in slope)), lambda x, w: x * w), F.lit(start), lambda t, v: t + v)
        else:
            out = F.lit(float(self.bias))
            for c, m, s, w in zip(self.columns, self.mean, self.sd, self.weights, strict=True):
                out = out + (F.col(c) - float(m)) / float(s) * float(w)
        return out if low is None else clip(out, low, high)


def _width(columns: Sequence[str] | Packed) -> int:
    return columns.width if isinstance(columns, Packed) else len(columns)


def _sums(df: DataFrame, columns: Sequence[str] | Packed, y: str, out: Column | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """n, sums and products of (columns, y), of the rows that ``out`` is false for and of those it is true for, from one pass."""
    d = _width(columns) + 1
    part = F.lit(0) if out is None else F.coalesce(out.cast("int"), F.lit(0))
    found = np.zeros((2, d + 1, d + 1))
    for r in product_rows(df, _vector(columns, F.col(y).cast("double"), F.lit(1.0)), d + 1, part, 2).collect():  # d + 1 rows a part
        found[r.part, r.i] = r.v
    return [(float(p[d, d]), p[d, :d], p[:d, :d]) for p in found]


def _solve(n: float, s: np.ndarray, p: np.ndarray, columns: Sequence[str] | Packed, penalty: float) -> Ridge:
    d = _width(columns)
    mean = s / max(n, 1.0)
    cov = p / max(n, 1.0) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0.0))
    sd = np.where(sd < 1e-8, 1.0, sd)
    a = cov[:d, :d] / np.outer(sd, sd) * n + penalty * np.eye(d)
    return Ridge(columns, mean[:d], sd, np.linalg.solve(a, cov[:d, d] / sd * n), float(mean[d]), penalty)


def _rmse(m: Ridge, n: float, s: np.ndarray, p: np.ndarray) -> float:
    """From sums alone: the error is linear in (columns, y)."""
    u = np.append(m.weights / m.sd, -1.0)
    c = m.bias - float((m.mean * m.weights / m.sd).sum())
    return float(np.sqrt(max(0.0, (u @ p @ u + 2 * c * (u @ s) + n * c * c) / max(n, 1.0))))


def fit_ridge(df: DataFrame, columns: Sequence[str] | Packed, y: str, group: str | None = None, penalties: Sequence[float] = LAMBDAS, seed: int = 2026) -> Ridge:
    """Ridge on standardised columns with intercept; the penalty is the best on held-out groups, the first of equals, then all rows are used.

    One pass gives the sums of the training and the held-out rows; every candidate penalty, and its
    error, is worked out from those. With fewer than ``LEAST_TRAINING`` training or ``LEAST_HELD_OUT`` held-out rows the penalty is
    judged on all rows.
    """
    from slotline.operators.sampling import uniform

    train, held = _sums(df, columns, y, uniform(seed, group) < 0.2 if group else None)
    whole = tuple(a + b for a, b in zip(train, held, strict=True))
    if not group:
        train = held = whole
    if train[0] < LEAST_TRAINING or held[0] < LEAST_HELD_OUT:
        train = held = whole
    tried = [(_rmse(_solve(*train, columns, q), *held), i) for i, q in enumerate(penalties)]
    best = min(tried)
    model = _solve(*whole, columns, penalties[best[1]])
    model.holdout_rmse = best[0]
    return model
