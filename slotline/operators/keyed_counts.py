"""Per-key figures when a few keys hold most rows.

Every input split, whatever keys it holds, dictionary-encodes its keys and scatters its rows into
dense numpy arrays (``bincount``). The arrays leave the split cut into ranges of keys, by a hash of
the key, and the array blocks of a range are brought to one dictionary and added up as arrays. The
work of a task follows the size of its split, never the size of a key; no dictionary of the whole
table exists anywhere, and what is shuffled is one block row per split and range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = 256
FLUSH = 1 << 20  # keys of a split after which its arrays are handed on


class _Accumulator:
    """Dense arrays over a dictionary that grows with the keys seen."""

    def __init__(self, measures: int) -> None:
        self.words = pa.array([], pa.string())
        self.sums = np.zeros((measures, 0))

    def add(self, keys: pa.Array, weights: list[np.ndarray]) -> None:
        fresh = pc.unique(keys)
        fresh = fresh.filter(pc.invert(pc.is_in(fresh, value_set=self.words)))
        if len(fresh):
            self.words = pa.concat_arrays([self.words, fresh])
            self.sums = np.pad(self.sums, ((0, 0), (0, len(fresh))))
        codes = pc.index_in(keys, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)  # NULL is a word too
        for i, w in enumerate(weights):
            self.sums[i] += np.bincount(codes, weights=w, minlength=len(self.words))


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isfinite(v), v, 0.0)


def _scatter(values: int, ranges: int):
    """For mapInArrow: the split's accumulators, cut into ranges of keys."""

    def blocks(own: _Accumulator) -> pa.RecordBatch:
        at = np.array([0 if w is None else 1 + zlib.crc32(w.encode()) % (ranges - 1) for w in own.words.to_pylist()], np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order])) + 1
        groups = np.split(order, cuts) if len(order) else []
        return pa.RecordBatch.from_pydict(
            {"range": pa.array([int(at[g[0]]) for g in groups], pa.int32()), "keys": pa.array([own.words.take(pa.array(g)).to_pylist() for g in groups], pa.list_(pa.string())), "sums": pa.array([own.sums[:, g].ravel() for g in groups], pa.list_(pa.float64()))}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Accumulator(1 + values)
        for batch in batches:
            own.add(batch.column(0).cast(pa.string()), [np.ones(len(batch)), *(_column(batch, i) for i in range(1, values + 1))])
            if len(own.words) > FLUSH:
                yield blocks(own)
                own = _Accumulator(1 + values)
        yield blocks(own)

    return run


def _add_up(values: Sequence[str]):
    """For mapInArrow over whole ranges: their blocks brought to one dictionary and added."""
    measures = 1 + len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Accumulator] = {}
        for batch in batches:
            for at, keys, sums in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                known.setdefault(at, _Accumulator(measures)).add(keys.values.cast(pa.string()), list(sums.values.to_numpy(zero_copy_only=False).reshape(measures, -1)))
        for a in known.values():
            yield pa.RecordBatch.from_pydict({"key": a.words, "n_rows": pa.array(a.sums[0].astype(np.int64)), **{f"v{i}": pa.array(s) for i, s in enumerate(a.sums[1:])}})

    return run


def dense_sums(df: DataFrame, key: str, values: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """One row per key: ``key``, ``n_rows`` and the sum of each of ``values``, without regard to skew.

    NULL keys form one key of their own; values that are NULL or not finite add nothing; an empty
    input gives no rows; columns other than those named are never read. A task of the reduction
    holds the distinct keys of its ranges, at 8 bytes a key and measure: ``ranges`` grows with the
    number of keys one expects (some 10 million a range are no burden).
    """
    rows = df.select(F.col(key).cast("string").alias("key"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    blocks = rows.mapInArrow(_scatter(len(values), ranges), "range int, keys array<string>, sums array<double>")
    summed = blocks.repartition("range").mapInArrow(_add_up(values), "key string, n_rows bigint" + "".join(f", v{i} double" for i in range(len(values))))
    return summed.select(F.col("key").alias(key), "n_rows", *(F.col(f"v{i}").alias(v) for i, v in enumerate(values)))


def rows_and_members(df: DataFrame, key: str, member: str, **options) -> DataFrame:
    """One row per key: ``n_rows`` and ``n_members``, the number of its distinct members.

    NULL members are no member. Rows are first counted per (key, member) with partial sums, so that
    a hot key is spread over its members; those counts are then scattered as rows are.
    """
    pairs = df.groupBy(F.col(key).alias("_key"), F.col(member).alias("_member")).agg(F.count("*").cast("double").alias("_n"))
    out = dense_sums(pairs.select("_key", "_n", F.col("_member").isNotNull().cast("double").alias("_m")), "_key", ["_n", "_m"], **options)
    return out.select(F.col("_key").alias(key), F.col("_n").cast("bigint").alias("n_rows"), F.col("_m").cast("bigint").alias("n_members"))
