"""Irregular readings onto a regular grid, by a Kalman smoother with a local trend in continuous time.

The state of a source is its level and its trend; the trend decays in continuous time (an
Ornstein-Uhlenbeck process), so that it carries a filled value through a short gap and not through a
week. The smoother is evaluated at every grid time between the first and the last reading and gives
a value, its standard deviation and whether the slot held no reading.

A record is cut into blocks of slots. A block sees the readings of a margin on both sides and, where
the margins hold none, the last reading before and the first after; with the trend's memory of an
hour that is as good as the whole record. Blocks, not records, are the units of work: many blocks
are smoothed at once as numpy vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.operators.blocks import same_key
from slotline.session import written
from slotline.sources.readings import SLOT_SECONDS, participant_id
from slotline.sources.tables import epoch_seconds, finite

KEYS = ["source_file", "id"]


@dataclass(frozen=True)
class Trend:
    """Parameters, in slots and in units of the source's usual change from slot to slot."""

    memory: float = 12.0  # slots until the trend has decayed to 1/e
    trend: float = 1.0  # standard deviation of the trend
    level: float = 0.2  # of the level's own steps
    noise: float = 0.4  # of a reading
    prior: float = 100.0  # of the level where nothing is known


TREND = Trend()


def _moved(dt: np.ndarray | float, memory: float, trend2: np.ndarray, level2: np.ndarray):
    """Transition over ``dt`` slots: how trend moves into level, its decay, and the noise added."""
    a = dt / memory
    e = np.exp(-a)
    return (1 - e) * memory, e, trend2 * memory**2 * (2 * a - 3 + 4 * e - e * e) + level2 * dt, trend2 * memory * (1 - e) ** 2, trend2 * (1 - e * e)


def smooth(z: np.ndarray, at: np.ndarray, scale: np.ndarray, level: np.ndarray, before: np.ndarray, before_dt: np.ndarray, after: np.ndarray, after_dt: np.ndarray, p: Trend = TREND) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its standard deviation at every slot of many blocks.

    ``z``: readings, slots x blocks, NaN where there is none; ``at``: their offset into the slot, in
    slots; ``scale``, ``level``: of each block's source; ``before``/``after`` with their distance in
    slots from the first/last slot: the nearest reading outside, NaN where there is none.
    """
    steps, _ = z.shape
    z = np.vstack([z, after[None, :]])
    at = np.vstack([at, np.zeros((1, z.shape[1]))])
    trend2, level2, noise2 = (p.trend * scale) ** 2, (p.level * scale) ** 2, (p.noise * scale) ** 2
    known = np.isfinite(before)
    m0, m1 = np.where(known, before, level), np.zeros_like(level)
    p00, p01, p11 = np.where(known, noise2, (p.prior * scale) ** 2), np.zeros_like(level), trend2.copy()
    unit, first, last = (_moved(d, p.memory, trend2, level2) for d in (1.0, np.where(known, before_dt, 0.0), np.where(np.isfinite(after), after_dt, 1.0)))
    kept = []
    for i in range(steps + 1):
        f, e, q00, q01, q11 = first if i == 0 else last if i == steps else unit
        a0, a1 = m0 + f * m1, e * m1
        b00, b01, b11 = p00 + 2 * f * p01 + f * f * p11 + q00, e * (p01 + f * p11) + q01, e * e * p11 + q11
        h, seen = at[i], np.isfinite(z[i])
        s0, s1 = b00 + h * b01, b01 + h * b11
        var = s0 + h * s1 + noise2
        r = np.where(seen, z[i] - a0 - h * a1, 0.0)
        k0, k1 = np.where(seen, s0 / var, 0.0), np.where(seen, s1 / var, 0.0)
        m0, m1 = a0 + k0 * r, a1 + k1 * r
        p00, p01, p11 = b00 - k0 * s0, b01 - k0 * s1, b11 - k1 * s1
        kept.append((a0, a1, b00, b01, b11, m0, m1, p00, p01, p11))
    value, sd = np.empty((steps, z.shape[1])), np.empty((steps, z.shape[1]))
    x0, x1, v00, v01, v11 = m0, m1, p00, p01, p11
    for i in range(steps - 1, -1, -1):
        a0, a1, b00, b01, b11 = kept[i + 1][:5]
        m0, m1, p00, p01, p11 = kept[i][5:]
        f, e = (last if i == steps - 1 else unit)[:2]
        c00, c01, c10, c11 = p00 + f * p01, e * p01, p01 + f * p11, e * p11
        det = np.maximum(b00 * b11 - b01 * b01, 1e-300)
        g00, g01 = (c00 * b11 - c01 * b01) / det, (c01 * b00 - c00 * b01) / det
        g10, g11 = (c10 * b11 - c11 * b01) / det, (c11 * b00 - c10 * b01) / det
        d0, d1, w00, w01, w11 = x0 - a0, x1 - a1, v00 - b00, v01 - b01, v11 - b11
        x0, x1 = m0 + g00 * d0 + g01 * d1, m1 + g10 * d0 + g11 * d1
        v00, v01, v11 = (
            p00 + g00 * g00 * w00 + 2 * g00 * g01 * w01 + g01 * g01 * w11,
            p01 + g00 * g10 * w00 + (g00 * g11 + g01 * g10) * w01 + g01 * g11 * w11,
            p11 + g10 * g10 * w00 + 2 * g10 * g11 * w01 + g11 * g11 * w11,
        )
        value[i], sd[i] = x0, np.sqrt(np.maximum(v00, 0.0))
    return value, sd


def _smooth_blocks(block: int, margin: int, p: Trend, batch: int):
    """For mapInPandas: each block's slots, cut to the record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), batch):
                frame = whole.iloc[start : start + batch]
                n, width = len(frame), block + 2 * margin
                z, at = np.full((width, n), np.nan), np.zeros((width, n))
                for j, (b, slots, values, offsets) in enumerate(zip(frame.block, frame.slots, frame["values"], frame.offsets, strict=True)):
                    if slots is not None and len(slots):
                        i = slots - (b * block - margin)
                        z[i, j], at[i, j] = values, offsets
                number = lambda c: frame[c].to_numpy(float)  # noqa: B023, E731
                left, right = frame.block.to_numpy(float) * block - margin, frame.block.to_numpy(float) * block + block + margin - 1
                prev, nxt = number("prev_slot"), number("next_slot")
                outside = lambda v, ok: np.where(ok, v, np.nan)
                value, sd = smooth(
                    z, at, number("scale"), number("level"), outside(number("prev_value"), prev < left), np.maximum(left - prev, 0), outside(number("next_value"), nxt > right), np.maximum(nxt - right, 0), p
                )
                core = slice(margin, margin + block)
                seen, value, sd = z[core], value[core], sd[core]
                lo = np.maximum(frame["first"].to_numpy(np.int64) - frame.block.to_numpy(np.int64) * block, 0)
                hi = np.minimum(frame["last"].to_numpy(np.int64) - frame.block.to_numpy(np.int64) * block, block - 1) + 1
                cut = lambda x: [x[a:b, j] for j, (a, b) in enumerate(zip(lo, hi, strict=True))]  # noqa: B023, E731
                yield pd.DataFrame(
                    {"source_file": frame.source_file, "id": frame.id, "block": frame.block, "start": frame.block * block + lo, "value": cut(value), "sd": cut(sd), "missing": cut(~np.isfinite(seen)), "reading": cut(np.where(np.isfinite(seen), seen, 0.0))}
                )

    return run


def smoothed_blocks(readings: DataFrame, value: str = "cgm", slot_seconds: int = SLOT_SECONDS, block: int = 288, margin: int = 72, trend: Trend = TREND, batch: int = 512) -> DataFrame:
    """The grid in blocks: source_file, id, block, start (first slot), arrays value, sd, missing, reading of its slots."""
    rows = readings.filter(F.col("date").isNotNull()).select("source_file", participant_id().alias("id"), epoch_seconds("date").alias("sec"), finite(value).alias("v")).filter(F.col("v").isNotNull())
    slot = F.floor(F.col("sec") / slot_seconds).cast("bigint")
    seen = rows.groupBy(*KEYS, slot.alias("slot")).agg(F.avg("v").alias("v"), (F.avg(F.col("sec") - slot * slot_seconds) / slot_seconds).alias("offset"))
    seen = written(seen.withColumn("block", F.floor(F.col("slot") / block).cast("bigint")))  # the slots are read three times below
    near = F.lag(F.struct("slot", "v")).over(W.partitionBy(*KEYS, "block").orderBy("slot"))
    step = F.when(F.col("slot") - F.col("near.slot") <= 3, F.abs(F.col("v") - F.col("near.v")))
    own = seen.withColumn("near", near).withColumn("step", F.when(step > 0, step))
    blocks = own.groupBy(*KEYS, "block").agg(
        F.min(F.struct("slot", "v")).alias("head"), F.max(F.struct("slot", "v")).alias("tail"), F.percentile_approx("step", 0.5, 1000).alias("step"), F.percentile_approx("v", 0.5, 1000).alias("level")
    )
    whole = blocks.groupBy(*KEYS).agg(
        F.min("head.slot").alias("first"), F.max("tail.slot").alias("last"), (F.percentile_approx("step", 0.5, 1000) / 0.6745).alias("scale"), F.percentile_approx("level", 0.5, 1000).alias("level")
    )
    scale = F.coalesce("scale", F.greatest(F.abs("level") * 0.02, F.lit(1e-3)))
    whole = whole.select(*KEYS, "first", "last", scale.alias("scale"), "level")
    calendar = whole.select("*", F.explode(F.sequence(F.floor(F.col("first") / block).cast("bigint"), F.floor(F.col("last") / block).cast("bigint"))).alias("block"))
    c, b = calendar.alias("c"), blocks.alias("b")
    along = W.partitionBy(*KEYS).orderBy("block")
    framed = c.join(b, same_key("c", "b", [*KEYS, "block"]), "left").select("c.*", "b.head", "b.tail")
    framed = framed.select(
        *calendar.columns,
        F.last("tail", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("prev"),
        F.first("head", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("next"),
    )
    into = F.array_distinct(F.array(*(F.floor((F.col("slot") + d) / block).cast("bigint") for d in (0, -margin, margin))))
    given = seen.select(*KEYS, F.explode(into).alias("block"), F.struct("slot", "v", "offset").alias("x")).groupBy(*KEYS, "block").agg(F.collect_list("x").alias("x"))
    a, g = framed.alias("a"), given.alias("g")
    packed = a.join(g, same_key("a", "g", [*KEYS, "block"]), "left").select(
        *(f"a.{k}" for k in ("source_file", "id", "block", "first", "last", "scale", "level")),
        F.col("a.prev.slot").alias("prev_slot"), F.col("a.prev.v").alias("prev_value"), F.col("a.next.slot").alias("next_slot"), F.col("a.next.v").alias("next_value"),
        F.col("g.x.slot").alias("slots"), F.col("g.x.v").alias("values"), F.col("g.x.offset").alias("offsets"),
    )
    return packed.mapInPandas(
        _smooth_blocks(block, margin, trend, batch), "source_file string, id string, block bigint, start bigint, value array<double>, sd array<double>, missing array<boolean>, reading array<double>"
    )


def regular_grid(readings: DataFrame, value: str = "cgm", slot_seconds: int = SLOT_SECONDS, **options) -> DataFrame:
    """One row per participant and slot from its first to its last recorded value.

    source_file, id, slot, value (mean of the slot's readings, or the smoothed level where it has
    none), smoothed, sd, missing. Rows without a date and values not recorded play no part; several
    readings in a slot count as their mean; a participant without recorded values has no rows; NULL
    ids or sources are a participant of their own.
    """
    blocks = smoothed_blocks(readings, value, slot_seconds, **options)
    cells = blocks.select("source_file", "id", "start", F.posexplode(F.arrays_zip("value", "sd", "missing", "reading")).alias("i", "x"))
    return cells.select(
        "source_file", "id", (F.col("start") + F.col("i")).alias("slot"), F.when(F.col("x.missing"), F.col("x.value")).otherwise(F.col("x.reading")).alias("value"), F.col("x.value").alias("smoothed"), F.col("x.sd").alias("sd"), F.col("x.missing").alias("missing")
    )


def missing_runs(blocks: DataFrame) -> DataFrame:
    """Longest runs of slots marked missing: source_file, id, first_slot, last_slot.

    Runs within a block come from the block; those over block ends from the neighbouring blocks'
    last and first slots with a reading, a window over blocks and not over slots.
    """
    at = F.filter(F.transform("missing", lambda m, i: F.when(~m, F.col("start") + i)), lambda x: x.isNotNull())
    held = blocks.select("source_file", "id", "block", at.alias("at")).filter(F.size("at") > 0)
    inner = F.filter(F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at")), lambda a, b: F.struct((a + 1).alias("first_slot"), (b - 1).alias("last_slot"))), lambda r: r.first_slot <= r.last_slot)
    ends = held.select("source_file", "id", "block", inner.alias("inner"), F.element_at("at", 1).alias("head"), F.element_at("at", -1).alias("tail"))
    before = F.lag("tail").over(W.partitionBy("source_file", "id").orderBy("block"))
    across = ends.select("source_file", "id", "inner", F.struct((before + 1).alias("first_slot"), (F.col("head") - 1).alias("last_slot")).alias("over"))
    runs = across.select("source_file", "id", F.explode(F.concat("inner", F.filter(F.array("over"), lambda r: r.first_slot <= r.last_slot))).alias("r"))
    return runs.select("source_file", "id", "r.first_slot", "r.last_slot")
