"""Covariates of every slot: sums, raw slots, shares and expected actions of the amounts around it.

Every covariate of a channel but its observed share is a weighted sum of the slots from ``PAST`` - 1
before to ``AHEAD`` after the origin. The weights are one matrix, and the covariates of a block of
slots are one matrix product over its sliding windows; a series is cut into blocks with margins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions.scalar import future_weight, past_weight
from slotline.operators.grid import KEYS, filled_windows

#: Channels, bins in minutes, time constants in minutes and horizons in minutes (fixed values).
CHANNELS = ("bolus", "basal", "carbs")
PAST_BINS = ((0, 30), (30, 60), (60, 120), (120, 240), (240, 360))
NEXT_BINS = ((0, 30), (30, 60), (60, 90), (90, 120))
TAUS = {"bolus": (55, 120), "basal": (55, 120), "carbs": (30, 90)}
ACTION_HORIZONS = (30, 60, 90, 120)
PAST, AHEAD, RAW_PAST = 72, 24, 12
RAW_HISTORY, DELTAS = 24, (1, 3, 6, 12)


def _weights() -> list[tuple[str, list[tuple[str, Callable[[str, int], float]]]]]:
    """Blocks of covariates in order: name, and per covariate its suffix and weight of (channel, offset in slots)."""
    between = lambda a, b: lambda c, k: float(a <= k <= b)
    acting = lambda i, h, ahead: lambda c, k: (future_weight(5.0 * k, h, TAUS[c][i]) if 0 < 5 * k <= h else 0.0) if ahead else (past_weight(-5.0 * k, h, TAUS[c][i]) if k <= 0 else 0.0)
    return [
        ("past", [(f"{a}_{z}", between(-z // 5 + 1, -a // 5)) for a, z in PAST_BINS]),
        ("seen", [("", None)]),
        ("next", [(f"{a}_{z}", between(a // 5 + 1, z // 5)) for a, z in NEXT_BINS]),
        ("ago", [(f"{5 * j}", between(-j, -j)) for j in range(RAW_PAST)]),
        ("in", [(f"{5 * j}", between(j, j)) for j in range(1, AHEAD + 1)]),
        ("act", [(f"{i}_{side}_{h}", acting(i, h, side == "next")) for i in (0, 1) for side in ("past", "next") for h in ACTION_HORIZONS]),
    ]


def covariate_names() -> list[str]:
    """The names of the covariates, in their order: blocks, in them channels, then the time of day."""
    return [f"{c}_{block}_{suffix}".rstrip("_") for block, parts in _weights() for c in CHANNELS for suffix, _ in parts] + ["day_sin", "day_cos"]


def _matrix(channel: str, part: Callable[[str, int], float]) -> np.ndarray:
    return np.array([part(channel, k) for k in range(1 - PAST, AHEAD + 1)])


def covariates(grid: DataFrame, block: int = 576) -> DataFrame:
    """Every row of the grid: source_file, id, slot, ``x`` (the covariates of ``covariate_names``).

    Slots that are not there or hold no amount count as 0 (and as not seen); the time of day is that
    of the slot's start.
    """
    plan = [(c, part) for _, parts in _weights() for c in CHANNELS for _, part in parts]
    width = PAST + AHEAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_channel = {c: np.column_stack([_matrix(c, part) for d, part in plan if d == c and part]) for c in CHANNELS}
        place = {c: [i for i, (d, part) in enumerate(plan) if d == c and part] for c in CHANNELS}
        shares = {c: [i for i, (d, part) in enumerate(plan) if d == c and not part] for c in CHANNELS}
        past = np.array([float(k <= 0) for k in range(1 - PAST, AHEAD + 1)]) / PAST
        for batch in batches:
            for row in range(len(batch)):
                source, pid, start = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py() * block
                seen = batch.column(3)[row].values
                slots = seen.field(0).to_numpy()
                own = slots[(slots >= start) & (slots < start + block)]
                if not len(own):
                    continue
                x = np.zeros((len(own), len(plan) + 2))
                for n, c in enumerate(CHANNELS, 1):
                    v = seen.field(n).to_numpy(zero_copy_only=False).astype(float)
                    dense, known = np.zeros((2, block + width - 1))
                    ok = np.isfinite(v)
                    at = slots[ok] - (start - PAST + 1)
                    dense[at], known[at] = v[ok], 1.0
                    windows = lambda a: np.lib.stride_tricks.sliding_window_view(a, width)[own - start]  # noqa: B023, E731
                    x[:, place[c]] = windows(dense) @ by_channel[c]
                    x[:, shares[c]] = (windows(known) @ past)[:, None]
                day = (own * 300 % 86400) / 86400.0 * 2 * np.pi
                x[:, -2], x[:, -1] = np.sin(day), np.cos(day)
                lists = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_pydict({"source_file": pa.array([source] * len(own), pa.string()), "id": pa.array([pid] * len(own), pa.string()), "slot": pa.array(own, pa.int64()), "x": lists})

    into = F.explode(F.sequence(F.floor((F.col("slot") - AHEAD) / block), F.floor((F.col("slot") + PAST - 1) / block)))
    spread = grid.select(*KEYS, into.alias("_block"), F.struct("slot", *CHANNELS).alias("_row"))
    packed = spread.groupBy(*KEYS, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return packed.select(*KEYS, F.col("_block").cast("bigint"), "_rows").mapInArrow(run, "source_file string, id string, slot bigint, x array<double>")


def history_features(grid: DataFrame, value: str = "cgm", width: int = 288) -> DataFrame:
    """Every row with a recorded value: source_file, id, slot, and of its filled history the last values ``ago_<minutes>``, the changes ``d<minutes>``, the spread of the last hour and the mean."""
    h = filled_windows(grid, value, width).select(*KEYS, "slot", "filled")
    back = lambda j: F.get("filled", F.lit(width - 1 - j))
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    hour = F.slice("filled", width - 11, 12)
    squares = lambda m: F.aggregate(hour, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / 12
    spread = F.element_at(F.transform(F.array(mean(hour, 12)), lambda m: F.sqrt(squares(m))), 1)
    return h.select(
        *KEYS, "slot", *(back(j).alias(f"ago_{5 * j}") for j in range(RAW_HISTORY)), *((back(0) - back(j)).alias(f"d{5 * j}") for j in DELTAS), spread.alias("sd_hour"), mean(F.col("filled"), width).alias("mean_day")
    )
