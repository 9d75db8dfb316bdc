"""Readings that can't be what the body or the device gave: spikes, stuck values, impossible values.

Each participant's recorded values, in time order, are decomposed with an undecimated wavelet: for
widths of 1 to ``widest`` readings the detail is the mean of the readings less the mean of the two
around them (two vanishing moments: level and slope leave no detail). Details are compared with the
participant's own robust scale. A run of one same value (first differences all zero) much longer
than the participant's usual run is a sensor that hangs: the usual run is the median one, 3 where
the logger repeats each value three times, and runs are counted in multiples of it. Bounds of the
participant's unit or dose size show what no device can give. Doses are decomposed as logarithms of
the meal-sized ones, one after the other: a detail far beyond their usual spread is a dose out of
scale.

A series is cut into chunks. Spikes need a few neighbours, which a margin gives; runs that touch a
chunk's end are put together from the neighbouring chunks' first and last runs, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.operators.blocks import chunked, same_key, with_place
from slotline.session import written
from slotline.sources.readings import participant_id
from slotline.sources.tables import epoch_seconds, finite

KEYS = ["source_file", "id", "field"]


@dataclass(frozen=True)
class Limits:
    """Parameters. Glucose bounds are the devices' reporting limits in either unit."""

    widest: int = 4
    spike_scales: float = 6.0  # of the robust scale of the details
    spike_least_mg: float = 28.0  # mg/dL
    mg_per_mmol: float = 18.0
    mmol_below: float = 30.0  # a participant whose median is below this measures in mmol/L
    mg: tuple[float, float] = (40.0, 400.0)
    mmol: tuple[float, float] = (2.22, 22.22)
    stuck_least: int = 9
    stuck_times: float = 5.0  # of the participant's usual run
    stuck_rarity: float = 1e6  # one run in so many is as long by chance
    runs_least: int = 10  # below, the usual run isn't known and 1 is taken
    stuck_dose_least: int = 5
    meal_dose: float = 0.6  # units; smaller doses are basal delivery and may repeat
    dose_times: float = 5.0  # of the participant's median meal dose
    dose_scales: float = 6.0  # of the robust scale of the details of log doses
    dose_least: float = 1.8  # log of six times
    doses_least: int = 10  # below, the source's median meal dose is taken
    gap_paces: float = 4.0


LIMITS = Limits()
CHUNK, MARGIN = 4096, 16


def _recorded(readings: DataFrame) -> DataFrame:
    """Recorded values, long: source_file, id, field, sec, value, row_pos, base (units an hour), carried by dated rows."""
    insulin, basal = finite("insulin"), finite("basal")
    dose = F.when(insulin >= 0, insulin)
    rows = readings.filter(F.col("date").isNotNull()).select(
        "row_pos",
        "source_file",
        participant_id().alias("id"),
        epoch_seconds("date").alias("sec"),
        F.inline(F.array(F.struct(F.lit("cgm").alias("field"), finite("cgm").alias("value"), F.lit(None).cast("double").alias("base")), F.struct(F.lit("insulin").alias("field"), dose.alias("value"), basal.alias("base")))),
    )
    return rows.filter(F.col("value").isNotNull())


def _details(x: np.ndarray, width: int) -> np.ndarray:
    """Detail of the ``width`` readings from each place on; NaN where a neighbour is lacking."""
    out = np.full(len(x), np.nan)
    n = len(x) - width - 1
    if n > 0:
        total = np.concatenate([[0.0], np.cumsum(x)])
        out[1 : n + 1] = (total[1 + width : n + 1 + width] - total[1 : n + 1]) / width - (x[:n] + x[1 + width : n + 1 + width]) / 2
    return out


def _within(field: str, x: np.ndarray, level: float, limits: Limits) -> np.ndarray:
    if field != "cgm":
        return np.ones(len(x), bool)
    low, high = limits.mmol if level < limits.mmol_below else limits.mg
    return (x >= low) & (x <= high)


def _meals(x: np.ndarray, limits: Limits) -> np.ndarray:
    """Places of the meal-sized doses."""
    return np.flatnonzero(x > limits.meal_dose + 0.3)


def _chunk_figures(limits: Limits, chunk: int):
    """For mapInPandas: a chunk's robust figures, from which the participant's are the medians, and its own first and last run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                own = (r.place >= r.core_from) & (r.place < r.core_from + chunk)
                x, sec, field = r.value[own], r.sec[own], r.field
                level = float(np.median(x))
                kept = x[_within(field, x, level, limits)]
                meals = np.log(x[_meals(x, limits)]) if field != "cgm" else kept
                detail = np.abs(_details(meals, 1))
                detail = detail[detail > 0]  # NaN fails too
                step = np.diff(sec)
                runs = _run_lengths(kept)
                run = int(np.quantile(runs, 0.5, method="lower")) if len(runs) >= limits.runs_least else 1
                again = int((runs >= 1.5 * run).sum())
                ends = (float(kept[0]), int(runs[0]), float(kept[-1]), int(runs[-1])) if len(kept) else (None, 0, None, 0)
                scale = float(np.median(detail)) / 0.6745 if len(detail) else None
                out.append((r.source_file, r.id, field, r.chunk, level, scale, float(np.median(step)) if len(step) else None, run, again, len(runs), *ends))
            yield pd.DataFrame(out, columns=["source_file", "id", "field", "chunk", "level", "scale", "pace", "run", "again", "begun", "head", "n_head", "tail", "n_tail"])

    return run


def _run_lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of the runs of same values, in order."""
    ends = np.flatnonzero(np.diff(x) != 0) + 1
    return np.diff(np.concatenate([[0], ends, [len(x)]])) if len(x) else np.zeros(0, int)


def _stuck_from(run: float, again: float, begun: float, limits: Limits, chunk: int = CHUNK) -> int:
    """The length from which a run of same values is a sensor that hangs.

    ``run`` is the participant's usual run, ``again`` of its ``begun`` runs go on into a second one.
    The length doesn't depend on that of the record, and is at most a chunk, so that neighbours are
    enough to know it.
    """
    repeat = min((again + 1.0) / (begun + 2.0), 0.98)
    chance = np.log(limits.stuck_rarity) / -np.log(repeat) + 2.0
    return min(chunk, max(limits.stuck_least, int(np.ceil(run * max(chance, limits.stuck_times if run > 1 else 0.0)))))


def _hanging(x: np.ndarray, least: int, before: tuple[float, int] = (np.nan, 0), after: tuple[float, int] = (np.nan, 0)) -> np.ndarray:
    """Whether each value belongs to a run of at least ``least`` same values; ``before`` and ``after``: value and length of the runs on either side."""
    if not len(x):
        return np.zeros(0, bool)
    run = np.cumsum(np.concatenate([[True], np.diff(x) != 0])) - 1
    length = np.bincount(run)
    more = [(0, before[1] if x[0] == before[0] else 0), (-1, after[1] if x[-1] == after[0] else 0)]
    for at, n in more:
        length[at] += n
    return length[run] >= least


def _odd_doses(x: np.ndarray, scale: float, limits: Limits) -> np.ndarray:
    """Places of meal-sized doses whose logarithm stands far above both neighbours."""
    at = _meals(x, limits)
    far = max(limits.dose_scales * scale, limits.dose_least)
    return at[np.flatnonzero(np.nan_to_num(_details(np.log(x[at]), 1)) > far)] if len(at) else at


def _spikes(x: np.ndarray, sec: np.ndarray, pace: float, scale: float, least: float, limits: Limits) -> np.ndarray:
    """Whether each value is in a short excursion that leaves both neighbours' level to one side and comes back."""
    n, out = len(x), np.zeros(len(x), bool)
    far = max(limits.spike_scales * scale, least)
    gap = np.diff(sec) > limits.gap_paces * pace
    for width in range(1, limits.widest + 1):
        if n < width + 2:
            break
        detail = _details(x, width)
        for i in np.flatnonzero(np.abs(np.nan_to_num(detail)) > far):
            inside, left, right = x[i : i + width], x[i - 1], x[i + width]
            up = 1.0 if detail[i] > 0 else -1.0
            if min((up * (inside - left)).min(), (up * (inside - right)).min()) > far and not (gap[i - 1] and gap[i + width - 1]):
                out[i : i + width] = True
    return out


def _chunk_flags(limits: Limits, chunk: int):
    """For mapInPandas: flagged instants of a chunk with the participant's figures beside it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                place, sec, x, low, high = r.place, r.sec, r.value, r.low, r.high
                own = (place >= r.core_from) & (place < r.core_from + chunk)
                reason = np.full(len(x), None, object)
                before, after = (r.prev, int(r.n_prev)), (r.next, int(r.n_next))
                if r.field == "cgm":
                    mmol = r.level < limits.mmol_below
                    least, most = limits.mmol if mmol else limits.mg
                    beyond = (low < least) | (high > most)
                    inside = ~beyond & (x >= least) & (x <= most)
                    held = (x == least) | (x == most)
                    at = np.flatnonzero(inside)
                    spike = _spikes(x[at], sec[at], r.pace or 300.0, r.scale or 0.0, limits.spike_least_mg / (limits.mg_per_mmol if mmol else 1.0), limits)
                    reason[at[spike]] = "spike"
                    rest = at[~spike & own[at]]
                    stuck = _hanging(x[rest], _stuck_from(r.run, r.again, r.begun, limits, chunk), before, after)
                    reason[rest[stuck]] = "stuck"
                    reason[beyond] = "impossible"
                    reason[held & (reason != "impossible")] = None
                else:
                    most = limits.dose_times * r.dose if r.dose and r.dose > 0 else np.inf
                    if r.scale and r.scale == r.scale:
                        reason[_odd_doses(x, r.scale, limits)] = "spike"
                    at = np.flatnonzero(own)
                    stuck = at[_hanging(x[at], limits.stuck_dose_least, before, after) & (x[at] > limits.meal_dose)]
                    reason[stuck] = "stuck"
                    reason[high > most] = "impossible"
                    least = -np.inf
                for i in np.flatnonzero(own & (reason != None)):  # noqa: E711
                    out.append((r.source_file, r.id, r.field, int(sec[i]), x[i], float(least), float(most), reason[i]))
            yield pd.DataFrame(out, columns=["source_file", "id", "field", "sec", "level", "least", "most", "reason"])

    return run


def _meal_dose(c: Column, base: Column, limits: Limits) -> Column:
    """The dose where it is more than basal delivery can be (a tenth of an hour's basal rate, at least ``meal_dose``)."""
    return F.when(c > F.greatest(F.lit(limits.meal_dose + 0.3), F.when(base < 6, base * 0.3)), c)


def implausible(readings: DataFrame, limits: Limits = LIMITS, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """Implausible values: row_pos, source_file, id, sec, field ('cgm', 'insulin'), value, reason ('spike', 'stuck', 'impossible').

    Only recorded values of dated rows are judged (NULL, NaN, infinite numbers and, for insulin,
    negative stand-in codes are none). Rows at one instant are judged by the one first in the file;
    the others share its flag if their value is near it, and are held against the bounds
    themselves. A participant with few readings gets the bounds only; an empty table gives no rows.

    The series of a participant is cut into chunks of ``chunk`` readings with margins, so no task
    holds more than a chunk of it; the participant's figures are medians of the chunks' figures, and
    runs over a chunk's ends are put together from the neighbours' first and last runs.
    """
    rows = _recorded(readings)
    instants = rows.groupBy(*KEYS, "sec").agg(F.min_by("value", "row_pos").alias("value"), F.min("value").alias("low"), F.max("value").alias("high"))
    placed = with_place(instants, KEYS, ["sec"], F.floor(F.col("sec") / 86400))
    packed = chunked(placed, KEYS, ["sec", "value", "low", "high"], chunk, margin)
    chunks = written(packed.select(*KEYS, "chunk", "core_from", *(F.col(f"rows.{c}").alias(c) for c in ("place", "sec", "value", "low", "high"))))
    text = "source_file string, id string, field string"
    parts = written(chunks.drop("low", "high").mapInPandas(
        _chunk_figures(limits, chunk), f"{text}, chunk bigint, level double, scale double, pace double, run bigint, again bigint, begun bigint, head double, n_head bigint, tail double, n_tail bigint"
    ))  # a row a chunk
    mid = lambda c: F.percentile_approx(c, 0.5, 10000)
    figures = parts.groupBy(*KEYS).agg(mid("level").alias("level"), mid("scale").alias("scale"), mid("pace").alias("pace"), mid("run").alias("run"), F.sum("again").alias("again"), F.sum("begun").alias("begun"))
    meal = rows.filter(F.col("field") == "insulin").select("source_file", "id", _meal_dose(F.col("value"), F.col("base"), limits).alias("dose")).filter(F.col("dose").isNotNull())
    own_dose = meal.groupBy("source_file", "id").agg(mid("dose").alias("own"), F.count("*").alias("n"))
    source_dose = meal.groupBy("source_file").agg(mid("dose").alias("whole"))
    f, o, s = figures.alias("f"), own_dose.alias("o"), source_dose.alias("s")
    known = (
        f.join(o, same_key("f", "o", ["source_file", "id"]), "left")
        .join(s, same_key("f", "s", ["source_file"]), "left")
        .select("f.*", F.when(F.col("o.n") >= limits.doses_least, F.col("o.own")).otherwise(F.col("s.whole")).alias("dose"))
    )
    along = W.partitionBy(*KEYS).orderBy("chunk")
    edges = parts.select(*KEYS, "chunk", *((F.coalesce(f(c).over(along), F.lit(0)) if n[:2] == "n_" else f(c).over(along)).alias(n) for n, f, c in (("prev", F.lag, "tail"), ("n_prev", F.lag, "n_tail"), ("next", F.lead, "head"), ("n_next", F.lead, "n_head"))))
    e, k = edges.alias("e"), known.alias("k")
    told = e.join(k, same_key("e", "k", KEYS)).select("e.*", "k.level", "k.scale", "k.pace", "k.run", "k.again", "k.begun", "k.dose")
    c, t = chunks.alias("c"), told.alias("t")
    judged = c.join(t, same_key("c", "t", [*KEYS, "chunk"])).select("c.*", *(f"t.{n}" for n in told.columns if n not in (*KEYS, "chunk")))
    flags = judged.mapInPandas(_chunk_flags(limits, chunk), f"{text}, sec bigint, level double, least double, most double, reason string")
    r, g = rows.alias("r"), flags.alias("g")
    value = F.col("r.value")
    beyond = (value < F.col("g.least")) | (value > F.col("g.most"))
    near = F.abs(value - F.col("g.level")) <= 0.1 * F.abs(F.col("g.level"))
    return (
        r.join(g, same_key("r", "g", [*KEYS, "sec"]))
        .filter(beyond | (near & (F.col("g.reason") != "impossible")))
        .select("r.row_pos", "r.source_file", "r.id", "r.sec", "r.field", "r.value", F.when(beyond, F.lit("impossible")).otherwise(F.col("g.reason")).alias("reason"))
    )
