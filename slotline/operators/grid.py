"""Series on an exact grid: keep-last slots, frames of slots that a hot series can't turn into one task, arrays, leads and lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline.sources.readings import SLOT_SECONDS, participant_id
from slotline.sources.tables import epoch_seconds, finite

KEYS = ["source_file", "id"]
BLOCK = 2016  # slots of a week


def keep_last(df: DataFrame, keys: Sequence[str], values: Sequence[str], tiebreak: str) -> DataFrame:
    """One row per keys; of each value the recorded one that is last by ``tiebreak``."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(tiebreak))).alias(v) for v in values))


def to_grid(readings: DataFrame, values: Sequence[str] = ("cgm", "insulin", "basal", "bolus", "carbs"), step: int = SLOT_SECONDS) -> DataFrame:
    """Readings in slots: source_file, id, slot and the last recorded value of each; numbers that are not finite are not recorded."""
    rows = readings.filter(F.col("date").isNotNull()).select("source_file", participant_id().alias("id"), F.floor(epoch_seconds("date") / step).cast("bigint").alias("slot"), "row_pos", *(finite(v).alias(v) for v in values))
    return keep_last(rows, [*KEYS, "slot"], values, "row_pos")


def over_slots(grid: DataFrame, columns: Callable[[Callable[[int, int], WindowSpec]], dict[str, Column]], before: int, after: int, block: int = BLOCK, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds columns over RANGE frames of slots, at most ``before`` back and ``after`` ahead.

    ``columns`` gets ``frame(from, to)`` and returns name -> column. A series is cut into blocks of
    slots with margins as wide as the frames, so that the window's partitions are bounded and a
    series with most of the rows is many tasks; every row comes out once, from its own block.
    """
    places = [F.floor(F.col("slot") / block)]
    places += [F.floor((F.col("slot") + before) / block)] if before else []
    places += [F.floor((F.col("slot") - after) / block)] if after else []
    spread = grid.withColumn("_block", F.explode(F.array_distinct(F.array(*places))))
    by = W.partitionBy(*keys, "_block").orderBy("slot")
    out = spread.withColumns(columns(lambda a, b: by.rangeBetween(a, b)))
    return out.filter(F.col("_block") == F.floor(F.col("slot") / block)).drop("_block")


def at_slot(value: str | Column, k: int, frame: Callable[[int, int], WindowSpec]) -> Column:
    """The value exactly ``k`` slots on; NULL if that slot is not there (no tolerance, no nearest)."""
    return F.max(value).over(frame(k, k))


def slots_array(value: str, first: int, last: int, frame: Callable[[int, int], WindowSpec], missing: float | None = None) -> Column:
    """The values of slots ``first`` to ``last`` from here, in order, ``missing`` where there is none."""
    seen = F.collect_list(F.struct("slot", value)).over(frame(first, last))
    known = F.map_from_entries(F.transform(seen, lambda x: F.struct(x["slot"], x[value])))
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.coalesce(F.element_at(known, F.col("slot") + k), F.lit(missing).cast("double")))


def _dense_blocks(grid: DataFrame, value: str, before: int, after: int, block: int) -> DataFrame:
    """One row per block of slots: keys, _own (its rows, structs of slot and v), _from (slot of the first entry of _dense), _dense (value of each slot of the block and of the margins)."""
    first, last = F.floor((F.col("slot") - after) / block), F.floor((F.col("slot") + before) / block)
    spread = grid.select(*KEYS, F.struct("slot", F.col(value).alias("v")).alias("_row"), F.explode(F.sequence(first, last)).alias("_block"))
    packed = spread.groupBy(*KEYS, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_seen")).withColumn("_from", F.col("_block") * block - before)
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    at = F.col("_from")
    led = F.transform("_seen", lambda x, i: F.concat(none(x["slot"] - F.when(i == 0, at).otherwise(F.get(F.col("_seen"), i - 1)["slot"] + 1)), F.array(x["v"])))
    rest = none(at + before + block + after - 1 - F.element_at("_seen", -1)["slot"])
    own = F.filter("_seen", lambda x: F.floor(x["slot"] / block) == F.col("_block"))
    return packed.select(*KEYS, own.alias("_own"), "_from", F.concat(F.flatten(led), rest).alias("_dense")).filter(F.size("_own") > 0)


def windows(grid: DataFrame, value: str, first: int, last: int, block: int = 576) -> DataFrame:
    """Every row of the grid: source_file, id, slot, ``window`` (the values of slots ``first`` <= 0 to ``last`` >= 0 from here, in order, NULL where there is none).

    As ``slots_array`` over a frame, but cut from one array per block, for windows of hundreds of slots.
    """
    rows = _dense_blocks(grid, value, -first, last, block).select(*KEYS, F.explode("_own").alias("_row"), "_from", "_dense")
    slot = F.col("_row.slot")
    return rows.select(*KEYS, slot.alias("slot"), F.slice("_dense", (slot - F.col("_from") + first + 1).cast("int"), F.lit(last - first + 1)).alias("window"))


@F.pandas_udf(T.StructType([T.StructField("filled", T.ArrayType(T.DoubleType())), T.StructField("next", T.ArrayType(T.IntegerType()))]))
def _filled_dense(dense: pd.Series) -> pd.DataFrame:
    """Each array filled on the line between recorded entries, and for each place that of the first recorded entry from there on."""
    filled, following = [], []
    for a in dense:
        x = np.asarray(a, float)
        at = np.flatnonzero(~np.isnan(x))
        filled.append(np.interp(np.arange(len(x)), at, x[at]) if len(at) else x)
        following.append(np.append(at, len(x))[np.searchsorted(at, np.arange(len(x)))].astype("int32"))
    return pd.DataFrame({"filled": filled, "next": following})


def filled_windows(grid: DataFrame, value: str, width: int, sentinel: float = -1.0, block: int = 576) -> DataFrame:
    """Every row with a recorded value: source_file, id, slot, ``filled`` and ``marked``, the last ``width`` slots as ``fill_window`` gives them, without and with ``sentinel``.

    The line of a gap within a window is the same in all windows, so each block is filled once;
    before a window's first recorded entry stands that entry, whatever lies before the window.
    """
    blocks = _dense_blocks(grid, value, width - 1, 0, block).withColumn("_line", _filled_dense("_dense")).withColumn("_dense", F.transform("_dense", lambda v: F.coalesce(v, F.lit(sentinel))))
    rows = blocks.select(*KEYS, F.explode(F.filter("_own", lambda x: x["v"].isNotNull())).alias("_row"), "_from", "_dense", "_line")
    begin = (F.col("_row.slot") - F.col("_from") - width + 1).cast("int")
    lead = F.get("_line.next", begin) - begin
    line = F.col("_line.filled")
    filled = F.concat(F.array_repeat(F.get(line, begin + lead), lead), F.slice(line, begin + lead + 1, F.lit(width) - lead))
    return rows.select(*KEYS, F.col("_row.slot").alias("slot"), filled.alias("filled"), F.slice("_dense", begin + 1, F.lit(width)).alias("marked"))


def ordinal_from_start(readings: DataFrame, step: int = SLOT_SECONDS) -> DataFrame:
    """Rows on the phase of their participant's first date, with ``i`` = whole steps since it; others are left out."""
    rows = readings.filter(F.col("date").isNotNull()).select("row_pos", "source_file", participant_id().alias("id"), epoch_seconds("date").alias("sec"))
    start = rows.groupBy(*KEYS).agg(F.min("sec").alias("t0"))
    a, b = rows.alias("a"), start.alias("b")
    gone = F.col("a.sec") - F.col("b.t0")
    joined = a.join(b, F.col("a.source_file").eqNullSafe(F.col("b.source_file")) & F.col("a.id").eqNullSafe(F.col("b.id")))
    return joined.filter(gone % step == 0).select("a.row_pos", "a.source_file", "a.id", F.floor(gone / step).cast("bigint").alias("i"))


def gaps(grid: DataFrame, value: str = "cgm", block: int = BLOCK) -> DataFrame:
    """Consecutive recorded slots more than one apart: source_file, id, from_slot, to_slot, v0, v1.

    Within blocks by lead; over block ends by each block's first and last, a window over blocks.
    """
    seen = grid.filter(F.col(value).isNotNull()).select(*KEYS, "slot", F.col(value).alias("v"), F.floor(F.col("slot") / block).alias("_block"))
    pair = F.struct("slot", "v")
    inner = seen.withColumn("next", F.lead(pair).over(W.partitionBy(*KEYS, "_block").orderBy("slot"))).filter(F.col("next").isNotNull()).select(*KEYS, pair.alias("prev"), "next")
    ends = seen.groupBy(*KEYS, "_block").agg(F.min(pair).alias("head"), F.max(pair).alias("tail"))
    over = ends.select(*KEYS, F.col("tail").alias("prev"), F.lead("head").over(W.partitionBy(*KEYS).orderBy("_block")).alias("next")).filter(F.col("next").isNotNull())
    both = inner.unionByName(over).filter(F.col("next.slot") - F.col("prev.slot") > 1)
    return both.select(*KEYS, F.col("prev.slot").alias("from_slot"), F.col("next.slot").alias("to_slot"), F.col("prev.v").alias("v0"), F.col("next.v").alias("v1"))


def interpolate(grid: DataFrame, value: str = "cgm", longest: int = 24) -> DataFrame:
    """The missing slots of gaps of at most ``longest``, filled on the line between the gap's ends: source_file, id, slot, filled."""
    g = gaps(grid, value).filter(F.col("to_slot") - F.col("from_slot") - 1 <= longest)
    cells = g.select("*", F.explode(F.sequence(F.col("from_slot") + 1, F.col("to_slot") - 1)).alias("slot"))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("slot") - F.col("from_slot")) / (F.col("to_slot") - F.col("from_slot"))
    return cells.select(*KEYS, "slot", line.alias("filled"))


def fill_window(values: Column, sentinel: float | None = None) -> Column:
    """An array with its NULLs filled on the line between the recorded entries, the nearest one beyond the ends; all NULL stays so.

    With ``sentinel`` the NULLs take that value instead.
    """
    if sentinel is not None:
        return F.transform(values, lambda v: F.coalesce(v, F.lit(sentinel)))
    known = F.filter(F.transform(values, lambda v, i: F.when(v.isNotNull(), F.struct(i.alias("i"), v.alias("v")))), lambda x: x.isNotNull())

    def fill(v: Column, i: Column) -> Column:
        left, right = F.try_element_at(F.filter(known, lambda x: x["i"] <= i), F.lit(-1)), F.get(F.filter(known, lambda x: x["i"] >= i), F.lit(0))
        line = left["v"] + (right["v"] - left["v"]) * (i - left["i"]) / F.nullif(right["i"] - left["i"], F.lit(0))
        return F.coalesce(v, line, left["v"], right["v"])

    return F.when(F.size(known) > 0, F.transform(values, fill)).otherwise(values)
