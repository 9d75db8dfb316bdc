"""Which grid slots can be forecast origins, with the first reason why not."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.operators.grid import at_slot, over_slots


@dataclass(frozen=True)
class Rules:
    history: int = 288
    horizons: tuple[int, ...] = (6, 12, 18, 24)
    cadence: int = 3  # slots
    min_valid: float = 0.5
    longest_cgm_gap: int = 5
    longest_insulin_gap: int = 23
    zero_is_missing: bool = False  # whether an insulin of 0 counts as missing
    carb_events: tuple[str, ...] = ("carbs > 0",)
    contiguous: bool = False  # whether every slot from the history's first to the last horizon must be a row


RULES = Rules()


def origins(grid: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Per grid slot: cgm, coverage, n_history, the targets ``y<k>``, carb_event, cgm_gap, ins_gap and ``reason`` (NULL if eligible).

    Reasons in their order: contiguity (if asked for), cadence, target, current, coverage, cgm_gap, insulin_gap, carbs. A gap
    flag says that the history window holds a run of more missing slots than allowed; runs are cut
    to the window. A run between two recorded slots lies inside the window if the slot before it does.
    """
    h = rules.history
    insulin = F.col("insulin").isNotNull() & (F.lit(True) if not rules.zero_is_missing else F.col("insulin") != 0)
    event = F.expr(" or ".join(f"coalesce({e}, false)" for e in rules.carb_events))
    marked = grid.withColumns({"_cgm": F.when(F.col("cgm").isNotNull(), F.col("slot")), "_ins": F.when(insulin, F.col("slot")), "_carb": event.cast("int")})

    limits = {"_cgm": rules.longest_cgm_gap, "_ins": rules.longest_insulin_gap}

    def first(frame):
        before = {c: F.max(c).over(frame(-h, -1)) for c in limits}
        return {f"{c}_from": F.when(F.col(c) - before[c] - 1 > most, before[c]) for c, most in limits.items()}

    stepped = over_slots(marked, first, h, 0)

    def second(frame):
        past, start = frame(-(h - 1), 0), F.col("slot") - (h - 1)
        out = {f"y{k}": at_slot("cgm", k, frame) for k in rules.horizons}
        out |= {"_rows": F.count("*").over(frame(-(h - 1), max(rules.horizons))), "n_history": F.count("cgm").over(past), "carb_event": F.coalesce(F.max("_carb").over(past), F.lit(0)) > 0}
        for c, most in limits.items():
            head, tail = F.min(c).over(past), F.max(c).over(past)
            inner = F.coalesce(F.max(f"{c}_from").over(past) >= start, F.lit(False))
            out[f"{c[1:]}_gap"] = F.when(head.isNull(), F.lit(h > most)).otherwise(inner | (head - start > most) | (F.col("slot") - tail > most))
        return out

    full = over_slots(stepped, second, h - 1, max(rules.horizons)).withColumn("coverage", F.col("n_history") / F.lit(float(h)))
    lacking = F.lit(False)
    for k in rules.horizons:
        lacking = lacking | F.col(f"y{k}").isNull()
    broken = F.lit(rules.contiguous) & (F.col("_rows") < h + max(rules.horizons))
    reason = (
        F.when(broken, "contiguity").when(F.col("slot") % rules.cadence != 0, "cadence").when(lacking, "target").when(F.col("cgm").isNull(), "current").when(F.col("coverage") < rules.min_valid, "coverage")
        .when(F.col("cgm_gap"), "cgm_gap").when(F.col("ins_gap"), "insulin_gap").when(~F.col("carb_event"), "carbs")
    )
    return full.withColumn("reason", reason).drop("_cgm", "_ins", "_carb", "_cgm_from", "_ins_from", "_rows")


def waterfall(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of slots per first reason; 'eligible' where there is none."""
    return judged.groupBy(*by, F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))
