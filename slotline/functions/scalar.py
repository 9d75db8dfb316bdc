"""Scalar functions: error-grid lines and zones, time of day, signed logarithm, kernel weights, names."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotline.sources.tables import epoch_seconds

#: Error-grid lines (fixed values): knee, value up to the knee, slope beyond it, value just beyond it.
GRID_LINES = {
    "b_up": (50.0, 60.0, 540 / 450, 60.0),
    "c_up": (50.0, 86.5, 513.5 / 297, 86.5),
    "d_up": (50.0, 124.0, 476 / 191, 124.0),
    "e_up": (50.0, 179.0, 421 / 117, 179.0),
    "b_low": (62.5, 0.0, 430 / 537.5, 50.0),
    "c_low": (97.5, 0.0, 257 / 502.5, 50.0),
    "d_low": (153.0, 0.0, 147 / 447, 50.0),
    "e_low": (238.0, 0.0, 76 / 362, 50.0),
}


def grid_line(name: str, ref: Column) -> Column:
    knee, flat, slope, start = GRID_LINES[name]
    return F.when(ref <= knee, F.lit(flat)).otherwise(slope * (ref - knee) + start)


def error_zone(ref: Column, pred: Column) -> Column:
    """Zone A to E of a prediction against its reference; NULL where either is missing."""
    line = {n: grid_line(n, ref) for n in GRID_LINES}
    zone = F.when((pred <= line["b_up"]) & (pred >= line["b_low"]), "A")
    for inner, outer in ("BC", "CD", "DE"):
        i, o = inner.lower(), outer.lower()
        zone = zone.when(((pred > line[f"{i}_up"]) & (pred <= line[f"{o}_up"])) | ((pred >= line[f"{o}_low"]) & (pred < line[f"{i}_low"])), inner)
    return F.when(ref.isNotNull() & pred.isNotNull(), zone.otherwise("E"))


def clip(x: Column, low: float = 40.0, high: float = 400.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def day_angle(ts: Column) -> Column:
    return 2 * math.pi * F.pmod(epoch_seconds(ts), F.lit(86400)) / 86400


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def past_weight(lag: float, horizon: float, tau: float) -> float:
    """How much of a dose ``lag`` minutes ago still acts within ``horizon`` minutes."""
    return math.exp(-lag / tau) - math.exp(-(lag + horizon) / tau)


def future_weight(lead: float, horizon: float, tau: float) -> float:
    return 1 - math.exp(-(horizon - lead) / tau) if lead <= horizon else 0.0


def composite_key(*parts: str) -> Column:
    return F.concat_ws("\u001f", *parts)


def method_tag(tag: str, horizon: int, scope: str) -> str:
    """``<tag>_h<H>_<scope>`` with what is no word character, dot or dash in the tag replaced."""
    return f"{re.sub(r'[^A-Za-z0-9._-]+', '-', tag)}_h{horizon}_{scope}"


def source_list(text: str) -> list[str]:
    return [x for x in re.split(r"[\s,]+", text.strip()) if x]
