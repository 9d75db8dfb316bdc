"""The participants' readings: one spelling of ids, slots, and what counts as recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.sources.tables import epoch_seconds, finite

SLOT_SECONDS = 300


def participant_id(c: Column | str = "id") -> Column:
    """Blanks around an id and its letter case carry no meaning."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def slot(c: Column | str, seconds: int = SLOT_SECONDS) -> Column:
    return F.floor(epoch_seconds(c) / F.lit(seconds)).cast("bigint")


def dated(readings: DataFrame, *values: str) -> DataFrame:
    """Rows with a date: source_file, id in its one spelling, sec, the values NULL where not a finite number."""
    return readings.filter(F.col("date").isNotNull()).select(
        "row_pos", "source_file", participant_id().alias("id"), "date", epoch_seconds("date").alias("sec"), *(finite(v).alias(v) for v in values)
    )
