"""Readings that arrive as a stream, onto the grid: late rows within the watermark, the last recorded value of a slot wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.sources.readings import SLOT_SECONDS, participant_id
from slotline.sources.tables import epoch_seconds, finite


def live_grid(readings: DataFrame, value: str = "cgm", late: str = "2 hours", step: int = SLOT_SECONDS) -> DataFrame:
    """source_file, id, slot, value, n: a slot comes out once the watermark has passed its end (append mode).

    The zoneless dates are read as UTC for the watermark; rows without a date are left out.
    """
    rows = readings.filter(F.col("date").isNotNull()).select(
        "source_file", participant_id().alias("id"), F.timestamp_seconds(epoch_seconds("date")).alias("at"), F.col("row_pos"), finite(value).alias("v")
    )
    window = F.window("at", f"{step} seconds")
    out = rows.withWatermark("at", late).groupBy("source_file", "id", window.alias("w")).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("row_pos"))).alias("value"), F.count("v").alias("n"))
    return out.select("source_file", "id", F.floor(F.unix_seconds("w.start") / step).cast("bigint").alias("slot"), "value", "n")
