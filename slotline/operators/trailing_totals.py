"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.sources.readings import participant_id
from slotline.sources.tables import finite


def daily_totals(readings: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row per participant and day with a dated row: sums of the recorded amounts, ``n_positive`` of those above 0.

    Amounts are recorded finite numbers of at least 0. A row the logger repeated (same participant,
    date and amounts) counts once.
    """
    amount = {v: F.when(finite(v) >= 0, F.col(v) + 0.0) for v in values}
    rows = readings.filter(F.col("date").isNotNull()).select("source_file", participant_id().alias("id"), "date", *(x.alias(v) for v, x in amount.items()))
    once = rows.distinct()
    positive = sum((F.coalesce((F.col(v) > 0).cast("bigint"), F.lit(0)) for v in values), F.lit(0))
    return once.groupBy("source_file", "id", F.to_date("date").alias("day")).agg(
        *(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values), F.sum(positive).alias("n_positive"), F.count("*").alias("n_rows")
    )


def trailing_totals(readings: DataFrame, values: Sequence[str] = ("carbs", "bolus", "basal"), periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each participant, day from its first to its last dated row, and period: totals and averages per day.

    Every daily total is exploded onto the output dates it influences and summed there; calendar
    rows then supply the days nothing reaches. Columns: source_file, id, day, period_days,
    ``<v>_total``, ``<v>_avg`` (per day of the period), n_positive, n_active_days. Rows without a
    date play no part; days before the first row hold nothing; NULL ids or sources form a
    participant of their own; an empty table gives no rows.

    The explosion works on daily totals, at most ``max(periods)`` small rows a day, and the sums
    are partial before the shuffle, so that a participant with most of the readings costs no more
    than its days.
    """
    daily = daily_totals(readings, values).withColumn("day", F.unix_date("day"))
    longest = max(periods)
    reached = daily.select("*", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("_after"))
    sums = []
    for p in periods:
        inside = F.col("_after") < p
        sums += [F.sum(F.when(inside, F.col(v))).alias(f"{v}_{p}") for v in values]
        sums += [F.sum(F.when(inside, F.col("n_positive"))).alias(f"n_positive_{p}"), F.count(F.when(inside, 1)).alias(f"n_active_{p}")]
    totals = reached.groupBy("source_file", "id", (F.col("day") + F.col("_after")).alias("day")).agg(*sums)
    span = daily.groupBy("source_file", "id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = span.select("source_file", "id", F.explode(F.sequence("first", "last")).alias("day"))
    c, t = calendar.alias("c"), totals.alias("t")
    same = F.col("c.source_file").eqNullSafe(F.col("t.source_file")) & F.col("c.id").eqNullSafe(F.col("t.id")) & (F.col("c.day") == F.col("t.day"))
    zero = lambda x: F.coalesce(F.col(f"t.{x}"), F.lit(0))
    each = F.array(
        *(
            F.struct(
                F.lit(p).cast("bigint").alias("period_days"),
                *(zero(f"{v}_{p}").cast("double").alias(f"{v}_total") for v in values),
                *((zero(f"{v}_{p}").cast("double") / p).alias(f"{v}_avg") for v in values),
                zero(f"n_positive_{p}").alias("n_positive"),
                zero(f"n_active_{p}").alias("n_active_days"),
            )
            for p in periods
        )
    )
    return c.join(t, same, "left").select("c.source_file", "c.id", F.date_from_unix_date("c.day").alias("day"), F.inline(each))


def idle_periods(totals: DataFrame) -> DataFrame:
    """Participant, day and period without any recorded amount above 0."""
    return totals.filter(F.col("n_positive") == 0).select("source_file", "id", F.date_format("day", "yyyy-MM-dd").alias("day"), "period_days")
