"""Scores of forecasts: per horizon and pooled, zones, per source, masked and weighted losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions.scalar import error_zone


def long_pairs(df: DataFrame, pairs: Sequence[tuple[str, str, int]], keep: Sequence[str] = ()) -> DataFrame:
    """(prediction column, reference column, horizon) -> rows of horizon, pred, ref with both recorded."""
    cells = F.array(*(F.struct(F.lit(h).cast("bigint").alias("horizon"), F.col(p).cast("double").alias("pred"), F.col(y).cast("double").alias("ref")) for p, y, h in pairs))
    return df.select(*keep, F.inline(cells)).filter("pred is not null and ref is not null")


def scores(long: DataFrame) -> DataFrame:
    """Per horizon, and pooled as horizon NULL: n, rmse, mard (over ref <> 0, its divisor signed; 0 if none)."""
    e = F.col("pred") - F.col("ref")
    return long.groupingSets([[F.col("horizon")], []], F.col("horizon")).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.coalesce(F.avg(F.when(F.col("ref") != 0, F.abs(e) / F.nullif("ref", F.lit(0.0)))) * 100, F.lit(0.0)).alias("mard")
    )


def zone_shares(long: DataFrame) -> DataFrame:
    """Per horizon, and pooled as horizon NULL: percentage of pairs in each zone; 0 where there is no pair."""
    z = long.withColumn("zone", error_zone(F.col("ref"), F.col("pred")))
    share = lambda x: F.coalesce(F.count_if(F.col("zone") == x) * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias(f"zone_{x.lower()}")
    return z.groupingSets([[F.col("horizon")], []], F.col("horizon")).agg(*(share(x) for x in "ABCDE"))


def grouped_rmse(long: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.col("pred") - F.col("ref")
    return long.groupBy(*by).agg(F.sum(e * e).alias("sse"), F.count("*").alias("n")).withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))


def weighted_mse(long: DataFrame, scored: Sequence[int], weight: float = 2.0) -> DataFrame:
    """Mean squared error in which the scored horizons weigh ``weight`` times; the divisor is at least 1."""
    w = F.when(F.col("horizon").isin(*scored), weight).otherwise(1.0)
    e = F.col("pred") - F.col("ref")
    return long.agg((F.coalesce(F.sum(w * e * e), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(1.0))).alias("loss"))
