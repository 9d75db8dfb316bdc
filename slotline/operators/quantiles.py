"""Exact medians without gathering a group: counts per value, summed up along buckets of the value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.operators.blocks import same_key


def exact_median(df: DataFrame, by: Sequence[str], value: str, width: float = 1.0, name: str = "median", weight: str | None = None) -> DataFrame:
    """One row per group with a recorded value: the keys, the median (the mean of the two middle values) and ``n``.

    Equal values are counted before the shuffle; the counts are summed up within buckets of
    ``width`` and the buckets' sums over the group, so no task holds more than the distinct values
    of a bucket. NULL and NaN are not recorded; NULL keys are a group. ``weight``: a column of how
    often each row counts.
    """
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    counts = counts.withColumn("_bucket", F.floor(F.col("_v") / width))
    inner = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    sizes = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*by)
    starts = sizes.select(*by, "_bucket", (F.sum("_size").over(group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")).alias("_start"), F.sum("_size").over(group).alias("_total"))
    a, b = inner.alias("a"), starts.alias("b")
    placed = a.join(b, same_key("a", "b", [*by, "_bucket"])).select(*(f"a.{k}" for k in by), "a._v", (F.col("b._start") + F.col("a._upto")).alias("_to"), (F.col("b._start") + F.col("a._upto") - F.col("a._n")).alias("_from"), "b._total")
    at = lambda i: F.max(F.when((F.col("_from") <= i) & (i < F.col("_to")), F.col("_v")))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return placed.groupBy(*by).agg(((at(low) + at(high)) / 2).alias(name), F.max("_total").alias("n"))
