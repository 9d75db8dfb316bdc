"""Contiguous blocks of a file: a new segment wherever the key changes in file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 65_536


def segments(df: DataFrame, keys: Sequence[str], pos: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``segment``: 0-based number of the run of equal keys, in the order of ``pos``.

    File order is cut into buckets of ``bucket`` places; each bucket looks back within itself, and
    the buckets' last keys and numbers of changes (one row a bucket) are carried on. NULL keys are equal.
    """
    key = F.struct(*keys)
    rows = df.withColumn("_bucket", F.floor(F.col(pos) / bucket)).withColumn("_key", key)
    within = W.partitionBy("_bucket").orderBy(pos)
    before = F.lag(F.struct("_key")).over(within)
    marked = rows.withColumn("_change", F.when(before.isNull(), 0).when(before["_key"].eqNullSafe(F.col("_key")), 0).otherwise(1)).withColumn("_inner", F.sum("_change").over(within.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy("_bucket").agg(F.min_by("_key", pos).alias("head"), F.max_by("_key", pos).alias("tail"))
    changes = marked.groupBy("_bucket").agg(F.max("_inner").alias("n"))
    along = W.orderBy("_bucket")
    joined = ends.join(changes, "_bucket").withColumn("last", F.lag(F.struct("tail")).over(along))
    seam = F.when(F.col("last").isNull() | F.col("last.tail").eqNullSafe(F.col("head")), 0).otherwise(1)
    starts = joined.withColumn("_seam", seam).select("_bucket", (F.sum(F.col("_seam") + F.col("n")).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("_start"))
    return marked.join(starts, "_bucket").withColumn("segment", (F.col("_start") + F.col("_inner")).cast("bigint")).drop("_bucket", "_key", "_change", "_inner", "_start")


def segment_counts(segmented: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: its rows, segments and longest segment."""
    one = segmented.groupBy(*keys, "segment").agg(F.count("*").alias("n"))
    return one.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_segments"), F.max("n").alias("longest"))
