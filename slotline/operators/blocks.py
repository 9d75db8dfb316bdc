"""Cutting long ordered groups into bounded chunks with margins.

A group (a participant's readings, say) may hold any share of a table. It is ordered without ever
being in one task: rows are ranked within buckets of the order key, the buckets' sizes are summed
up, and the two give each row its place. Places are then cut into chunks, and each chunk also gets
the rows of a margin on both sides, so that what depends on near neighbours only can be worked out
chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def same_key(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "place") -> DataFrame:
    """Adds ``name``: 0-based place of the row in its group by ``order``; ``bucket`` must not fall along ``order``.

    One shuffle of the rows, on (keys, bucket); the running sums are over buckets, not rows.
    """
    rows = df.withColumn("_bucket", bucket)
    inner = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    sizes = rows.groupBy(*keys, "_bucket").count()
    before = F.sum("count").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    a, b = inner.alias("a"), starts.alias("b")
    joined = a.join(b, same_key("a", "b", [*keys, "_bucket"]))
    return joined.select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col("b._start") + F.col("a._rn") - 1).alias(name))


def chunked(placed: DataFrame, keys: Sequence[str], fields: Sequence[str], chunk: int, margin: int, place: str = "place") -> DataFrame:
    """One row per chunk: keys, ``chunk``, ``core_from`` (place of its first own row), ``rows`` (array of structs of place and fields, in order).

    ``rows`` holds at most ``chunk + 2 * margin`` entries.
    """
    at = F.floor(F.col(place) / chunk).cast("bigint")
    into = F.array_distinct(F.array(at, F.floor((F.col(place) - margin) / chunk).cast("bigint"), F.floor((F.col(place) + margin) / chunk).cast("bigint")))
    spread = placed.select(*keys, F.struct(F.col(place).alias("place"), *fields).alias("_row"), F.explode(into).alias("chunk"))
    own = F.max(F.floor(F.col("_row.place") / chunk) == F.col("chunk"))
    return (
        spread.filter(F.col("chunk") >= 0)
        .groupBy(*keys, "chunk")
        .agg(F.array_sort(F.collect_list("_row")).alias("rows"), own.alias("_own"))
        .filter("_own")
        .select(*keys, "chunk", (F.col("chunk") * chunk).alias("core_from"), "rows")
    )
