"""A sample whose categories have given shares, by divisor-method priorities.

Every record gets a random rank in its category and the priority (rank - 0.5) / target; records of
the minimum floors come first, then the globally smallest priorities until the sample is full. An
exhausted category simply has no more priorities to offer, so its seats go to the others in
proportion.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_CATEGORIES = 100_000
BUCKET_ROWS = 100_000


def seats(available: dict, share: dict, floor: dict, size: int) -> dict:
    """Records each category gives to a sample of ``size``: floors first, then the smallest (rank - 0.5) / share; ties go to the category first in order.

    Floors are met even where their sum exceeds ``size``.
    """
    given = {c: min(n, max(0, floor.get(c, 0))) for c, n in available.items()}
    left = size - sum(given.values())
    if left <= 0:
        return given
    open_ = [c for c in available if share.get(c, 0) > 0 and given[c] < available[c]]

    def count(c, bound: float) -> int:
        return min(available[c], max(given[c], int(bound * share[c] + 0.5)))

    low, high = 0.0, 1.0
    while sum(count(c, high) for c in open_) < left + sum(given[c] for c in open_) and any(count(c, high) < available[c] for c in open_):
        high *= 2
    for _ in range(200):  # until nearly all seats are given; the rest one by one
        mid = (low + high) / 2
        if sum(count(c, mid) - given[c] for c in open_) <= left:
            low = mid
        else:
            high = mid
    for c in open_:
        new = count(c, low)
        left -= new - given[c]
        given[c] = new
    queue = [((given[c] + 0.5) / share[c], str(c), c) for c in open_ if given[c] < available[c]]
    heapq.heapify(queue)
    while left > 0 and queue:
        _, name, c = heapq.heappop(queue)
        given[c] += 1
        left -= 1
        if given[c] < available[c]:
            heapq.heappush(queue, ((given[c] + 0.5) / share[c], name, c))
    return given


def _random(columns: list[str], seed: int) -> Column:
    """60 random bits of a record, as hex digits."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns))), 1, 15)


class ProportionalSample:
    """The sample of ``records`` (one row per record, ``identity`` its distinguishing columns).

    ``targets``: category, target_share, min_rows. ``size`` is unrounded; the sample has its floor,
    rounded down, of rows. Categories without a target give nothing; categories of ``targets``
    without records are reported with 0; NULL is a category like any other if targets name it;
    repeated target rows of a category add up their shares and keep the greatest minimum; NULL or
    negative shares count as 0.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, category: str, identity: list[str], size: float, share: str = "target_share", least: str = "min_rows", seed: int = 2026) -> None:
        spark = records.sparkSession
        self.category, self.size = category, size
        wanted = targets.groupBy(category).agg(F.sum(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.coalesce(least, F.lit(0))).alias("least"))
        counts = records.groupBy(category).agg(F.count("*").alias("n"))
        w, n = wanted.alias("w"), counts.alias("n")
        known = w.join(n, F.col(f"w.{category}").eqNullSafe(F.col(f"n.{category}")), "left").select(f"w.{category}", "share", "least", F.coalesce("n.n", F.lit(0)).alias("n"))
        rows = known.limit(MAX_CATEGORIES + 1).collect()
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories")
        available, shares, floors = ({r[0]: r[k] for r in rows} for k in ("n", "share", "least"))
        order = sorted(available, key=lambda c: (c is not None, c or ""))
        self.given = seats({c: available[c] for c in order}, shares, floors, int(size))
        table = [(c, float(shares[c]), int(floors[c]), int(available[c]), int(self.given[c]), max(1, -(-int(available[c]) // BUCKET_ROWS))) for c in order]
        self._table = spark.createDataFrame(table, f"{category} string, target_share double, min_rows bigint, available bigint, sampled bigint, buckets bigint")
        self._records, self._identity, self._seed = records, identity, seed

    def _ranked(self) -> DataFrame:
        """Every record of a target category with its random place in it, ``_rank``.

        A category is never gathered: records fall into buckets of their random number, each bucket
        is ranked by itself, and the buckets' sizes give its start.
        """
        own = F.col(f"r.`{self.category}`")
        seats_ = self._table.select(F.col(self.category).alias("_c"), F.col("target_share").alias("_share"), F.col("sampled").alias("_sampled"), F.col("buckets").alias("_buckets"))
        known = self._records.alias("r").join(F.broadcast(seats_), own.eqNullSafe(F.col("_c")))  # one row per target category, at most MAX_CATEGORIES
        drawn = known.withColumn("_u", _random(self._identity, self._seed))
        drawn = drawn.withColumn("_bucket", F.floor(F.conv("_u", 16, 10).cast("bigint") / 2.0**60 * F.col("_buckets")).cast("bigint"))
        sizes = drawn.groupBy("_c", "_bucket").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(W.partitionBy("_c").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
        starts = sizes.select(F.col("_c").alias("_d"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_start"))
        inner = drawn.withColumn("_rn", F.row_number().over(W.partitionBy("_c", "_bucket").orderBy("_u", *self._identity)))
        return inner.join(starts, F.col("_c").eqNullSafe(F.col("_d")) & (F.col("_bucket") == F.col("_b"))).withColumn("_rank", F.col("_start") + F.col("_rn"))

    def report(self) -> DataFrame:
        """Per target category: wanted, available, sampled, actual_share, reachable (False where the target or the minimum can't be met).

        ``available`` and ``sampled`` are those of the drawn sample: the last rank of the category's
        records, and how many of them were kept.
        """
        wanted = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * self.size)
        total = max(1, sum(self.given.values()))
        drawn = self._ranked().groupBy(F.col("_c").alias("_drawn")).agg(F.max("_rank").alias("_last"), F.count_if(F.col("_rank") <= F.col("_sampled")).alias("_kept"), F.lit(1).alias("_any"))
        t = self._table.select(self.category, "target_share", "min_rows").join(drawn, F.col(self.category).eqNullSafe(F.col("_drawn")), "left")
        available, sampled = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("_last", "_kept"))
        return t.select(self.category, "target_share", "min_rows", wanted.alias("wanted"), available.alias("available"), sampled.alias("sampled"), (sampled / total).alias("actual_share"), (available >= wanted).alias("reachable"))

    def rows(self) -> DataFrame:
        """The sampled records, with ``sample_rank`` (random place in the category) and ``sample_priority``."""
        chosen = self._ranked().filter(F.col("_rank") <= F.col("_sampled"))
        return chosen.select(*(F.col(f"`{c}`") for c in self._records.columns), F.col("_rank").alias("sample_rank"), ((F.col("_rank") - 0.5) / F.col("_share")).alias("sample_priority"))


def distinct_records(template: DataFrame, key: list[str]) -> DataFrame:
    """One row per distinct key; a missing value is a value of its own."""
    return template.select(*key).distinct()
