"""Samples and splits that depend on a hash of the row and not on how the table is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotline.operators.blocks import same_key, with_place


def hashed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) made of the columns."""
    return F.conv(F.substring(hashed(seed, *columns), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def hash_split(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 2026) -> DataFrame:
    """Adds ``split``: 'val' for about ``fraction`` of the keys, 'train' for the others."""
    return df.withColumn("split", F.when(uniform(seed, *keys) < fraction, "val").otherwise("train"))


def hash_place(df: DataFrame, by: Sequence[str], identity: Sequence[str], seed: int, name: str = "_place") -> DataFrame:
    """Adds the 0-based place of each row in its group in the order of the hash, without gathering a group: 65,536 buckets of the hash are ranked each by itself."""
    drawn = df.withColumn("_hash", hashed(seed, *identity))
    return with_place(drawn, by, ["_hash", *identity], F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"), name).drop("_hash")


def _least(df: DataFrame, by: Sequence[str], identity: Sequence[str], seed: int, most: Column) -> DataFrame:
    """Rows of least hash in each group; Spark limits the groups before the shuffle where ``most`` is constant."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(hashed(seed, *identity), *identity)))
    return ranked.filter(F.col("_rank") <= most).drop("_rank")


def capped(df: DataFrame, by: Sequence[str], identity: Sequence[str], cap: int, seed: int = 2026) -> DataFrame:
    """At most ``cap`` rows of each group, without replacement."""
    return _least(df, by, identity, seed, F.lit(cap))


def stratified(df: DataFrame, stratum: str, identity: Sequence[str], n: int, balanced: bool = False, seed: int = 2026) -> DataFrame:
    """About ``n`` rows: each stratum's quota is its share (or an equal one) of ``n``, rounded half to even, at most its size.

    The quotas are rounded one by one, so their sum may differ from ``n``.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("s"), F.count("*").alias("k")).first()
    part = F.lit(n / max(1, total.k)) if balanced else F.col("size") * (n / max(1, total.s or 1))
    quota = sizes.select(F.col(stratum).alias("_s"), F.least(F.bround(part).cast("bigint"), F.col("size")).alias("_quota"))
    joined = df.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    return hash_place(joined, [stratum], identity, seed).filter(F.col("_place") < F.col("_quota")).drop("_place", "_quota")


def group_holdout(df: DataFrame, group: str, fraction: float, seed: int = 2026) -> DataFrame:
    """Rows of max(1, round(fraction * groups)) whole groups."""
    groups = df.select(group).distinct()
    k = max(1, round(fraction * groups.count()))
    chosen = hash_place(groups, [], [group], seed).filter(F.col("_place") < k)
    return df.join(chosen, group, "left_semi")


def one_per_stratum_then(df: DataFrame, stratum: str, identity: Sequence[str], n: int, seed: int = 2026) -> DataFrame:
    """One row of each stratum, topped up to ``n`` from the others."""
    first = capped(df, [stratum], identity, 1, seed)
    rest = df.join(first.select(*identity), list(identity), "left_anti").orderBy(hashed(seed, *identity), *identity)
    return first.unionByName(rest.limit(max(0, n - first.count())))


def evenly_spaced(df: DataFrame, by: Sequence[str], order: str, k: int, bucket: Column | None = None) -> DataFrame:
    """Of each ordered group the rows at round(linspace(0, n - 1, k)), half to even, repeated places once.

    ``bucket`` cuts the order into stretches that are ranked each by itself; for numbers, 65,536 wide ones.
    """
    placed = with_place(df, by, [order], F.floor(F.col(order) / 65_536) if bucket is None else bucket, "_i").alias("p")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).alias("s")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("s._n") - 1) / float(max(1, k - 1))).cast("bigint"))
    return placed.join(sizes, same_key("p", "s", by)).filter(F.array_contains(places, F.col("p._i").cast("bigint"))).select(*(f"p.`{c}`" for c in df.columns))


def shuffled(df: DataFrame, identity: Sequence[str], seed: int, epoch: int) -> DataFrame:
    """Every row once, in an order that depends on seed and epoch only."""
    return df.orderBy(hashed(seed + epoch, *identity), *identity)


def capped_twice(df: DataFrame, by: Sequence[str], identity: Sequence[str], cap: int, keep: Column, times: int = 4, seed: int = 2026) -> DataFrame:
    """``times * cap`` candidates of each group by hash, of those that ``keep`` holds for at most ``cap`` by another."""
    return capped(capped(df, by, identity, times * cap, seed).filter(keep), by, identity, cap, seed + 1)


def spread_blocks(df: DataFrame, pos: str, size: int, n: int) -> DataFrame:
    """The rows of ``n`` blocks of ``size`` positions, evenly spread over the table: those at round(linspace(0, blocks - 1, n)), half to even."""
    last = (df.agg(F.max(pos)).first()[0] or 0) // size
    wanted = sorted({round(j * last / max(1, n - 1)) for j in range(n)})
    return df.filter(F.floor(F.col(pos) / size).isin(wanted))
