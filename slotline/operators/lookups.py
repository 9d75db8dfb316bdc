"""Keyed joins with guards, coverage, overlap and format checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.operators.blocks import same_key


class NotUnique(ValueError):
    """Raised where a key that must be unique is not."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise NotUnique(f"{', '.join(keys)} not unique, e.g. {bad}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with the key unique on both sides, else an error."""
    return attach(unique(left, keys), unique(right, keys), keys)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys: every left row, the right's other columns."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, same_key("a", "b", keys), "left").select("a.*", *(F.col(f"b.`{c}`") for c in right.columns if c not in keys))


def flagged(left: DataFrame, known: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Adds a boolean: whether the key is among ``known``."""
    return attach(left, known.select(*keys).distinct().withColumn(flag, F.lit(True)), keys).withColumn(flag, F.coalesce(flag, F.lit(False)))


def exact_lookup(requests: DataFrame, table: DataFrame, keys: Sequence[str], value: str, last_by: str) -> DataFrame:
    """The value at exactly the requested keys, of repeated ones the last by ``last_by``; NULL if there is none."""
    return attach(requests, table.groupBy(*keys).agg(F.max_by(value, last_by).alias(value)), keys)


def zipped(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    """Row-aligned pairs: structs a and b by position, either NULL where its table is shorter."""
    a, b = left.select(pos, F.struct(*left.columns).alias("a")), right.select(pos, F.struct(*right.columns).alias("b"))
    return a.join(b, pos, "full")


def format_report(predictions: DataFrame, template: DataFrame, pos: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row: row counts, positions only in one, mismatches of each key by position, state of each value column (populated, partial, empty)."""
    z = zipped(predictions, template, pos)
    present = F.col("a").isNotNull() & F.col("b").isNotNull()
    filled = lambda v: F.count(F.when(~F.isnan(F.col(f"a.{v}")), F.col(f"a.{v}")))
    state = lambda v: F.when(filled(v) == 0, "empty").when(filled(v) == F.count("a"), "populated").otherwise("partial")
    return z.agg(
        F.count("a").alias("n_predictions"), F.count("b").alias("n_template"), F.count_if(~present).alias("n_unmatched"),
        *(F.count_if(present & ~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))).alias(f"{k}_mismatches") for k in keys), *(state(v).alias(f"{v}_state") for v in values),
    )


def coverage(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per group: rows, and rows in which any of the values is a finite number."""
    any_: Column = F.lit(False)
    for v in values:
        any_ = any_ | F.coalesce(F.abs(F.col(v)) < float("inf"), F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(any_).alias("n_covered"))


def scattered(template: DataFrame, values: DataFrame, pos: str) -> DataFrame:
    """The template's rows with ``values`` (position and further columns) put at their positions; NULL where there is none."""
    unique(values, [pos])
    return template.join(values, pos, "left")


def wanted_rows(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is among the wanted ones, each once; NULL keys meet."""
    a, b = df.alias("a"), wanted.select(*keys).distinct().alias("b")
    return a.join(b, same_key("a", "b", keys), "left_semi")
