"""Checks that raise: incomplete joins, missed keys, unknown names, arguments out of range, results that differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.operators.lookups import exact_lookup


class GuardError(ValueError):
    """A check that the data does not pass."""


def complete(joined: DataFrame, values: Sequence[str], n: int | None = None) -> DataFrame:
    """The table, if every value of every row is a number (neither NULL nor NaN) and it has ``n`` rows; else an error."""
    lacking = F.lit(False)
    for v in values:
        lacking = lacking | F.col(v).isNull() | F.isnan(F.col(v).cast("double"))
    found = joined.agg(F.count("*").alias("n"), F.count_if(lacking).alias("lacking")).first()
    if found.lacking or (n is not None and found.n != n):
        raise GuardError(f"{found.lacking} of {found.n} rows lack a value" + ("" if n is None else f"; {n} rows were expected"))
    return joined


def found_all(requests: DataFrame, table: DataFrame, keys: Sequence[str], value: str, last_by: str) -> DataFrame:
    """``exact_lookup``, with an error that names some of the keys for which there is no value."""
    out = exact_lookup(requests, table, keys, value, last_by)
    missed = out.filter(F.col(value).isNull()).select(*keys).limit(5).collect()
    if missed:
        raise GuardError(f"no {value} at {[tuple(r) for r in missed]}")
    return out


def only_sources(df: DataFrame, wanted: Sequence[str], column: str = "source_file") -> DataFrame:
    """The rows of the wanted sources; an error if a wanted one is not in the table."""
    there = {r[0] for r in df.filter(F.col(column).isin(list(wanted))).select(column).distinct().collect()}  # at most the wanted ones
    unknown = sorted(set(wanted) - there)
    if unknown:
        raise GuardError(f"unknown {column}: {', '.join(unknown)}")
    return df.filter(F.col(column).isin(list(wanted)))


def in_range(name: str, value: float, low: float | None = None, high: float | None = None) -> float:
    """An argument within its bounds, else an error."""
    if value != value or (low is not None and value < low) or (high is not None and value > high):
        raise GuardError(f"{name} = {value} is not within {low} and {high}")
    return value


def report_errors(report: DataFrame, required: Sequence[str]) -> list[str]:
    """What is wrong in a one-row format report: rows without a partner, keys that differ, required columns that are not populated, nothing populated at all."""
    r = report.first().asDict()
    out = [f"{k}: {v}" for k, v in r.items() if (k == "n_unmatched" or k.endswith("_mismatches")) and v]
    states = {k.removesuffix("_state"): v for k, v in r.items() if k.endswith("_state")}
    out += [f"{c} is {states.get(c, 'absent')}" for c in required if states.get(c) != "populated"]
    out += [f"{c} is partial" for c, v in states.items() if v == "partial" and c not in required]
    return out + (["nothing is populated"] if states and "populated" not in states.values() else [])


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 2e-4) -> float:
    """Greatest difference of two results of the same rows; an error beyond ``tolerance`` or where a row has no partner."""
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    r = x.join(y, list(keys), "full").agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("d"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("alone")).first()
    if r.alone or (r.d or 0.0) > tolerance:
        raise GuardError(f"results differ by {r.d}, {r.alone} rows have no partner")
    return r.d or 0.0
