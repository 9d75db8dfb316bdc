"""Extension points: feature hooks, model heads, batched inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.operators.grid import over_slots


class FeatureHook(Protocol):
    """Adds ``columns``; must neither read what it should predict nor change which rows there are."""

    columns: Sequence[str]

    def apply(self, df: DataFrame) -> DataFrame: ...


class ForbiddenColumn(ValueError):
    """Raised where a hook reads a column that is withheld from it."""


def with_hooks(df: DataFrame, hooks: Sequence[FeatureHook], withheld: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Each hook sees the rows without the withheld columns; its columns are joined on by key."""
    out = df
    for h in hooks:
        seen = df.drop(*withheld)
        try:
            made = h.apply(seen).select(*key, *h.columns)
            _ = made.schema
        except Exception as e:
            if any(w in str(e) for w in withheld):
                raise ForbiddenColumn(f"{type(h).__name__} may not read {', '.join(withheld)}") from e
            raise
        out = out.join(made, list(key), "left")
    return out


class SlotSums:
    """A hook: trailing sums over slots."""

    def __init__(self, values: Sequence[str], slots: int) -> None:
        self.values, self.slots = list(values), slots
        self.columns = [f"{v}_sum_{slots}" for v in values]

    def apply(self, df: DataFrame) -> DataFrame:
        return over_slots(df, lambda f: {f"{v}_sum_{self.slots}": F.coalesce(F.sum(v).over(f(-self.slots + 1, 0)), F.lit(0.0)) for v in self.values}, self.slots - 1, 0)


class WithCodes:
    """Wraps a hook and adds a code of the key beside its columns: a hash into ``places``."""

    def __init__(self, inner: FeatureHook, keys: Sequence[str], places: int = 1 << 16, name: str = "code") -> None:
        self.inner, self.keys, self.places, self.name = inner, list(keys), places, name
        self.columns = [*inner.columns, name]

    def apply(self, df: DataFrame) -> DataFrame:
        return self.inner.apply(df).withColumn(self.name, F.pmod(F.xxhash64(*self.keys), F.lit(self.places)).cast("int"))


def batched_inference(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``load`` is called once a task and returns the function applied to each Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            yield model(f)

    return df.mapInPandas(run, schema)
