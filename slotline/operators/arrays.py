"""Array columns: patches, instance normalisation, causal smoothing, pooling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, weights: list[float]) -> Column:
    """Dot product with weights known when the plan is made; missing entries add nothing."""
    return total(F.zip_with(a, F.array(*map(F.lit, weights)), lambda x, w: F.coalesce(x.cast("double") * w, F.lit(0.0))))


def patches(a: Column, width: int, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda p: F.slice(a, p * width + 1, F.lit(width)))


def patch_stats(patch: Column) -> Column:
    """mean, sd (population) and end less start of a patch."""
    n = F.size(patch)
    mean = total(patch) / n
    var = total(F.transform(patch, lambda x: x.cast("double") * x)) / n - mean * mean
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), (F.element_at(patch, -1).cast("double") - F.element_at(patch, 1)).alias("rise"))


def first_difference(patch: Column) -> Column:
    """Each entry less the one before; the first is 0."""
    return F.transform(patch, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x.cast("double") - F.get(patch, i - 1)))


def instance_norm(a: Column, eps: float = 1e-5, floor: float = 5.0) -> Column:
    """Entries less their mean, over max(sqrt(var + eps), floor); missing entries stay missing."""
    seen = F.filter(a, lambda x: x.isNotNull())
    n = F.nullif(F.size(seen), F.lit(0))
    mean = total(seen) / n
    var = total(F.transform(seen, lambda x: x.cast("double") * x)) / n - mean * mean
    return F.transform(a, lambda x: (x.cast("double") - mean) / F.greatest(F.sqrt(F.greatest(var, F.lit(0.0)) + eps), F.lit(floor)))


def gaussian_taps(taps: int = 37, sigma: float = 6.0) -> list[float]:
    """One-sided weights, the present last."""
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(taps - 1, -1, -1)]


def causal_smooth(window: Column, taps: list[float]) -> Column:
    """Weighted mean of the recorded entries of a window that ends now; NULL if there is none."""
    mass = dot(F.transform(window, lambda x: x.isNotNull().cast("double")), taps)
    return dot(window, taps) / F.nullif(mass, F.lit(0.0))


def last_and_mean(rows: Column, width: int) -> Column:
    """The last of an array of vectors, followed by their mean."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: total(F.transform(rows, lambda r: F.get(r, j))) / F.size(rows))
    return F.concat(F.transform(F.element_at(rows, -1), lambda x: x.cast("double")), mean)
