"""Model heads behind one interface, per-horizon feature lists, and sweeps over variants."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions.scalar import clip, signed_log1p
from slotline.operators.linear import LAMBDAS, fit_ridge, moments
from slotline.operators.metrics import long_pairs, scores


class Head(Protocol):
    """Fits on one table and adds a prediction column to another."""

    def fit_predict(self, train: DataFrame, rows: DataFrame, columns: Sequence[str], y: str, out: str) -> DataFrame: ...


class RidgeHead:
    def __init__(self, group: str | None = None, penalties: Sequence[float] = LAMBDAS) -> None:
        self.group, self.penalties = group, penalties

    def fit_predict(self, train: DataFrame, rows: DataFrame, columns: Sequence[str], y: str, out: str) -> DataFrame:
        return rows.withColumn(out, fit_ridge(train, columns, y, self.group, self.penalties).predict())


class BoostedHead:
    """Gradient-boosted trees; rows with a missing feature get no prediction."""

    def __init__(self, trees: int = 20, depth: int = 5, seed: int = 2026) -> None:
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit_predict(self, train: DataFrame, rows: DataFrame, columns: Sequence[str], y: str, out: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        pack = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="skip")
        model = GBTRegressor(featuresCol="_features", labelCol=y, predictionCol=out, maxIter=self.trees, maxDepth=self.depth, seed=self.seed).fit(pack.transform(train.dropna(subset=[*columns, y])))
        return model.transform(pack.transform(rows)).drop("_features")


def horizon_columns(names: Sequence[str], horizon: int, past: str = "_past_", ahead: str = "_next_") -> list[str]:
    """The features a horizon may use: all but the future bins that end after it (names end in ``<ahead><from>_<to>``)."""
    return [n for n in names if ahead not in n or int(n.rsplit("_", 1)[1]) <= horizon]


def normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed log1p, then less the mean over the standard deviation of the table."""
    logged = df.withColumns({c: signed_log1p(F.col(c)) for c in columns})
    m = {r["column"]: r for r in moments(logged, columns, 1e-6).collect()}  # one row per column
    return logged.withColumns({c: (F.col(c) - float(m[c]["mean"] or 0.0)) / float(m[c]["sd"] or 1.0) for c in columns})


def sweep(train: DataFrame, rows: DataFrame, variants: dict[str, Sequence[str]], heads: dict[str, Head], y: str, horizon: int, anchor: str | None = None) -> DataFrame:
    """Scores of every variant of features with every head; with ``anchor`` the heads predict the change from it."""
    out = None
    for variant, columns in variants.items():
        for name, head in heads.items():
            t, r = (x.withColumn("_y", F.col(y) - (F.col(anchor) if anchor else F.lit(0.0))) for x in (train, rows))
            p = head.fit_predict(t, r, columns, "_y", "_p").withColumn("_pred", clip(F.col("_p") + (F.col(anchor) if anchor else F.lit(0.0))))
            s = scores(long_pairs(p, [("_pred", y, horizon)])).filter("horizon is not null").select(F.lit(variant).alias("variant"), F.lit(name).alias("head"), "horizon", "n", "rmse", "mard")
            out = s if out is None else out.unionByName(s)
    return out
