"""Filling values that were not recorded from similar records, with provenance.

Functional dependencies are mined from the complete records: for each candidate set of determinants
the share of records that agree with their group's commonest value is measured on the whole table,
and a candidate is used only if that share reaches ``least_confidence``. Of a verified dependency
the entries with enough support and agreement form a dictionary, which is left-joined to the rows to
fill. What no dictionary holds gets the median of the narrowest group that has one.

The readings are counted once, by all determinants and values together; candidates, dictionaries and
medians are sums over those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.operators.quantiles import exact_median
from slotline.session import ensure_checkpoint_dir
from slotline.sources.readings import participant_id
from slotline.sources.tables import finite

_NONE = "∅"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(_NONE))


def _key(*parts: Column) -> Column:
    """One determinant key; a part that is NULL is a value of its own."""
    return F.concat_ws("\u001f", *(_text(p) for p in parts))


def train_candidates() -> dict[str, dict[str, list[Column]]]:
    """Determinants to try, narrowest first, by target field."""
    source, who = F.col("source_file"), participant_id()
    basal, bolus, meal = finite("basal"), finite("bolus"), F.lower(F.trim("meal_label"))
    return {
        "insulin": {"participant,basal,bolus": [source, who, basal, bolus], "source,basal,bolus": [source, basal, bolus], "basal,bolus": [basal, bolus]},
        "carbs": {"participant,bolus,meal": [source, who, bolus, meal], "source,bolus,meal": [source, bolus, meal]},
    }


def train_groups() -> dict[str, list[Column]]:
    """Groups of the fallback, narrowest first."""
    source, who = F.col("source_file"), participant_id()
    return {"participant,hour": [source, who, F.hour("date")], "participant": [source, who], "source": [source]}


@dataclass(frozen=True)
class Mining:
    least_confidence: float = 0.9  # of a dependency, over groups of at least two records
    least_agreement: float = 0.95  # of one dictionary entry
    least_support: int = 3
    groups_least: int = 3


MINING = Mining()


def recorded(c: str) -> Column:
    """The amount, or NULL where it stands for "not recorded": NULL, not finite, or a negative stand-in code."""
    x = finite(c)
    return F.when(x >= 0, x)


class _Counts:
    """The readings' counts by all determinants and target values, checkpointed; keys over them and over the readings."""

    def __init__(self, readings: DataFrame, candidates: dict[str, dict[str, list[Column]]], groups: dict[str, list[Column]]) -> None:
        ensure_checkpoint_dir(readings.sparkSession)
        self.place: dict[str, int] = {}
        columns = []
        for key in [k for sets in candidates.values() for k in sets.values()] + list(groups.values()):
            for c in key:
                if str(c) not in self.place:
                    self.place[str(c)] = len(columns)
                    columns.append(c)
        self.readings = readings.select("row_pos", *(c.alias(f"d{i}") for i, c in enumerate(columns)), *(recorded(t).alias(f"y_{t}") for t in candidates))
        self.cells = self.readings.groupBy(*self.readings.columns[1:]).agg(F.count("*").alias("n")).checkpoint()

    def key(self, columns: list[Column]) -> Column:
        return _key(*(F.col(f"d{self.place[str(c)]}") for c in columns))

    def entries(self, columns: list[Column], target: str) -> DataFrame:
        """Per determinant key: commonest value (the smaller of equals), its count and the number of records."""
        y = F.col(f"y_{target}")
        pairs = self.cells.filter(y.isNotNull()).groupBy(self.key(columns).alias("key"), y.alias("y")).agg(F.sum("n").alias("n"))
        return pairs.groupBy("key").agg(F.max(F.struct("n", F.negative("y").alias("y"))).alias("top"), F.sum("n").alias("n")).select("key", (-F.col("top.y")).alias("y"), F.col("top.n").alias("agree"), "n")

    def medians(self, columns: list[Column], target: str) -> DataFrame:
        """Per group: the median recorded value, ``y``, and ``n``."""
        known = self.cells.filter(F.col(f"y_{target}").isNotNull()).select(self.key(columns).alias("key"), F.col(f"y_{target}").alias("_y"), F.col("n").alias("_w"))
        return exact_median(known, ["key"], "_y", name="y", weight="_w")

    def dependencies(self, candidates: dict[str, dict[str, list[Column]]]) -> DataFrame:
        reports = []
        for target, sets in candidates.items():
            for name, key in sets.items():
                e = self.entries(key, target).filter("n >= 2")
                figures = e.agg((F.sum("agree") / F.nullif(F.sum("n"), F.lit(0))).alias("confidence"), F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))
                reports.append(figures.select(F.lit(target).alias("field"), F.lit(name).alias("determinants"), "confidence", "n_keys", "n_records"))
        return _union(reports)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def mine_dependencies(readings: DataFrame, candidates: dict[str, dict[str, list[Column]]] | None = None) -> DataFrame:
    """One row per candidate: field, determinants, confidence (NULL if no key repeats), n_keys, n_records."""
    candidates = candidates or train_candidates()
    return _Counts(readings, candidates, {}).dependencies(candidates)


def fill_from_similar(
    readings: DataFrame,
    candidates: dict[str, dict[str, list[Column]]] | None = None,
    groups: dict[str, list[Column]] | None = None,
    mining: Mining = MINING,
) -> DataFrame:
    """Long: row_pos, field, value, filled (boolean), provenance.

    Every row of ``readings`` comes out once per field. ``provenance`` is 'recorded', the
    dependency or group that gave the value (as 'dependency: ...' or 'median: ...'), or 'none' where
    even the whole table holds no recorded value (``value`` is then NULL). NULL keys and dates are
    values of their own; repeated rows are filled alike; ties between values go to the smaller.

    Only rows to fill are shuffled, against dictionaries of one row per key; both fields go through
    the same joins, the n-th dictionaries of all fields being one table.
    """
    candidates, groups = candidates or train_candidates(), groups or train_groups()
    counts = _Counts(readings, candidates, groups)
    verified = {(r.field, r.determinants) for r in counts.dependencies(candidates).collect() if r.confidence is not None and r.confidence >= mining.least_confidence}
    steps: dict[str, list[tuple[str, list[Column], DataFrame]]] = {}
    for target, sets in candidates.items():
        own = steps[target] = []
        for name, key in sets.items():
            if (target, name) in verified:
                e = counts.entries(key, target).filter((F.col("n") >= mining.least_support) & (F.col("agree") >= mining.least_agreement * F.col("n")))
                own.append((f"dependency: {name}", key, e.select("key", "y")))
        for name, key in groups.items():
            own.append((f"median: {name}", key, counts.medians(key, target).filter(F.col("n") >= mining.groups_least).select("key", "y")))
    depth = max(len(own) for own in steps.values())

    def cell(target: str) -> Column:
        keys = [counts.key(key) for _, key, _ in steps[target]] + [F.lit(None).cast("string")] * (depth - len(steps[target]))
        return F.struct(F.lit(target).alias("field"), F.col(f"y_{target}").alias("value"), *(F.concat(F.lit(f"{target}|"), k).alias(f"k{i}") for i, k in enumerate(keys)))

    long = counts.readings.select("row_pos", F.inline(F.array(*(cell(t) for t in candidates))))
    kept = long.filter(F.col("value").isNotNull()).select("row_pos", "field", "value", F.lit(False).alias("filled"), F.lit("recorded").alias("provenance"))
    lacking = long.filter(F.col("value").isNull()).drop("value")
    for i in range(depth):
        tables = [own[i][2].select(F.concat(F.lit(f"{t}|"), "key").alias(f"k{i}"), F.struct("y", F.lit(own[i][0]).alias("by")).alias(f"v{i}")) for t, own in steps.items() if i < len(own)]
        lacking = lacking.join(_union(tables), f"k{i}", "left")
    whole = _union([counts.medians([], t).select(F.lit(t).alias("field"), F.struct("y", F.lit("median: all").alias("by")).alias(f"v{depth}")) for t in candidates])
    lacking = lacking.join(F.broadcast(whole), "field", "left")  # one row a field
    found = F.coalesce(*(F.col(f"v{i}") for i in range(depth + 1)))
    filled = lacking.select("row_pos", "field", found["y"].alias("value"), F.lit(True).alias("filled"), F.coalesce(found["by"], F.lit("none")).alias("provenance"))
    return kept.unionByName(filled)
