"""Queries of the general problems, over the whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.operators.fill_from_similar import fill_from_similar, mine_dependencies
from slotline.operators.implausible import implausible
from slotline.operators.keyed_counts import dense_sums, rows_and_members
from slotline.operators.regular_grid import missing_runs, regular_grid, smoothed_blocks
from slotline.operators.trailing_totals import idle_periods, trailing_totals
from slotline.sources.readings import participant_id
from slotline.sources.tables import table

ID = "upper(trim(id))"


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "template", ["source_file", "id"]).select("source_file", participant_id().alias("id"))
    return rows_and_members(t, "source_file", "id").withColumnRenamed("n_members", "n_participants")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "template", ["source_file"])
    total = keys.count()
    return dense_sums(keys, "source_file").filter(F.col("source_file").isNotNull() & (F.col("n_rows") * 20 >= total)).select("source_file")


def _readings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "train", ["source_file", "id", "date", *columns])


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(_readings(spark, d, "cgm"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return missing_runs(smoothed_blocks(_readings(spark, d, "cgm")))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    t = trailing_totals(_readings(spark, d, "carbs", "bolus", "basal"))
    return t.select("source_file", "id", F.date_format("day", "yyyy-MM-dd").alias("day"), "period_days", *(F.round(f"{v}_{k}", 4).alias(f"{v}_{k}") for v in ("carbs", "bolus", "basal") for k in ("total", "avg")), "n_positive")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return idle_periods(trailing_totals(_readings(spark, d, "carbs", "bolus", "basal")))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible(_readings(spark, d, "row_pos", "cgm", "insulin", "basal"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).select("row_pos", "field")


_FILL = ("row_pos", "insulin", "carbs", "basal", "bolus", "meal_label")


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_from_similar(_readings(spark, d, *_FILL)).withColumn("value", F.round("value", 6))


def p6_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return mine_dependencies(_readings(spark, d, *_FILL)).withColumn("confidence", F.round("confidence", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Where a value came from: the rows whose provenance is another than their own record."""
    return p6_filled(spark, d).filter("provenance <> 'recorded'").select("row_pos", "field")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_grid, p3_found, p3_totals, p4_found, p4_flags, p6_found, p6_filled, p6_dependencies)}

_P3 = f"""
with amounts as (
  select distinct source_file, {ID} as id, date,
    case when isfinite(carbs) and carbs >= 0 then carbs end as carbs,
    case when isfinite(bolus) and bolus >= 0 then bolus end as bolus,
    case when isfinite(basal) and basal >= 0 then basal end as basal
  from train where date is not null),
daily as (
  select source_file, id, cast(date as date) as day,
    coalesce(sum(carbs), 0) as carbs, coalesce(sum(bolus), 0) as bolus, coalesce(sum(basal), 0) as basal,
    count(*) filter (carbs > 0) + count(*) filter (bolus > 0) + count(*) filter (basal > 0) as n_positive
  from amounts group by all),
span as (select source_file, id, min(day) as first, max(day) as last from daily group by all),
calendar as (
  select source_file, id, cast(unnest(generate_series(first, last, interval 1 day)) as date) as day from span),
filled as (
  select c.source_file, c.id, c.day, coalesce(carbs, 0) as carbs, coalesce(bolus, 0) as bolus,
    coalesce(basal, 0) as basal, coalesce(n_positive, 0) as n_positive
  from calendar c left join daily d on c.source_file is not distinct from d.source_file and c.id is not distinct from d.id and c.day = d.day),
over_periods as (
  {" union all ".join(f'''
  select source_file, id, day, cast({p} as bigint) as period_days, sum(carbs) over w as carbs, sum(bolus) over w as bolus,
    sum(basal) over w as basal, cast(sum(n_positive) over w as bigint) as n_positive
  from filled window w as (partition by source_file, id order by day rows between {p - 1} preceding and current row)''' for p in (7, 30))})"""

_NOT_RECORDED = "{0} is null or not isfinite({0}) or {0} < 0"

_P6_SETS = {
    "insulin": {"participant,basal,bolus": "s, i, b, o", "source,basal,bolus": "s, b, o", "basal,bolus": "b, o"},
    "carbs": {"participant,bolus,meal": "s, i, o, m", "source,bolus,meal": "s, o, m"},
}
_P6_GROUPS = {"participant,hour": "s, i, h", "participant": "s, i", "source": "s"}


def _p6_sql() -> tuple[str, str]:
    """SQL of the mined dependencies and of the filled rows."""
    amount = lambda c: f"case when isfinite({c}) and {c} >= 0 then {c} end"
    finite = lambda c: f"case when isfinite({c}) then {c} end"
    parts = [f"with r as (select row_pos, source_file as s, upper(trim(id)) as i, hour(date) as h, {finite('basal')} as b, {finite('bolus')} as o, lower(trim(meal_label)) as m, {amount('insulin')} as insulin, {amount('carbs')} as carbs from train)"]
    reports, rows = [], []
    for t, sets in _P6_SETS.items():
        joins, values, origins = [], [f"r.{t}"], [f"when r.{t} is not null then 'recorded'"]

        def step(table: str, columns: str, origin: str) -> None:
            on = " and ".join(f"r.{c} is not distinct from {table}.{c}" for c in columns.split(", "))
            joins.append(f"left join {table} on {on}")  # noqa: B023
            values.append(f"{table}.y")  # noqa: B023
            origins.append(f"when {table}.y is not null then '{origin}'")  # noqa: B023

        for k, (name, columns) in enumerate(sets.items()):
            e, d = f"e_{t}_{k}", f"d_{t}_{k}"
            parts.append(f"{e} as (select {columns}, max(n) as agree, cast(sum(n) as bigint) as n, arg_min(y, {{'a': -n, 'y': y}}) as y from (select {columns}, {t} as y, count(*) as n from r where {t} is not null group by all) group by {columns})")
            parts.append(f"{d} as (select {columns}, y from {e} where n >= 3 and agree >= 0.95 * n and (select sum(agree) / sum(n) from {e} where n >= 2) >= 0.9)")
            reports.append(f"select '{t}' as field, '{name}' as determinants, round(sum(agree) / sum(n), 6) as confidence, count(*) as n_keys, cast(coalesce(sum(n), 0) as bigint) as n_records from {e} where n >= 2")
            step(d, columns, f"dependency: {name}")
        for k, (name, columns) in enumerate(_P6_GROUPS.items()):
            parts.append(f"g_{t}_{k} as (select {columns}, median({t}) as y from r where {t} is not null group by {columns} having count(*) >= 3)")
            step(f"g_{t}_{k}", columns, f"median: {name}")
        parts.append(f"w_{t} as (select median({t}) as y from r)")
        origins.append(f"when w_{t}.y is not null then 'median: all'")
        rows.append(f"select r.row_pos, '{t}' as field, round(coalesce({', '.join([*values, f'w_{t}.y'])}), 6) as value, r.{t} is null as filled, case {' '.join(origins)} else 'none' end as provenance from r {' '.join(joins)}, w_{t}")
    begin = ", ".join(parts)
    return begin + " " + " union all ".join(reports), begin + " " + " union all ".join(rows)


_P6_DEPENDENCIES, _P6_FILLED = _p6_sql()

ORACLE = {
    "p6_dependencies": _P6_DEPENDENCIES,
    "p6_filled": _P6_FILLED,
    "p1_found": "select source_file from template where source_file is not null group by 1 having count(*) * 20 >= (select count(*) from template)",
    "p1_counts": f"select source_file, count(*) as n_rows, count(distinct {ID}) as n_participants from template group by 1",
    "p2_found": f"""
with s as (
  select distinct source_file, {ID} as id, cast(floor(epoch(date) / 300) as bigint) as slot
  from train where date is not null and isfinite(cgm)),
n as (select *, lead(slot) over (partition by source_file, id order by slot) as next from s)
select source_file, id, slot + 1 as first_slot, next - 1 as last_slot from n where next - slot > 1""",
    "p3_found": _P3 + " select source_file, id, strftime(day, '%Y-%m-%d') as day, period_days from over_periods where n_positive = 0",
    "p3_totals": _P3 + """ select source_file, id, strftime(day, '%Y-%m-%d') as day, period_days,
  round(carbs, 4) as carbs_total, round(carbs / period_days, 4) as carbs_avg, round(bolus, 4) as bolus_total,
  round(bolus / period_days, 4) as bolus_avg, round(basal, 4) as basal_total, round(basal / period_days, 4) as basal_avg, n_positive from over_periods""",
    "p6_found": f"""
select row_pos, 'insulin' as field from train where {_NOT_RECORDED.format("insulin")}
union all select row_pos, 'carbs' as field from train where {_NOT_RECORDED.format("carbs")}""",
}
