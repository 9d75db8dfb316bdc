"""Queries of the problems on corpora, samples and splits, over the whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm.group_split import assign_splits, group_split, must_share, split_report
from slotline.llm.mixing import SourceMix
from slotline.llm.proportional_sample import ProportionalSample, distinct_records
from slotline.llm.template_residue import ResidueDetector, clean_corpus
from slotline.llm.tokens import encoder
from slotline.sources.tables import table


def _sample(spark: SparkSession, d: str) -> ProportionalSample:
    key = ["source_file", "id", "date"]
    records = distinct_records(table(spark, d, "template", key), key)
    return ProportionalSample(records, table(spark, d, "sample_targets"), "source_file", key, records.count() / 5)


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows().withColumn("sample_priority", F.round("sample_priority", 4))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report().withColumn("actual_share", F.round("actual_share", 6)).withColumn("wanted", F.round("wanted", 4))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report().filter(~F.col("reachable")).select("source_file")


def _people(spark: SparkSession, d: str) -> DataFrame:
    return group_split(table(spark, d, "train", ["source_file", "id"]), table(spark, d, "enrolment_links"), table(spark, d, "split_targets"))


def p7_assigned(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(table(spark, d, "train", ["row_pos", "source_file", "id"]), table(spark, d, "enrolment_links"), table(spark, d, "split_targets")).select("row_pos", "component", "split")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(_people(spark, d), table(spark, d, "split_targets")).withColumn("actual_share", F.round("actual_share", 6))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return must_share(_people(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", ["doc_id", "text"])
    return encoder(spark).learnt(documents).encode(documents).select("doc_id", "ids")


def _mix(spark: SparkSession, d: str) -> SourceMix:
    return SourceMix(table(spark, d, "documents", ["doc_id", "text", "source"]), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).sources_table().filter(~F.col("reachable")).select("source")


def p10_marks(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", ["doc_id", "text", "sender"])
    return ResidueDetector.fit(documents).mark(documents)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_marks(spark, d).filter("marked").select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_corpus(table(spark, d, "documents", ["doc_id", "text"]), p10_marks(spark, d)).select("doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_sample, p5_report, p7_found, p7_assigned, p7_report, p8_ids, p9_found, p9_mix, p9_report, p10_found, p10_marks, p10_clean)}

_WHO = "coalesce({0}source_file{1}, '') || '|' || coalesce(upper(trim({0}id{1})), '')"
_P5 = """
with d as (select distinct source_file, id, date from template),
t as (select source_file, sum(greatest(coalesce(target_share, 0), 0)) as target_share, max(coalesce(min_rows, 0)) as min_rows from sample_targets group by 1),
r as (select d.*, target_share, min_rows, row_number() over (partition by d.source_file order by substr(md5('2026|' || coalesce(d.source_file, '∅') || '|' || coalesce(id, '∅') || '|' || coalesce(cast(date as varchar), '∅')), 1, 15)) as k
  from d join t on d.source_file is not distinct from t.source_file),
p as (select *, (k - 0.5) / target_share as priority from r where k <= min_rows or target_share > 0),
s as (select * from p order by k > min_rows, case when k > min_rows then priority end, source_file limit (select greatest(cast(floor(count(*) / 5) as bigint), (select count(*) from p where k <= min_rows)) from d)),
report as (select t.source_file, t.target_share, t.min_rows, greatest(min_rows, target_share * (select count(*) from d) / 5) as wanted,
  (select count(*) from r where r.source_file is not distinct from t.source_file) as available, (select count(*) from s where s.source_file is not distinct from t.source_file) as sampled from t)"""
_P7 = f"""
with recursive people as (select {_WHO.format('', '')} as p, count(*) as n from train group by 1),
link as (select source_file_a || '|' || upper(trim(id_a)) as a, source_file_b || '|' || upper(trim(id_b)) as b from enrolment_links),
edge as (select a, b from link where a <> b union select b, a from link where a <> b),
reach as (select a as p, a as q from edge union select r.p, e.b from reach r join edge e on r.q = e.a)"""

_P7_SPLIT = (
    _P7
    + """,
c as (select p, min(q) as component from reach group by 1),
u as (select x.p, x.n, coalesce(c.component, x.p) as component from people x left join c on c.p = x.p),
sizes as (select component, sum(n) as n from u group by 1),
whole as (select sum(n) as t from sizes),
large as (select component, n, row_number() over (order by n desc, component) as i from sizes, whole where n * 256 > t),
placed as (select 0 as i, '' as component, 0 as k, (select list(target_share / (select sum(target_share) from split_targets) * t order by split_name) from split_targets, whole) as rest
  union all select l.i, l.component, list_position(rest, list_max(rest)), list_transform(rest, lambda x, j: case when j = list_position(rest, list_max(rest)) then x - l.n else x end) from placed join large l on l.i = placed.i + 1),
room as (select split_name, row_number() over (order by split_name) as k, row_number() over (order by split_name desc) as back from split_targets),
free as (select r.*, greatest(list_extract((select arg_max(rest, i) from placed), r.k), 0) as rest from room r),
small as (select component, n, sum(n) over (order by substr(md5('2026|' || component), 1, 15), component) - n / 2 as middle from sizes where component not in (select component from large)),
upto as (select split_name, back, sum(rest) over (order by split_name) / sum(rest) over () * (select sum(n) from small) as upto from free),
s as (select component, (select min_by(split_name, upto + case when back = 1 then 1e18 else 0 end) from upto where back = 1 or middle < upto) as split from small
  union all select component, (select split_name from room where room.k = placed.k) from placed where i > 0)"""
)

ORACLE = {
    "p5_found": _P5 + " select source_file from report where available < wanted",
    "p5_sample": _P5 + " select source_file, id, date, k as sample_rank, round(priority, 4) as sample_priority from s",
    "p5_report": _P5 + " select source_file, target_share, min_rows, round(wanted, 4) as wanted, available, sampled, round(sampled / (select count(*) from s), 6) as actual_share, available >= wanted as reachable from report",
    "p7_found": _P7 + " select r.p as participant_a, r.q as participant_b from reach r join people x on x.p = r.p join people y on y.p = r.q where r.p < r.q",
    "p7_assigned": _P7_SPLIT + f" select row_pos, component, split from train t join u on u.p = {_WHO.format('t.', '')} join s using (component)",
    "p7_report": _P7_SPLIT
    + """, w as (select s.split, s.component, sizes.n from s join sizes using (component))
select t.split_name, t.target_share, cast(coalesce(sum(n), 0) as bigint) as n_rows, count(n) as n_components, round(coalesce(sum(n), 0) / (select t from whole), 6) as actual_share, arg_max(component, n) as largest_component, cast(max(n) as bigint) as largest_rows
from split_targets t left join w on w.split = t.split_name group by 1, 2""",
}
