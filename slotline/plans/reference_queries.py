"""Queries of the time-series operators over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.functions import scalar as S
from slotline.operators import arrays as A
from slotline.operators import covariates as C
from slotline.operators import eligibility as E
from slotline.operators import grid as G
from slotline.operators import linear as L
from slotline.operators import lookups as J
from slotline.operators import metrics as M
from slotline.operators import sampling as P
from slotline.operators.blocks import with_place
from slotline.operators.quantiles import exact_median
from slotline.operators.segments import segment_counts, segments
from slotline.sources.readings import participant_id
from slotline.sources.tables import finite, from_epoch_seconds, normalise_missing, table, to_double

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HORIZONS = (6, 12, 18, 24)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _grid(spark: SparkSession, d: str, *values: str) -> DataFrame:
    values = values or ("cgm", "insulin", "basal", "bolus", "carbs")
    return G.to_grid(table(spark, d, "train", ["row_pos", "source_file", "id", "date", *values]), values)


def _rounded(df: DataFrame, *names: str, to: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


def _pooled(df: DataFrame) -> DataFrame:
    return df.withColumn("horizon", F.coalesce(F.col("horizon").cast("string"), F.lit("overall")))


def _grid_sql(*values: str) -> str:
    columns = ", ".join(f"arg_max({v}, row_pos) filter ({v} is not null and isfinite({v})) as {v}" for v in values or ("cgm", "insulin", "basal", "bolus", "carbs"))
    return f"g as (select source_file, upper(trim(id)) as id, cast(floor(epoch(date) / 300) as bigint) as slot, {columns} from train where date is not null group by all)"


def _frame(a: int, b: int) -> str:
    side = lambda k: f"{abs(k)} {'preceding' if k <= 0 else 'following'}"
    return f"over (partition by source_file, id order by slot range between {side(a)} and {side(b)})"


# --- grid, keep-last, lookups at exact slots -------------------------------------------------


@query(f"with {_grid_sql()} select * from g")
def grid_keep_last(spark, d):
    return _grid(spark, d)


_PERSIST = f"""with {_grid_sql('cgm')},
y as (select *, {', '.join(f'max(cgm) {_frame(k, k)} as y{k}' for k in HORIZONS)} from g),
l as (select cast(h as bigint) as horizon, least(greatest(cgm, 40), 400) as pred, case h {' '.join(f'when {5 * k} then y{k}' for k in HORIZONS)} end as ref
  from y, (values {', '.join(f'({5 * k})' for k in HORIZONS)}) v(h) where cgm is not null {' '.join(f'and y{k} is not null' for k in HORIZONS)})"""


def _persistence(spark, d):
    seen = G.over_slots(_grid(spark, d, "cgm"), lambda f: {f"y{k}": G.at_slot("cgm", k, f) for k in HORIZONS}, 0, max(HORIZONS))
    kept = seen.dropna(subset=["cgm", *(f"y{k}" for k in HORIZONS)]).withColumn("pred", S.clip(F.col("cgm")))
    return M.long_pairs(kept, [("pred", f"y{k}", 5 * k) for k in HORIZONS])


@query(_PERSIST + " select coalesce(cast(horizon as varchar), 'overall') as horizon, count(*) as n, round(sqrt(avg((pred - ref) * (pred - ref))), 4) as rmse, round(coalesce(avg(case when ref <> 0 then abs(pred - ref) / ref end) * 100, 0), 4) as mard from l group by grouping sets ((horizon), ())")
def persistence_scores(spark, d):
    return _pooled(_rounded(M.scores(_persistence(spark, d)), "rmse", "mard"))


_MASKED = f"""with {_grid_sql('cgm')},
y as (select *, {', '.join(f'max(cgm) {_frame(k, k)} as y{k}' for k in HORIZONS)} from g),
l as (select cast(h as bigint) as horizon, least(greatest(cgm, 40), 400) as pred, case h {' '.join(f'when {5 * k} then y{k}' for k in HORIZONS)} end as ref
  from y, (values {', '.join(f'({5 * k})' for k in HORIZONS)}) v(h) where cgm is not null)"""


@query(_MASKED + " select horizon, round(sum((pred - ref) * (pred - ref)), 1) as sse, count(*) as n from l where ref is not null group by 1")
def masked_errors(spark, d):
    """Squared errors and counts of each horizon, over the rows that have that one."""
    seen = G.over_slots(_grid(spark, d, "cgm"), lambda f: {f"y{k}": G.at_slot("cgm", k, f) for k in HORIZONS}, 0, max(HORIZONS))
    long = M.long_pairs(seen.withColumn("pred", S.clip(F.col("cgm"))), [("pred", f"y{k}", 5 * k) for k in HORIZONS])
    return M.grouped_rmse(long, ["horizon"]).select("horizon", F.round("sse", 1).alias("sse"), "n")


def _line_sql(name: str) -> str:
    knee, flat, slope, start = S.GRID_LINES[name]
    return f"case when ref <= {knee} then {flat} else {slope!r} * (ref - {knee}) + {start} end as {name}"


_ZONES = "case when p <= b_up and p >= b_low then 'A' when p <= c_up and p >= c_low then 'B' when p <= d_up and p >= d_low then 'C' when p <= e_up and p >= e_low then 'D' else 'E' end"


@query(
    _PERSIST
    + f", b as (select horizon, pred as p, {', '.join(map(_line_sql, S.GRID_LINES))} from l), z as (select horizon, {_ZONES} as zone from b) select coalesce(cast(horizon as varchar), 'overall') as horizon, "
    + ", ".join(f"round(count(*) filter (zone = '{x}') * 100.0 / count(*), 4) as zone_{x.lower()}" for x in "ABCDE")
    + " from z group by grouping sets ((horizon), ())"
)
def error_grid_zones(spark, d):
    return _pooled(_rounded(M.zone_shares(_persistence(spark, d)), *(f"zone_{x}" for x in "abcde")))


@query(f"with {_grid_sql('cgm')} select source_file, id, slot, " + ", ".join(f"round(cgm - max(cgm) {_frame(-k, -k)}, 4) as d{5 * k}" for k in (1, 3, 6, 12)) + " from g")
def deltas(spark, d):
    out = G.over_slots(_grid(spark, d, "cgm"), lambda f: {f"d{5 * k}": F.round(F.col("cgm") - G.at_slot("cgm", -k, f), 4) for k in (1, 3, 6, 12)}, 12, 0)
    return out.drop("cgm")


@query(
    f"with {_grid_sql('cgm')}, h as (select source_file, id, slot, list({{'s': slot, 'v': cgm}}) {_frame(-23, 0)} as w, list({{'s': slot, 'v': cgm}}) {_frame(1, 24)} as f from g) "
    "select source_file, id, slot, "
    + ", ".join(f"cast(list_extract(list_transform(list_filter({c}, lambda x: x.s = slot + ({k})), lambda x: x.v), 1) as double) as {n}" for n, c, k in (("back23", "w", -23), ("back6", "w", -6), ("now", "w", 0), ("next6", "f", 6), ("next24", "f", 24)))
    + ", cast(len(list_filter(w, lambda x: x.v is not null)) as integer) as n_seen from h"
)
def history_and_future(spark, d):
    arrays = lambda f: {"history": G.slots_array("cgm", -23, 0, f), "future": G.slots_array("cgm", 1, 24, f)}
    w = G.over_slots(_grid(spark, d, "cgm"), arrays, 23, 24)
    n = F.size(F.filter("history", lambda x: x.isNotNull()))
    h, f = F.col("history"), F.col("future")
    return w.select("source_file", "id", "slot", h[0].alias("back23"), h[17].alias("back6"), h[23].alias("now"), f[5].alias("next6"), f[23].alias("next24"), n.alias("n_seen"))


@query()
def history_and_future_288(spark, d):
    """Whole histories of a day and futures of two hours at every slot."""
    w = F.col("window")
    return G.windows(_grid(spark, d, "cgm"), "cgm", -287, 24).select("source_file", "id", "slot", F.slice(w, 1, 288).alias("history"), F.slice(w, 289, 24).alias("future"))


_AROUND = f"""with {_grid_sql('cgm')}, k as (select source_file, id, slot, unnest(generate_series(-287, 24)) as k from g),
x as (select k.*, h.cgm as v from k left join g h on h.source_file = k.source_file and h.id = k.id and h.slot = k.slot + k.k)"""
_SPELT = "md5(string_agg(coalesce(cast(cast(round(v * 100) as bigint) as varchar), ''), ',' order by k) filter (k {0}))"


@query(_AROUND + f" select source_file, id, slot, {_SPELT.format('<= 0')} as history, {_SPELT.format('> 0')} as future, count(v) filter (k <= 0) as n_history, count(v) filter (k > 0) as n_future from x group by all")
def history_288(spark, d):
    """``history_and_future_288`` with each array written out, in hundredths, and hashed."""
    spelt = lambda a: F.md5(F.array_join(F.transform(a, lambda v: F.coalesce(F.round(v * 100).cast("bigint").cast("string"), F.lit(""))), ","))
    n = lambda a: F.size(F.filter(a, lambda v: v.isNotNull())).cast("bigint")
    w = history_and_future_288(spark, d)
    return w.select("source_file", "id", "slot", spelt("history").alias("history"), spelt("future").alias("future"), n("history").alias("n_history"), n("future").alias("n_future"))


@query(
    "with r as (select row_pos, source_file, upper(trim(id)) as id, cast(floor(epoch(date)) as bigint) as sec from train where date is not null), t as (select source_file, id, min(sec) as t0 from r group by all) "
    "select row_pos, source_file, id, cast((sec - t0) // 300 as bigint) as i from r join t using (source_file, id) where (sec - t0) % 300 = 0"
)
def ordinal_from_start(spark, d):
    return G.ordinal_from_start(table(spark, d, "train", ["row_pos", "source_file", "id", "date"]))


@query(
    f"with {_grid_sql('cgm')}, s as (select *, lead(slot) over w as b, lead(cgm) over w as v1 from g where cgm is not null window w as (partition by source_file, id order by slot)), "
    "x as (select *, unnest(generate_series(slot + 1, b - 1)) as m from s where b - slot between 2 and 25) select source_file, id, m as slot, round(cgm + (v1 - cgm) * (m - slot) / (b - slot), 4) as filled from x"
)
def interp_fill(spark, d):
    return _rounded(G.interpolate(_grid(spark, d, "cgm")), "filled")


@query(f"with {_grid_sql('cgm')}, s as (select source_file, id, lead(slot) over (partition by source_file, id order by slot) - slot - 1 as gap from g where cgm is not null) select source_file, id, max(gap) as longest, count(*) as n_gaps from s where gap > 0 group by all")
def longest_gap(spark, d):
    return G.gaps(_grid(spark, d, "cgm")).groupBy("source_file", "id").agg(F.max(F.col("to_slot") - F.col("from_slot") - 1).alias("longest"), F.count("*").alias("n_gaps"))


@query()
def window_fill(spark, d):
    """The filled histories of a day of every slot with a value."""
    return G.filled_windows(_grid(spark, d, "cgm"), "cgm", 288)


_FILLED = f"""with {_grid_sql('cgm')}, k as (select source_file, id, slot, unnest(generate_series(-287, 0)) as k from g where cgm is not null),
x as (select k.*, h.cgm as v, case when h.cgm is not null then k.k end as known from k left join g h on h.source_file = k.source_file and h.id = k.id and h.slot = k.slot + k.k),
y as (select *, max(known) over b as kl, min(known) over f as kr, last_value(v ignore nulls) over b as vl, first_value(v ignore nulls) over f as vr from x
  window b as (partition by source_file, id, slot order by k rows unbounded preceding), f as (partition by source_file, id, slot order by k rows between current row and unbounded following)),
z as (select source_file, id, slot, k, v, coalesce(v, case when kl is null then vr else vl + (vr - vl) * (k - kl) / (kr - kl) end) as filled from y)"""


@query(_FILLED + " select source_file, id, slot, round(sum(filled) + 1e-7, 3) as total, round(sum(filled * k) + 1e-7, 3) as moment, round(sum(coalesce(v, -1)) + 1e-7, 3) as marked from z group by all")
def window_fill_sums(spark, d):
    """Sums of ``window_fill``'s arrays, plain and weighted by the place."""
    total = lambda a, f: F.round(F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, v: s + v) + 1e-7, 3)
    w = window_fill(spark, d)
    return w.select("source_file", "id", "slot", total("filled", lambda v: v).alias("total"), total("filled", lambda v, i: v * (i - 287)).alias("moment"), total("marked", lambda v: v).alias("marked"))


# --- segments and eligibility ----------------------------------------------------------------

_SEG = """with s as (select row_pos, source_file, upper(trim(id)) as id from train), c as (select *, case when lag(row_pos) over w is null or (lag(source_file) over w is not distinct from source_file and lag(id) over w is not distinct from id) then 0 else 1 end as ch from s window w as (order by row_pos)),
n as (select *, cast(sum(ch) over (order by row_pos) as bigint) as segment from c)"""


def _segmented(spark, d):
    return segments(table(spark, d, "train", ["row_pos", "source_file", "id"]).withColumn("id", participant_id()), ["source_file", "id"], "row_pos")


@query(_SEG + " select row_pos, segment from n")
def segment_numbers(spark, d):
    return _segmented(spark, d).select("row_pos", "segment")


@query(_SEG + ", o as (select source_file, id, segment, count(*) as n from n group by all) select source_file, id, cast(sum(n) as bigint) as n_rows, count(*) as n_segments, max(n) as longest from o group by all")
def repeated_segments(spark, d):
    return segment_counts(_segmented(spark, d), ["source_file", "id"])


@query(_SEG + ", o as (select source_file, id, segment, count(*) as n from n group by all) select source_file, id, count(*) filter (n >= 312) as long_enough, count(*) filter (n < 312) as too_short from o group by all")
def segment_lengths(spark, d):
    one = _segmented(spark, d).groupBy("source_file", "id", "segment").agg(F.count("*").alias("n"))
    return one.groupBy("source_file", "id").agg(F.count_if(F.col("n") >= 312).alias("long_enough"), F.count_if(F.col("n") < 312).alias("too_short"))


@query(f"with {_grid_sql('cgm')}, c as (select source_file, id, count(cgm) {_frame(-287, 0)} as back, count(cgm) {_frame(1, 24)} as ahead from g) select source_file, id, count(*) filter (back = 288 and ahead = 24) as contiguous, count(*) as n from c group by all")
def contiguity(spark, d):
    """Strict contiguity over 312 slots: 287 back and 24 ahead."""
    c = G.over_slots(_grid(spark, d, "cgm"), lambda f: {"back": F.count("cgm").over(f(-287, 0)), "ahead": F.count("cgm").over(f(1, 24))}, 287, 24)
    return c.groupBy("source_file", "id").agg(F.count_if((F.col("back") == 288) & (F.col("ahead") == 24)).alias("contiguous"), F.count("*").alias("n"))


_ELIGIBLE = f"""with {_grid_sql('cgm', 'insulin', 'carbs')},
m as (select *, case when cgm is not null then slot end as c, case when insulin is not null then slot end as i, case when carbs > 0 then 1 else 0 end as ev from g),
p as (select *, case when c - max(c) {_frame(-288, -1)} - 1 > 5 then max(c) {_frame(-288, -1)} end as cf, case when i - max(i) {_frame(-288, -1)} - 1 > 23 then max(i) {_frame(-288, -1)} end as jf from m),
q as (select *, {', '.join(f'max(cgm) {_frame(k, k)} as y{k}' for k in HORIZONS)}, count(*) {_frame(-287, 24)} as n_rows, count(cgm) {_frame(-287, 0)} as n_history, max(ev) {_frame(-287, 0)} as evs,
  min(c) {_frame(-287, 0)} as ch, max(c) {_frame(-287, 0)} as ct, max(cf) {_frame(-287, 0)} as cm, min(i) {_frame(-287, 0)} as ih, max(i) {_frame(-287, 0)} as it, max(jf) {_frame(-287, 0)} as im from p),
r as (select *, case when false then '' when slot % 3 <> 0 then 'cadence' when {' or '.join(f'y{k} is null' for k in HORIZONS)} then 'target' when cgm is null then 'current' when n_history / 288.0 < 0.5 then 'coverage'
  when ch is null or coalesce(cm >= slot - 287, false) or ch - (slot - 287) > 5 or slot - ct > 5 then 'cgm_gap' when ih is null or coalesce(im >= slot - 287, false) or ih - (slot - 287) > 23 or slot - it > 23 then 'insulin_gap'
  when evs = 0 then 'carbs' else 'eligible' end as reason from q)"""


@query(_ELIGIBLE + " select source_file, reason, count(*) as n from r group by all")
def eligibility_waterfall(spark, d):
    return E.waterfall(E.origins(_grid(spark, d, "cgm", "insulin", "carbs")), ["source_file"])


@query(_ELIGIBLE.replace("when false then ''", "when n_rows < 312 then 'contiguity'") + " select source_file, reason, count(*) as n from r group by all")
def eligibility_strict(spark, d):
    return E.waterfall(E.origins(_grid(spark, d, "cgm", "insulin", "carbs"), E.Rules(contiguous=True)), ["source_file"])


@query(
    f"with {_grid_sql('cgm')}, f as (select *, min(slot) over (partition by source_file, id) as s0, count(*) over (partition by source_file, id) as total, count(cgm) {_frame(-287, 0)} / 288.0 as coverage from g) "
    "select source_file, id, count(*) as n, count(*) filter (total > 288 and slot >= s0 + 287) as with_room, count(*) filter (cgm is not null and coverage >= 0.5) as valid from f group by all"
)
def history_coverage(spark, d):
    g = _grid(spark, d, "cgm")
    span = g.groupBy("source_file", "id").agg(F.min("slot").alias("s0"), F.count("*").alias("total"))
    f = J.attach(G.over_slots(g, lambda w: {"coverage": F.count("cgm").over(w(-287, 0)) / 288.0}, 287, 0), span, ["source_file", "id"])
    return f.groupBy("source_file", "id").agg(
        F.count("*").alias("n"), F.count_if((F.col("total") > 288) & (F.col("slot") >= F.col("s0") + 287)).alias("with_room"), F.count_if(F.col("cgm").isNotNull() & (F.col("coverage") >= 0.5)).alias("valid")
    )


# --- covariates ------------------------------------------------------------------------------

_PAST, _NEXT = ((0, 30), (30, 60), (60, 120), (120, 240), (240, 360)), ((0, 30), (30, 60), (60, 90), (90, 120))
_CHANNELS = ("bolus", "basal", "carbs")


@query(
    f"with {_grid_sql(*_CHANNELS)} select source_file, id, slot, "
    + ", ".join(f"round(coalesce(sum({c}) {_frame(-z // 5 + 1, -a // 5)}, 0), 4) as {c}_past_{a}_{z}" for c in _CHANNELS for a, z in _PAST)
    + ", "
    + ", ".join(f"round(coalesce(sum({c}) {_frame(a // 5 + 1, z // 5)}, 0), 4) as {c}_next_{a}_{z}" for c in _CHANNELS for a, z in _NEXT)
    + ", "
    + ", ".join(f"round(count({c}) {_frame(-71, 0)} / 72.0, 4) as {c}_seen" for c in _CHANNELS)
    + " from g"
)
def binned_sums(spark, d):
    def columns(f):
        total = lambda c, a, b: F.round(F.coalesce(F.sum(c).over(f(a, b)), F.lit(0.0)), 4)
        out = {f"{c}_past_{a}_{z}": total(c, -z // 5 + 1, -a // 5) for c in _CHANNELS for a, z in _PAST}
        out |= {f"{c}_next_{a}_{z}": total(c, a // 5 + 1, z // 5) for c in _CHANNELS for a, z in _NEXT}
        return out | {f"{c}_seen": F.round(F.count(c).over(f(-71, 0)) / 72.0, 4) for c in _CHANNELS}

    return G.over_slots(_grid(spark, d, *_CHANNELS), columns, 71, 24).drop(*_CHANNELS)


@query(
    f"with {_grid_sql('bolus', 'carbs')}, w as (select source_file, id, slot, "
    + ", ".join(f"list({{'s': slot, 'v': {c}}}) filter ({c} is not null) {_frame(a, b)} as {c}_{n}" for c in ("bolus", "carbs") for n, a, b in (("p", -71, 0), ("n", 1, 24)))
    + " from g) select source_file, id, slot, "
    + ", ".join(
        f"round(coalesce(list_sum(list_transform({c}_p, lambda x: x.v * (exp(-5.0 * (slot - x.s) / {t}) - exp(-(5.0 * (slot - x.s) + {h}) / {t})))), 0) + coalesce(list_sum(list_transform({c}_n, lambda x: case when 5 * (x.s - slot) <= {h} then x.v * (1 - exp(-({h} - 5.0 * (x.s - slot)) / {t})) else 0 end)), 0), 4) + 0 as {c}_act_{t}_{h}"
        for c, ts in (("bolus", (55, 120)), ("carbs", (30, 90)))
        for t in ts
        for h in (30, 120)
    )
    + " from w"
)
def action_features(spark, d):
    taus = {"bolus": (55, 120), "carbs": (30, 90)}

    def columns(f):
        return {f"{c}_{n}": F.collect_list(F.when(F.col(c).isNotNull(), F.struct("slot", c))).over(f(a, b)) for c in taus for n, a, b in (("p", -71, 0), ("n", 1, 24))}

    def acting(c: str, t: int, h: int):
        past = F.array(*(F.lit(S.past_weight(5.0 * k, h, t)) for k in range(72)))
        ahead = F.array(*(F.lit(S.future_weight(5.0 * k, h, t)) for k in range(1, 25)))
        p = F.aggregate(f"{c}_p", F.lit(0.0), lambda s, x: s + x[c] * F.get(past, (F.col("slot") - x["slot"]).cast("int")))
        n = F.aggregate(f"{c}_n", F.lit(0.0), lambda s, x: s + x[c] * F.get(ahead, (x["slot"] - F.col("slot")).cast("int") - 1))
        return (F.round(p + n, 4) + 0.0).alias(f"{c}_act_{t}_{h}")

    w = G.over_slots(_grid(spark, d, *taus), columns, 71, 24)
    return w.select("source_file", "id", "slot", *(acting(c, t, h) for c, ts in taus.items() for t in ts for h in (30, 120)))


_BACK_WEIGHT, _NEXT_WEIGHT = "(exp(-5.0 * (slot - x.s) / {t}) - exp(-(5.0 * (slot - x.s) + {h}) / {t}))", "(case when 5 * (x.s - slot) <= {h} then 1 - exp(-({h} - 5.0 * (x.s - slot)) / {t}) else 0 end)"


def _covariates_sql() -> str:
    out = [f"coalesce(sum({c}) {_frame(-z // 5 + 1, -a // 5)}, 0) as {c}_past_{a}_{z}" for c in C.CHANNELS for a, z in C.PAST_BINS]
    out += [f"count({c}) {_frame(1 - C.PAST, 0)} / {C.PAST}.0 as {c}_seen" for c in C.CHANNELS]
    out += [f"coalesce(sum({c}) {_frame(a // 5 + 1, z // 5)}, 0) as {c}_next_{a}_{z}" for c in C.CHANNELS for a, z in C.NEXT_BINS]
    out += [f"coalesce(max({c}) {_frame(-j, -j)}, 0) as {c}_ago_{5 * j}" for c in C.CHANNELS for j in range(C.RAW_PAST)]
    out += [f"coalesce(max({c}) {_frame(j, j)}, 0) as {c}_in_{5 * j}" for c in C.CHANNELS for j in range(1, C.AHEAD + 1)]
    lists = [f"list({{'s': slot, 'v': {c}}}) filter ({c} is not null) {_frame(*f)} as {c}_{n}" for c in C.CHANNELS for n, f in (("p", (1 - C.PAST, 0)), ("n", (1, C.AHEAD)))]
    acts = [
        f"coalesce(list_sum(list_transform({c}_{side[0]}, lambda x: x.v * {w.format(t=t, h=h)})), 0) as {c}_act_{i}_{side}_{h}"
        for c in C.CHANNELS
        for i, t in enumerate(C.TAUS[c])
        for side, w in (("past", _BACK_WEIGHT), ("next", _NEXT_WEIGHT))
        for h in C.ACTION_HORIZONS
    ]
    day = [f"{f}(2 * pi() * ((slot * 300) % 86400) / 86400) as day_{f}" for f in ("sin", "cos")]
    return f"with {_grid_sql(*C.CHANNELS)}, w as (select source_file, id, slot, {', '.join(out + lists)} from g), e as (select *, {', '.join(acts + day)} from w)"


@query(_covariates_sql() + " select source_file, id, slot, " + ", ".join(f"round({n} + 1e-7, 4) + 0 as {n}" for n in C.covariate_names()) + " from e")
def covariates_188(spark, d):
    """All covariates of every slot, one column each."""
    x = C.covariates(_grid(spark, d, *C.CHANNELS))
    return x.select("source_file", "id", "slot", *((F.round(F.col("x")[i] + 1e-7, 4) + 0.0).alias(n) for i, n in enumerate(C.covariate_names())))


@query(
    _FILLED
    + " select source_file, id, slot, "
    + ", ".join(f"round(max(case when k = {-j} then filled end) + 1e-7, 4) as ago_{5 * j}" for j in range(C.RAW_HISTORY))
    + ", "
    + ", ".join(f"round(max(case when k = 0 then filled end) - max(case when k = {-j} then filled end) + 1e-7, 4) + 0 as d{5 * j}" for j in C.DELTAS)
    + ", round(stddev_pop(filled) filter (k > -12) + 1e-7, 4) as sd_hour, round(avg(filled) + 1e-7, 4) as mean_day from z group by all"
)
def history_features(spark, d):
    """Last two hours, changes, spread and mean of the filled history of a day."""
    h = C.history_features(_grid(spark, d, "cgm"))
    return h.select("source_file", "id", "slot", *((F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c) for c in h.columns[3:]))


def _design(spark, d):
    """Covariates, four changes of the filled history and the value itself beside the change of the next half hour."""
    g = _grid(spark, d, "cgm", *C.CHANNELS)
    y = G.over_slots(g.select("source_file", "id", "slot", "cgm"), lambda f: {"y": G.at_slot("cgm", 6, f)}, 0, 6).filter("cgm between 40 and 400 and y between 40 and 400")
    h = C.history_features(g).select("source_file", "id", "slot", F.array(*(f"d{5 * j}" for j in C.DELTAS)).alias("d"))
    key = ["source_file", "id", "slot"]
    rows = J.attach(J.attach(y, h, key), C.covariates(g), key)
    return rows.select(*key, "cgm", "y", (F.col("y") - F.col("cgm")).alias("delta"), F.concat("x", "d").alias("x"))


@query(
    _covariates_sql()
    + f", n as (select {', '.join(f'list({n} order by source_file, id, slot) as {n}' for n in C.covariate_names())} from e), l as (unpivot n on {', '.join(C.covariate_names())} into name i value v) "
    "select a.i, b.i as j, round(list_dot_product(a.v, b.v) + 0.00137, 1) + 0 as v from l a join l b on a.i <= b.i"
)
def gram_188(spark, d):
    """Products of all pairs of covariates."""
    names = C.covariate_names()
    g = L.gram(C.covariates(_grid(spark, d, *C.CHANNELS)), L.Packed("x", len(names)), names)
    return g.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.round(F.col("v") + 0.00137, 1) + 0.0).alias("v"))


@query()
def ridge_192(spark, d):
    """Ridge over the covariates and the changes of the filled history: the next half hour's error, and that of persistence."""
    rows = _design(spark, d)
    model = L.fit_ridge(rows, L.Packed("x", len(C.covariate_names()) + len(C.DELTAS)), "delta", "source_file")
    applied = rows.withColumn("pred", S.clip(F.col("cgm") + model.predict()))
    return _rounded(M.scores(M.long_pairs(applied, [("pred", "y", 30), ("cgm", "y", 0)])), "rmse", "mard")


@query(f"with {_grid_sql('cgm')} select source_file, id, slot, round(avg(cgm) {_frame(-287, 0)} + 1e-7, 4) as mean_day, round(stddev_pop(cgm) {_frame(-11, 0)} + 1e-7, 4) as sd_hour from g where cgm is not null")
def history_summary(spark, d):
    seen = _grid(spark, d, "cgm").filter("cgm is not null")
    return G.over_slots(seen, lambda f: {"mean_day": F.round(F.avg("cgm").over(f(-287, 0)) + 1e-7, 4), "sd_hour": F.round(F.stddev_pop("cgm").over(f(-11, 0)) + 1e-7, 4)}, 287, 0).drop("cgm")


@query(
    f"with {_grid_sql('cgm')}, w as (select source_file, id, slot, list({{'s': slot, 'v': cgm}}) {_frame(-36, 0)} as a from g where cgm is not null) "
    "select source_file, id, slot, round(list_sum(list_transform(a, lambda x: x.v * exp(-0.5 * pow((slot - x.s) / 6.0, 2)))) / list_sum(list_transform(a, lambda x: exp(-0.5 * pow((slot - x.s) / 6.0, 2)))), 4) as smooth from w"
)
def causal_smooth(spark, d):
    seen = _grid(spark, d, "cgm").filter("cgm is not null")
    w = G.over_slots(seen, lambda f: {"a": G.slots_array("cgm", -36, 0, f)}, 36, 0)
    return w.select("source_file", "id", "slot", F.round(A.causal_smooth(F.col("a"), A.gaussian_taps()), 4).alias("smooth"))


@query("select event_id, round(sin(2 * pi() * (floor(epoch(ts)) % 86400) / 86400), 6) + 0 as day_sin, round(cos(2 * pi() * (floor(epoch(ts)) % 86400) / 86400), 6) + 0 as day_cos, cast(hour(ts) * 60 + minute(ts) as integer) as minute_of_day, minute(ts) % 15 = 0 and second(ts) = 0 as on_cadence from events")
def time_of_day(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events", ["event_id", "ts"]).select(
        "event_id", (F.round(F.sin(S.day_angle(ts)), 6) + 0.0).alias("day_sin"), (F.round(F.cos(S.day_angle(ts)), 6) + 0.0).alias("day_cos"), S.minute_of_day(ts).alias("minute_of_day"), ((F.minute(ts) % 15 == 0) & (F.second(ts) == 0)).alias("on_cadence")
    )


@query("select event_id, round(sign(value - 50) * ln(1 + abs(value - 50)), 6) as squeezed, least(greatest(value, 40), 400) as clipped from events")
def signed_log_and_clip(spark, d):
    return table(spark, d, "events", ["event_id", "value"]).select("event_id", F.round(S.signed_log1p(F.col("value") - 50), 6).alias("squeezed"), S.clip(F.col("value")).alias("clipped"))


# --- joins, coverage, validation -------------------------------------------------------------

_KEY = ["source_file", "id", "date"]
_TARGETS = [f"target_{5 * k}" for k in HORIZONS]


@query(
    "with k as (select source_file, id, date, max(row_pos) as at from targets group by all), y as (select k.source_file, k.id, k.date, t.target_30 as y from k join targets t on t.row_pos = k.at) "
    "select t.row_pos, case when isfinite(y.y) then y.y end as target_30 from template t left join y on t.source_file is not distinct from y.source_file and t.id is not distinct from y.id and t.date is not distinct from y.date"
)
def target_join(spark, d):
    y = table(spark, d, "targets", ["row_pos", *_KEY, "target_30"])
    out = J.exact_lookup(table(spark, d, "template", ["row_pos", *_KEY]), y.select(*_KEY, "row_pos", F.coalesce("target_30", F.lit(float("nan"))).alias("target_30")), _KEY, "target_30", "row_pos")
    return out.select("row_pos", finite("target_30").alias("target_30"))


@query("select source_file, count(*) as n, count(*) filter (" + " or ".join(f"coalesce(isfinite({t}), false)" for t in _TARGETS) + ") as n_covered from targets group by 1")
def coverage_gaps(spark, d):
    return J.coverage(table(spark, d, "targets", ["source_file", *_TARGETS]), ["source_file"], _TARGETS)


@query("select source_file, id, date, count(*) as n from template group by all having count(*) > 1")
def duplicate_keys(spark, d):
    return J.duplicate_keys(table(spark, d, "template", _KEY), _KEY)


@query(
    "with a as (select distinct source_file, upper(trim(id)) as id from template), b as (select distinct source_file, upper(trim(id)) as id, true as k from train) "
    "select a.source_file, a.id, coalesce(k, false) as known from a left join b on a.source_file is not distinct from b.source_file and a.id is not distinct from b.id"
)
def known_novel(spark, d):
    people = lambda t: table(spark, d, t, ["source_file", "id"]).select("source_file", participant_id().alias("id"))
    return J.flagged(people("template").distinct(), people("train"), ["source_file", "id"], "known")


@query(
    "with a as (select distinct source_file, upper(trim(id)) as id from template), b as (select distinct source_file, upper(trim(id)) as id from train) "
    "select 'both' as side, source_file, id from (select * from a intersect select * from b) union all select 'template', source_file, id from (select * from a except select * from b) union all select 'train', source_file, id from (select * from b except select * from a)"
)
def key_sets(spark, d):
    a, b = (table(spark, d, t, ["source_file", "id"]).select("source_file", participant_id().alias("id")).distinct() for t in ("template", "train"))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "source_file", "id")
    return side(a.intersect(b), "both").union(side(a.subtract(b), "template")).union(side(b.subtract(a), "train"))


@query(
    "select (select count(*) from template) as n_predictions, (select count(*) from targets) as n_template, cast((select count(*) from template p full join targets t using (row_pos) where p.id is null or t.id is null) as bigint) as n_unmatched, "
    + ", ".join(f"(select count(*) from template p join targets t using (row_pos) where p.{k} is distinct from t.{k}) as {k}_mismatches" for k in ("id", "source_file", "date"))
    + ", "
    + ", ".join(f"'empty' as pred_{5 * k}_state" for k in HORIZONS)
)
def format_report(spark, d):
    values = [f"pred_{5 * k}" for k in HORIZONS]
    return J.format_report(table(spark, d, "template", ["row_pos", *_KEY, *values]), table(spark, d, "targets", ["row_pos", *_KEY]), "row_pos", ["id", "source_file", "date"], values)


_STATE = "case when count({0}) filter (not isnan({0})) = 0 then 'empty' when count({0}) filter (not isnan({0})) = count(*) then 'populated' else 'partial' end as {0}_state"
_STATES = {"pred_30": "target_30", "pred_60": "case when isfinite(target_60) then target_60 else 120 end", "pred_90": "case when false then target_90 end"}


@query(
    f"with p as (select row_pos, id, source_file, date, {', '.join(f'{v} as {k}' for k, v in _STATES.items())} from targets where target_30 is not null) select (select count(*) from p) as n_predictions, (select count(*) from template) as n_template, "
    "(select count(*) from p full join template t using (row_pos) where p.row_pos is null or t.row_pos is null) as n_unmatched, "
    + ", ".join(f"(select count(*) from p join template t using (row_pos) where p.{k} is distinct from t.{k}) as {k}_mismatches" for k in ("id", "source_file", "date"))
    + ", " + ", ".join(_STATE.format(k) for k in _STATES) + " from p"
)
def format_states(spark, d):
    """A report in which a column is partial, one populated, one empty, and rows lack a partner."""
    t = table(spark, d, "targets", ["row_pos", *_KEY, "target_30", "target_60", "target_90"]).filter("target_30 is not null")
    made = t.select("row_pos", *_KEY, F.col("target_30").alias("pred_30"), F.coalesce(finite("target_60"), F.lit(120.0)).alias("pred_60"), F.lit(None).cast("double").alias("pred_90"))
    return J.format_report(made, table(spark, d, "template", ["row_pos", *_KEY]), "row_pos", ["id", "source_file", "date"], list(_STATES))


@query("select t.row_pos, t.source_file, y.target_60 as pred from template t left join (select row_pos, target_60 from targets where isfinite(target_60)) y using (row_pos)")
def scattered_predictions(spark, d):
    """Predictions of some rows put at their positions in the template."""
    made = table(spark, d, "targets", ["row_pos", "target_60"]).select("row_pos", finite("target_60").alias("pred")).filter("pred is not null")
    return J.scattered(table(spark, d, "template", ["row_pos", "source_file"]), made, "row_pos")


@query("select row_pos, cgm from train t where (source_file, upper(trim(id))) in (select source_file, upper(trim(id)) from template where source_file is not null) and isfinite(cgm)")
def wanted_scan(spark, d):
    """The readings of the participants that the template asks for."""
    keys = ["source_file", "id"]
    rows = table(spark, d, "train", ["row_pos", *keys, "cgm"]).withColumn("id", participant_id()).withColumn("cgm", finite("cgm")).filter("cgm is not null")
    wanted = table(spark, d, "template", keys).filter("source_file is not null").withColumn("id", participant_id())
    return J.wanted_rows(rows, wanted, keys).select("row_pos", "cgm")


@query("select source_file, count(*) as n, count(distinct upper(trim(id))) as n_participants, min(date) as first, max(date) as last from train group by 1")
def identity_scan(spark, d):
    t = table(spark, d, "train", ["source_file", "id", "date"])
    return t.groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct(participant_id()).alias("n_participants"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("select source_file, count(*) filter (isfinite(insulin) and insulin <> 0) as insulin, count(*) filter (isfinite(carbs) and carbs <> 0) as carbs, round(avg(cgm) filter (isfinite(cgm)), 4) as mean_cgm, round(median(cgm) filter (isfinite(cgm)), 4) as median_cgm from train group by 1")
def recorded_counts(spark, d):
    t = normalise_missing(table(spark, d, "train", ["source_file", "insulin", "carbs", "cgm"]))
    counts = t.groupBy("source_file").agg(F.count_if(F.col("insulin") != 0).alias("insulin"), F.count_if(F.col("carbs") != 0).alias("carbs"), F.round(F.avg("cgm"), 4).alias("mean_cgm"))
    return J.attach(counts, exact_median(t, ["source_file"], "cgm").select("source_file", F.round("median", 4).alias("median_cgm")), ["source_file"])


@query("select row_pos, try_cast(id as double) as number from template")
def coerced_ids(spark, d):
    return table(spark, d, "template", ["row_pos", "id"]).select("row_pos", to_double("id").alias("number"))


@query("select t.row_pos, coalesce(n.n, 0) as n from template t left join (select source_file, count(*) as n from train where source_file in ('KESTREL1', 'TARN-AID') group by 1) n using (source_file) where source_file in ('KESTREL1', 'TARN-AID')")
def source_filter(spark, d):
    wanted = S.source_list("KESTREL1, TARN-AID")
    counts = table(spark, d, "train", ["source_file"]).filter(F.col("source_file").isin(wanted)).groupBy("source_file").agg(F.count("*").alias("n"))
    rows = table(spark, d, "template", ["row_pos", "source_file"]).filter(F.col("source_file").isin(wanted))
    return rows.join(counts, "source_file", "left").select("row_pos", F.coalesce("n", F.lit(0)).alias("n"))


@query("with m as (select median(target_30) filter (isfinite(target_30)) as m from targets) select t.row_pos, round(coalesce(case when isfinite(target_30) then target_30 end, m, 120.0), 4) as filled from targets t, m")
def median_fallback(spark, d):
    y = normalise_missing(table(spark, d, "targets", ["row_pos", "target_30"]))
    m = ([r.m for r in exact_median(y, [], "target_30", name="m").collect()] or [None])[0]
    return y.select("row_pos", F.round(F.coalesce("target_30", F.lit(m).cast("double"), F.lit(120.0)), 4).alias("filled"))


_SIDES = (("back", -288, 0), ("ahead", 1, 24))


@query(
    f"with {_grid_sql('cgm', 'carbs')} select source_file, id, slot, "
    + ", ".join(f"count(cgm) {_frame(a, b)} as n_{n}, cast(count(case when carbs > 0 then 1 end) {_frame(a, b)} as bigint) as meals_{n}, round(avg(cgm) {_frame(a, b)} + 1e-7, 4) as mean_{n}" for n, a, b in _SIDES)
    + " from g"
)
def range_window_audit(spark, d):
    """[t - 24 h, t] and (t, t + 120 min] of every slot."""

    def columns(f):
        of = lambda n, w: {f"n_{n}": F.count("cgm").over(w), f"meals_{n}": F.count(F.when(F.col("carbs") > 0, 1)).over(w), f"mean_{n}": F.round(F.avg("cgm").over(w) + 1e-7, 4)}
        return {k: v for n, a, b in _SIDES for k, v in of(n, f(a, b)).items()}

    return G.over_slots(_grid(spark, d, "cgm", "carbs"), columns, 288, 24).drop("cgm", "carbs")


@query("select source_file, id, count(*) as n from (select source_file, id, date from template where row_pos % 3 <> 0 union all select source_file, id, date from template where row_pos % 3 <> 1) group by source_file, id, date having count(*) > 1")
def shard_overlap(spark, d):
    t = table(spark, d, "template", ["row_pos", *_KEY])
    shards = t.filter("row_pos % 3 <> 0").unionByName(t.filter("row_pos % 3 <> 1"))
    return J.duplicate_keys(shards, _KEY).select("source_file", "id", "n")


@query("select l.l_orderkey, count(*) as n, round(sum(l.l_extendedprice), 2) as price, any_value(o.o_orderpriority) as priority from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderdate >= timestamp '1998-01-01' group by 1")
def inner_join_counts(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"]).filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    j = table(spark, d, "lineitem", ["l_orderkey", "l_extendedprice"]).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.any_value("o_orderpriority").alias("priority"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer", ["c_custkey"]).join(table(spark, d, "orders", ["o_custkey"]), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


# --- sampling --------------------------------------------------------------------------------

_H = lambda *c: "md5('2026|' || " + " || '|' || ".join(f"cast({x} as varchar)" for x in c) + ")"


@query(f"with s as (select user_id, case when cast('0x' || substr({_H('user_id')}, 1, 8) as bigint) / 4294967296.0 < 0.15 then 'val' else 'train' end as split, event_type from events) select event_type, split, count(*) as n from s group by all")
def hash_split_counts(spark, d):
    return P.hash_split(table(spark, d, "events", ["event_type", "user_id"]), ["user_id"], 0.15).groupBy("event_type", "split").agg(F.count("*").alias("n"))


@query(f"with r as (select event_id, user_id, row_number() over (partition by user_id order by {_H('event_id')}, event_id) as k from events) select event_id, user_id from r where k <= 5")
def capped_sample(spark, d):
    return P.capped(table(spark, d, "events", ["event_id", "user_id"]), ["user_id"], ["event_id"], 5)


@query(
    f"with r as (select event_id, user_id, value, row_number() over (partition by user_id order by {_H('event_id')}, event_id) as k from events), c as (select event_id, user_id, row_number() over (partition by user_id order by {_H('event_id').replace('2026', '2027')}, event_id) as k from r where k <= 20 and value > 20) select event_id, user_id from c where k <= 5"
)
def two_stage_sample(spark, d):
    return P.capped_twice(table(spark, d, "events", ["event_id", "user_id", "value"]), ["user_id"], ["event_id"], 5, F.col("value") > 20).select("event_id", "user_id")


@query(
    f"with q as (select event_type, least(cast(round_even(500.0 / (select count(distinct event_type) from events), 0) as bigint), count(*)) as quota from events group by 1), r as (select event_id, event_type, row_number() over (partition by event_type order by {_H('event_id')}, event_id) as k from events) select event_id, event_type from r join q using (event_type) where k <= quota"
)
def balanced_quota(spark, d):
    return P.stratified(table(spark, d, "events", ["event_id", "event_type"]), "event_type", ["event_id"], 500, balanced=True)


@query("select row_pos, source_file from template where row_pos // 64 in (select cast(round_even(j * (select max(row_pos) // 64 from template) / 4.0, 0) as bigint) from (values (0), (1), (2), (3), (4)) v(j))")
def spread_sample(spark, d):
    return P.spread_blocks(table(spark, d, "template", ["row_pos", "source_file"]), "row_pos", 64, 5)


@query("select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 25")
def top_users(spark, d):
    return table(spark, d, "events", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(25)


@query("select row_pos, source_file, upper(trim(id)) as id, row_number() over (partition by source_file, upper(trim(id)) order by date, row_pos) - 1 as place from train where date is not null")
def sorted_by_key_and_time(spark, d):
    """Each reading's place in its participant's record, by time."""
    rows = table(spark, d, "train", ["row_pos", "source_file", "id", "date"]).filter("date is not null").withColumn("id", participant_id())
    return with_place(rows, ["source_file", "id"], ["date", "row_pos"], F.to_date("date")).select("row_pos", "source_file", "id", F.col("place").cast("bigint").alias("place"))


@query(
    f"with q as (select event_type, least(cast(round_even(count(*) * (500.0 / (select count(*) from events)), 0) as bigint), count(*)) as quota from events group by 1), r as (select event_id, event_type, row_number() over (partition by event_type order by {_H('event_id')}, event_id) as k from events) select event_id, event_type from r join q using (event_type) where k <= quota"
)
def stratified_quota(spark, d):
    return P.stratified(table(spark, d, "events", ["event_id", "event_type"]), "event_type", ["event_id"], 500)


@query(f"select event_id, user_id from events where user_id in (select user_id from (select distinct user_id from events) order by {_H('user_id')}, user_id limit (select greatest(1, cast(round_even(0.2 * count(distinct user_id), 0) as bigint)) from events))")
def group_holdout(spark, d):
    return P.group_holdout(table(spark, d, "events", ["event_id", "user_id"]), "user_id", 0.2)


@query(
    f"with r as (select event_id, event_type, row_number() over (partition by event_type order by {_H('event_id')}, event_id) as k from events), f as (select event_id, event_type from r where k = 1) select * from f union all select * from (select event_id, event_type from r where k > 1 order by {_H('event_id')}, event_id limit (select 50 - count(*) from f))"
)
def one_per_stratum(spark, d):
    return P.one_per_stratum_then(table(spark, d, "events", ["event_id", "event_type"]), "event_type", ["event_id"], 50)


@query("with r as (select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 as i, count(*) over (partition by user_id) as n from events) select event_id, user_id from r where i in (select cast(round_even(j * (n - 1) / 6.0, 0) as bigint) from (values (0), (1), (2), (3), (4), (5), (6)) v(j))")
def even_pick(spark, d):
    return P.evenly_spaced(table(spark, d, "events", ["event_id", "user_id"]), ["user_id"], "event_id", 7)


@query("select event_type, cast(dense_rank() over (order by min(event_id)) - 1 as integer) as code from events group by 1")
def first_seen_codes(spark, d):
    first = table(spark, d, "events", ["event_type", "event_id"]).groupBy("event_type").agg(F.min("event_id").alias("_first"))
    return with_place(first, [], ["_first"], F.floor(F.col("_first") / 65_536), "code").select("event_type", F.col("code").cast("int").alias("code"))


# --- linear models and scores ----------------------------------------------------------------

_X = ["l_quantity", "l_discount", "l_tax"]


@query("select * from (" + " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as sd from lineitem" for c in _X) + ")")
def feature_moments(spark, d):
    return _rounded(L.moments(table(spark, d, "lineitem", _X), _X), "mean", "sd", to=6)


@query(" union all ".join(f"select '{a}' as i, '{b}' as j, round(sum({a} * {b}), 2) as v from lineitem" for k, a in enumerate(_X) for b in _X[k:]))
def gram_matrix(spark, d):
    return _rounded(L.gram(table(spark, d, "lineitem", _X), _X), "v", to=2)


@query()
def ridge_apply(spark, d):
    g = _grid(spark, d, "cgm")
    w = G.over_slots(g, lambda f: {"y": G.at_slot("cgm", 6, f), **{f"d{5 * k}": F.col("cgm") - G.at_slot("cgm", -k, f) for k in (1, 3, 6)}}, 6, 6)
    w = w.filter("cgm between 40 and 400 and y between 40 and 400").withColumn("delta", F.col("y") - F.col("cgm"))
    x = ["cgm", "d5", "d15", "d30"]
    model = L.fit_ridge(w, x, "delta", "source_file")
    applied = w.dropna(subset=[*x, "y"]).withColumn("pred", S.clip(F.col("cgm") + model.predict()))
    return _rounded(M.scores(M.long_pairs(applied, [("pred", "y", 30), ("cgm", "y", 0)])), "rmse", "mard")


@query("select l_returnflag, round(sum(e * e), 2) as sse, count(*) as n, round(sqrt(sum(e * e) / count(*)), 4) as rmse from (select l_returnflag, l_extendedprice / l_quantity - 1500 as e from lineitem) group by 1")
def grouped_rmse(spark, d):
    t = table(spark, d, "lineitem", ["l_returnflag", "l_extendedprice", "l_quantity"]).select("l_returnflag", F.lit(1500.0).alias("ref"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("pred"))
    return M.grouped_rmse(t, ["l_returnflag"]).select("l_returnflag", F.round("sse", 2).alias("sse"), "n", F.round("rmse", 4).alias("rmse"))


@query(_PERSIST + " select round(sum(case when horizon in (30, 60) then 2 else 1 end * (pred - ref) * (pred - ref)) / greatest(sum(case when horizon in (30, 60) then 2 else 1 end), 1), 4) as loss from l")
def weighted_loss(spark, d):
    return _rounded(M.weighted_mse(_persistence(spark, d), (30, 60)), "loss")


@query("with s as (select l_linenumber as k, round(sqrt(avg(pow(l_quantity - 5 * l_linenumber, 2))), 6) as rmse from lineitem group by 1) select arg_min(k, {'r': rmse, 'k': k}) as best, min(rmse) as rmse from s")
def best_of(spark, d):
    s = table(spark, d, "lineitem", ["l_linenumber", "l_quantity"]).groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.sqrt(F.avg(F.pow(F.col("l_quantity") - 5 * F.col("l_linenumber"), 2))), 6).alias("rmse"))
    return s.agg(F.min_by("k", F.struct("rmse", "k")).alias("best"), F.min("rmse").alias("rmse"))


# --- arrays ----------------------------------------------------------------------------------


@query(
    "with p as (select vec_id, cast(unnest([0, 1, 2, 3]) as integer) as patch, embedding as e from embeddings), s as (select vec_id, patch, list_transform(e[patch * 16 + 1 : patch * 16 + 16], lambda x: cast(x as double)) as a from p) "
    "select vec_id, patch, round(list_avg(a), 5) + 0 as mean, round(list_stddev_pop(a), 5) as sd, round(a[16] - a[1], 5) + 0 as rise, round(a[2] - a[1], 5) + 0 as step2, round(a[16] - a[15], 5) + 0 as step16 from s"
)
def patch_stats(spark, d):
    t = table(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", F.posexplode(A.patches(F.col("embedding"), 16, 4)).alias("patch", "a"))
    s, f = A.patch_stats(F.col("a")), A.first_difference(F.col("a"))
    return t.select("vec_id", "patch", (F.round(s["mean"], 5) + 0.0).alias("mean"), F.round(s["sd"], 5).alias("sd"), (F.round(s["rise"], 5) + 0.0).alias("rise"), (F.round(f[1], 5) + 0.0).alias("step2"), (F.round(f[15], 5) + 0.0).alias("step16"))


@query("with a as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as a from embeddings) select vec_id, round((a[1] - list_avg(a)) / greatest(sqrt(list_var_pop(a) + 1e-5), 0.05), 5) as first, round((a[64] - list_avg(a)) / greatest(sqrt(list_var_pop(a) + 1e-5), 0.05), 5) as last from a")
def instance_norm(spark, d):
    n = A.instance_norm(F.col("embedding"), floor=0.05)
    return table(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", n.alias("n")).select("vec_id", F.round(F.col("n")[0], 5).alias("first"), F.round(F.col("n")[63], 5).alias("last"))


@query("with a as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as a from embeddings) select vec_id, round(a[49], 5) as last0, round((a[1] + a[17] + a[33] + a[49]) / 4, 5) as mean0 from a")
def last_and_mean(spark, d):
    v = A.last_and_mean(A.patches(F.col("embedding"), 16, 4), 16)
    return table(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 5).alias("last0"), F.round(F.col("v")[16], 5).alias("mean0"))


@query("select row_pos, source_file || chr(31) || upper(trim(id)) as key, 'a-b_h60_full' as tag, date_trunc('second', date) as date from template where source_file is not null and date is not null")
def composite_keys(spark, d):
    from slotline.sources.tables import epoch_seconds

    t = table(spark, d, "template", ["row_pos", *_KEY]).filter("source_file is not null and date is not null").withColumn("id", participant_id())
    return t.select("row_pos", S.composite_key("source_file", "id").alias("key"), F.lit(S.method_tag("a b", 60, "full")).alias("tag"), from_epoch_seconds(epoch_seconds("date")).alias("date"))
