"""The time-series operators against brute force on small cases."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotline.functions.scalar import GRID_LINES, error_zone, method_tag
from slotline.operators import arrays as A
from slotline.operators import covariates as C
from slotline.operators import eligibility as E
from slotline.operators import grid as G
from slotline.operators import linear as L
from slotline.operators import lookups as J
from slotline.operators import metrics as M
from slotline.operators.blocks import chunked, with_place
from slotline.operators.hooks import ForbiddenColumn, SlotSums, with_hooks
from slotline.operators.segments import segments
from slotline.plans import reference_queries as R
from slotline.sources.tables import MissingColumns, normalise_missing, require_columns
from slotline.streaming.live_grid import live_grid


def grid_of(spark, slots, values, pid="a"):
    return spark.createDataFrame([("s", pid, int(k), None if v is None else float(v)) for k, v in zip(slots, values, strict=True)], "source_file string, id string, slot bigint, cgm double")


def test_frames_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(0)
    slots = np.unique(rng.integers(0, 4000, 900))
    g = grid_of(spark, slots, rng.normal(size=len(slots)))
    sums = lambda block: {r.slot: (r.t, r.y) for r in G.over_slots(g, lambda f: {"t": F.sum("cgm").over(f(-71, 24)), "y": G.at_slot("cgm", 6, f)}, 71, 24, block).collect()}
    a, b = sums(100), sums(10**6)
    assert a.keys() == b.keys() == set(slots.tolist())
    assert all(a[k][0] == pytest.approx(b[k][0]) and a[k][1] == b[k][1] for k in a)


def test_segments_over_bucket_ends(spark):
    rng = np.random.default_rng(5)
    keys = [None if k == 0 else str(k) for k in np.repeat(rng.integers(0, 3, 60), rng.integers(1, 5, 60))]
    want, at = [], 0
    for i, k in enumerate(keys):
        at += i > 0 and keys[i - 1] != k
        want.append(at)
    df = spark.createDataFrame(list(enumerate(keys)), "p bigint, k string").repartition(5)
    for bucket in (3, 7, 1000):
        assert [r.segment for r in segments(df, ["k"], "p", bucket).orderBy("p").collect()] == want


def test_places_and_chunks(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [(None, 3)], "k string, t bigint").repartition(4)
    placed = with_place(df, ["k"], ["t"], F.floor(F.col("t") / 4))
    assert sorted((r.t, r.place) for r in placed.filter("k = 'a'").collect()) == [(i, i) for i in range(25)]
    chunks = {r.chunk: [x.t for x in r.rows] for r in chunked(placed, ["k"], ["t"], 10, 2).filter("k = 'a'").collect()}
    assert chunks == {0: list(range(12)), 1: list(range(8, 22)), 2: list(range(18, 25))}


def test_waterfall_against_brute_force(spark):
    rng = np.random.default_rng(7)
    n, rules = 400, E.Rules(history=24, horizons=(1, 2), cadence=3, longest_cgm_gap=2, longest_insulin_gap=5)
    cgm = [None if v else 100.0 for v in rng.random(n) < 0.15]
    insulin = [None if v else 1.0 for v in rng.random(n) < 0.3]
    carbs = [5.0 if v else 0.0 for v in rng.random(n) < 0.03]
    df = spark.createDataFrame([("s", "a", i, cgm[i], insulin[i], carbs[i]) for i in range(n)], "source_file string, id string, slot bigint, cgm double, insulin double, carbs double")

    def longest(xs):
        best = run = 0
        for x in xs:
            run = run + 1 if x is None else 0
            best = max(best, run)
        return best

    def reason(t):
        back = range(t - 23, t + 1)
        at = lambda xs: [xs[i] if 0 <= i < n else None for i in back]
        if t % 3:
            return "cadence"
        if any(t + k >= n or cgm[t + k] is None for k in (1, 2)):
            return "target"
        if cgm[t] is None:
            return "current"
        if sum(x is not None for x in at(cgm)) < 12:
            return "coverage"
        if longest(at(cgm)) > 2:
            return "cgm_gap"
        if longest(at(insulin)) > 5:
            return "insulin_gap"
        return None if any((x or 0) > 0 for x in at(carbs)) else "carbs"

    got = {r.slot: r.reason for r in E.origins(df, rules).collect()}
    assert got == {t: reason(t) for t in range(n)}
    assert sum(r.n for r in E.waterfall(E.origins(df, rules)).collect()) == n


def test_window_fill_is_numpys(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        v = rng.normal(size=12)
        v[rng.random(12) < rng.random()] = np.nan
        rows.append((i, [None if math.isnan(x) else float(x) for x in v]))
    df = spark.createDataFrame(rows, "i int, a array<double>")
    for r, (_, a) in zip(df.select("i", G.fill_window(F.col("a")).alias("f")).orderBy("i").collect(), rows, strict=True):
        known = [k for k, x in enumerate(a) if x is not None]
        assert r.f == (pytest.approx(np.interp(range(12), known, [a[k] for k in known])) if known else a)


def long_gaps(spark):
    """Readings of two days and more on the grid, with holes of minutes to a day, as a table and as slot -> value."""
    rng = np.random.default_rng(12)
    keep = (rng.random(1500) < 0.8) & ~np.isin(np.arange(1500) // 60, (3, 9, 10, 17, 18, 19, 20, 21))
    known = {1000 + int(k): float(v) for k, v in zip(np.flatnonzero(keep), rng.normal(150, 30, keep.sum()), strict=True)}
    silent = {1000 + int(k): None for k in np.flatnonzero(~keep)[::7]}  # slots of the grid without a value
    both = known | silent
    return grid_of(spark, both, both.values()), both


def test_whole_histories_and_futures_of_every_slot(spark, monkeypatch):
    grid, values = long_gaps(spark)
    monkeypatch.setattr(R, "_grid", lambda *_: grid)
    got = {r.slot: r for r in R.history_and_future_288(spark, "").collect()}
    assert got.keys() == values.keys()
    for k, r in got.items():
        assert list(r.history) == [values.get(j) for j in range(k - 287, k + 1)] and list(r.future) == [values.get(j) for j in range(k + 1, k + 25)]


def test_window_fill_of_whole_histories(spark, monkeypatch):
    grid, values = long_gaps(spark)
    monkeypatch.setattr(R, "_grid", lambda *_: grid)
    got = {r.slot: r for r in R.window_fill(spark, "").collect()}
    assert got.keys() == {k for k, v in values.items() if v is not None}  # every slot with a value, not one in an hour
    for k, r in got.items():
        a = [values.get(j) for j in range(k - 287, k + 1)]
        at = [i for i, x in enumerate(a) if x is not None]
        assert list(r.filled) == pytest.approx(np.interp(range(288), at, [a[i] for i in at]))
        assert list(r.marked) == [-1.0 if x is None else x for x in a]


def test_audit_looks_both_ways_from_every_slot(spark, monkeypatch):
    grid, values = long_gaps(spark)
    monkeypatch.setattr(R, "_grid", lambda *_: grid.withColumn("carbs", F.when(F.col("slot") % 50 == 0, 20.0).otherwise(0.0)))
    got = {r.slot: r for r in R.range_window_audit(spark, "").collect()}
    assert got.keys() == values.keys()
    for k, r in got.items():
        for name, a, b in (("back", k - 288, k), ("ahead", k + 1, k + 24)):
            there = [j for j in range(a, b + 1) if j in values]
            seen = [values[j] for j in there if values[j] is not None]
            assert (r[f"n_{name}"], r[f"meals_{name}"]) == (len(seen), sum(j % 50 == 0 for j in there))
            assert r[f"mean_{name}"] == (pytest.approx(np.mean(seen), abs=1e-4) if seen else None)


def test_contiguity_over_the_whole_window(spark, monkeypatch):
    gap = 700
    monkeypatch.setattr(R, "_grid", lambda *_: grid_of(spark, [k for k in range(1400) if k != gap], [1.0] * 1399))
    want = sum(0 <= k - 287 and k + 24 < 1400 and not k - 287 <= gap <= k + 24 for k in range(1400))
    got = R.contiguity(spark, "").first()
    assert (got.contiguous, got.n) == (want, 1399)


def test_zones_at_their_edges(spark):
    refs = [40, 50, 50.001, 62.5, 62.6, 97.5, 97.6, 153, 153.1, 238, 238.1, 400]
    pairs = [(float(r), float(p)) for r in refs for p in np.linspace(0, 420, 90)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(pairs, "ref double, pred double").withColumn("z", error_zone(F.col("ref"), F.col("pred")))

    def zone(x, p):
        y = {n: flat if x <= knee else slope * (x - knee) + start for n, (knee, flat, slope, start) in GRID_LINES.items()}
        if y["b_low"] <= p <= y["b_up"]:
            return "A"
        for i, o in ("bc", "cd", "de"):
            if y[f"{i}_up"] < p <= y[f"{o}_up"] or y[f"{o}_low"] <= p < y[f"{i}_low"]:
                return i.upper()
        return "E"

    assert all(r.z == (zone(r.ref, r.pred) if r.ref is not None and r.pred is not None else None) for r in df.collect())


def test_scores_of_nothing_and_of_zero_references(spark):
    long = spark.createDataFrame([(30, 1.0, 0.0), (30, 3.0, 2.0), (60, 5.0, 5.0)], "horizon bigint, pred double, ref double")
    got = {r.horizon: r for r in M.scores(long).collect()}
    assert got[30].rmse == pytest.approx(1.0) and got[30].mard == pytest.approx(50.0) and got[None].n == 3
    assert sum(M.zone_shares(long).filter("horizon is null").first()[f"zone_{x}"] for x in "abcde") == pytest.approx(100.0)
    assert M.weighted_mse(long.limit(0), (30,)).first().loss == 0.0


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) * [1, 10] + [0, 5]
    y = x @ [2.0, -0.3] + 1 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(f"g{i % 11}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "g string, a double, b double, y double")
    m = L.fit_ridge(df, ["a", "b"], "y", "g")
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + m.penalty * np.eye(2), z.T @ (y - y.mean()))
    assert m.weights == pytest.approx(w, rel=1e-6) and m.bias == pytest.approx(y.mean()) and m.holdout_rmse < 0.2
    got = df.select(m.predict().alias("p")).toPandas().p.to_numpy()
    assert np.abs(got - (z @ w + y.mean())).max() < 1e-6


def test_wide_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(8)
    d = 192
    x = rng.normal(size=(700, d))
    x[3, 5] = np.nan  # such a row plays no part
    y = np.nan_to_num(x) @ rng.normal(size=d) + rng.normal(0, 0.1, 700)
    df = spark.createDataFrame([(f"g{i % 13}", [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))] + [("g", None, 1.0)], "g string, x array<double>, y double")
    m = L.fit_ridge(df, L.Packed("x", d), "y", "g")
    x, y = np.delete(x, 3, 0), np.delete(y, 3)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + m.penalty * np.eye(d), z.T @ (y - y.mean()))
    assert m.weights == pytest.approx(w, rel=1e-5, abs=1e-6)
    got = df.filter("x is not null").select(m.predict().alias("p")).toPandas().p.drop(3).to_numpy()
    assert np.abs(got - (z @ w + y.mean())).max() < 1e-6
    g = {(r.i, r.j): r.v for r in L.gram(df, L.Packed("x", d), [f"c{i:03}" for i in range(d)]).collect()}
    assert len(g) == d * (d + 1) // 2 and g["c000", "c191"] == pytest.approx(x[:, 0] @ x[:, 191])


def test_covariates_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [("s", "a", int(k), *(None if rng.random() < 0.5 else float(rng.integers(0, 9)) for _ in C.CHANNELS)) for k in np.unique(rng.integers(500, 1900, 700))]
    df = spark.createDataFrame(rows, "source_file string, id string, slot bigint, bolus double, basal double, carbs double")
    names = C.covariate_names()
    by = {block: {r.slot: dict(zip(names, r.x, strict=True)) for r in C.covariates(df, block).collect()} for block in (50, 576)}
    assert len(names) == 188 and by[50].keys() == by[576].keys() == {r[2] for r in rows}
    value = {(r[2], c): v for r in rows for c, v in zip(C.CHANNELS, r[3:], strict=True) if v is not None}
    for s, x in by[50].items():
        assert x == pytest.approx(by[576][s])
        assert x["carbs_past_0_30"] == sum(value.get((s - j, "carbs"), 0) for j in range(6)) and x["bolus_in_120"] == value.get((s + 24, "bolus"), 0)
        assert x["basal_seen"] == pytest.approx(sum((s - j, "basal") in value for j in range(72)) / 72)
    assert C.covariates(df.limit(0)).count() == 0


def test_guards(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    with pytest.raises(J.NotUnique):
        J.one_to_one(df, df, ["k"])
    with pytest.raises(MissingColumns):
        require_columns(df, ["nope"])
    assert J.attach(df, df.filter("v = 3").withColumnRenamed("v", "w"), ["k"]).filter("w = 3").first().v == 3  # NULL keys meet
    bad = spark.createDataFrame([(math.nan,), (math.inf,), (-99.0,), (1.0,)], "x double")
    assert [r.x for r in normalise_missing(bad, sentinels=[-99.0]).collect()] == [None, None, None, 1.0]
    assert method_tag("a b/c", 60, "full") == "a-b-c_h60_full"


def test_hooks_may_not_read_what_is_withheld(spark):
    g = grid_of(spark, range(5), range(5)).withColumn("bolus", F.lit(1.0))
    out = with_hooks(g, [SlotSums(["bolus"], 3)], ["cgm"], ["source_file", "id", "slot"])
    assert [r.bolus_sum_3 for r in out.orderBy("slot").collect()] == [1.0, 2.0, 3.0, 3.0, 3.0]
    with pytest.raises(ForbiddenColumn):
        with_hooks(g, [SlotSums(["cgm"], 3)], ["cgm"], ["source_file", "id", "slot"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=37, max_size=37))
def test_smoother_weights(spark, window):
    taps = A.gaussian_taps()
    got = spark.createDataFrame([(window,)], "a array<double>").select(A.causal_smooth(F.col("a"), taps).alias("s")).first().s
    known = [(x, w) for x, w in zip(window, taps, strict=True) if x is not None]
    assert got == (pytest.approx(sum(x * w for x, w in known) / sum(w for _, w in known), abs=1e-9) if known else None)


def test_stream_gives_the_batch_grid(spark, tmp_path):
    rows = [(i, "s", " a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=2 * i), float(i)) for i in range(60)] + [(99, "s", "a", dt.datetime(2024, 1, 2), 1.0)]
    df = spark.createDataFrame(rows, "row_pos bigint, source_file string, id string, date timestamp_ntz, cgm double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live_grid(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.slot, r.value) for r in spark.table("live").collect()}
    assert got == {(r.slot, r.cgm) for r in G.to_grid(df.filter("row_pos < 99"), ["cgm"]).collect()}  # the last row only moves the watermark
