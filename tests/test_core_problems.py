"""The general problems: brute force on small cases, empty tables, nulls, ties, repeated rows, clashing names."""

import datetime as dt
import math

import numpy as np
import pytest

from slotline.operators.fill_from_similar import fill_from_similar
from slotline.operators.implausible import _hanging, _spikes, LIMITS, implausible
from slotline.operators.keyed_counts import dense_sums, rows_and_members
from slotline.operators.regular_grid import missing_runs, regular_grid, smooth, smoothed_blocks
from slotline.operators.trailing_totals import idle_periods, trailing_totals

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "row_pos bigint, source_file string, id string, date timestamp_ntz, cgm double, insulin double, basal double, bolus double, carbs double, meal_label string, n_rows int, block string, reason string"


def readings(spark, rows):
    """rows of dicts; the last three columns clash with names used inside the operators."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, i if n == "row_pos" else None) for n in names) for i, r in enumerate(rows)], SCHEMA)


def series(values, source="s", pid="a", step=5, **more):
    return [{"source_file": source, "id": pid, "date": T0 + dt.timedelta(minutes=step * i), "cgm": None if v is None else float(v), **more} for i, v in enumerate(values)]


def test_counts_of_hot_null_and_clashing_keys(spark):
    df = spark.createDataFrame([("hot", "A", 1.0)] * 500 + [("b", None, math.nan), (None, "C", 2.0), (None, "D", None)], "k string, n_rows string, v double").repartition(7)
    got = {r.k: (r.n_rows, r.v) for r in dense_sums(df, "k", ["v"]).collect()}
    assert got == {"hot": (500, 500.0), "b": (1, 0.0), None: (2, 2.0)}
    members = {r.k: (r.n_rows, r.n_members) for r in rows_and_members(df.withColumnRenamed("n_rows", "m"), "k", "m").collect()}
    assert members == {"hot": (500, 1), "b": (1, 0), None: (2, 2)}
    many = spark.range(30_000).selectExpr("cast(id % 9973 as string) as k", "1.0 as v").repartition(5)
    assert {(r.k, r.n_rows, r.v) for r in dense_sums(many, "k", ["v"], ranges=7).collect()} == {(str(k), n, float(n)) for k in range(9973) for n in [len(range(k, 30_000, 9973))]}
    assert dense_sums(df.limit(0), "k").count() == 0


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [{"source_file": "s", "id": " a" if i % 2 else "A ", "date": T0 + dt.timedelta(hours=int(h)), "carbs": float(c)} for i, (h, c) in enumerate(zip(rng.integers(0, 24 * 50, 40), rng.integers(-1, 4, 40), strict=True))]
    rows += [rows[0], {"source_file": "s", "id": "A", "date": None, "carbs": 9.0}, {"source_file": None, "id": None, "date": T0, "carbs": math.inf}]
    got = {(r.source_file, r.day, r.period_days): r for r in trailing_totals(readings(spark, rows), ["carbs", "bolus"], (7, 30)).collect()}
    once = {(r["date"], r["carbs"]) for r in rows if r["date"] and r["source_file"]}
    first, last = min(d for d, _ in once).date(), max(d for d, _ in once).date()
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    assert len(got) == 2 * len(days) + 2
    for day in days:
        for p in (7, 30):
            inside = [c for d, c in once if 0 <= (day - d.date()).days < p and c >= 0]
            assert got["s", day, p].carbs_total == sum(inside)
            assert got["s", day, p].carbs_avg == pytest.approx(sum(inside) / p)
            assert got["s", day, p].n_positive == sum(c > 0 for c in inside)
    assert got[None, T0.date(), 7].n_positive == 0
    assert idle_periods(trailing_totals(readings(spark, []), ["carbs"])).count() == 0


def test_grid_marks_and_fills(spark):
    values = [100.0 + i for i in range(700)]
    rows = [r for i, r in enumerate(series(values)) if i not in (5, 6, 300, *range(400, 690))]
    rows += [rows[3], {"source_file": "s", "id": "a", "date": None, "cgm": 5.0}, {"source_file": "s", "id": "gone", "date": T0, "cgm": math.nan}, {"source_file": None, "id": None, "date": T0, "cgm": 7.0}]
    df = readings(spark, rows)
    grid = {r.slot: r for r in regular_grid(df).filter("id = 'A'").collect()}
    s0 = min(grid)
    assert len(grid) == 700 and {k - s0 for k, r in grid.items() if r.missing} == {5, 6, 300, *range(400, 690)}
    assert grid[s0 + 300].value == pytest.approx(400.0, abs=1.0) and grid[s0 + 5].value == pytest.approx(105.0, abs=1.0)
    assert grid[s0 + 500].sd > grid[s0 + 300].sd > 0
    runs = sorted((r.first_slot - s0, r.last_slot - s0) for r in missing_runs(smoothed_blocks(df)).filter("id = 'A'").collect())
    assert runs == [(5, 6), (300, 300), (400, 689)]
    assert regular_grid(df).filter("id is null").count() == 1 and regular_grid(readings(spark, [])).count() == 0


def test_fills_beside_withheld_readings(spark):
    """A tenth of the readings withheld: the smoother beats the straight line, and its deviation tells the error's size."""
    rng = np.random.default_rng(11)
    trend, x = 0.0, [150.0]
    for _ in range(2999):
        trend = 0.92 * trend + rng.normal(0, 0.8)
        x.append(x[-1] + trend - 0.01 * (x[-1] - 150))
    x = np.array(x) + rng.normal(0, 1.0, 3000)
    hidden = np.zeros(3000, bool)
    for at in rng.choice(np.arange(20, 2960), 100, replace=False):
        hidden[at : at + int(rng.integers(1, 6))] = True
    grid = {r.slot: r for r in regular_grid(readings(spark, series([None if h else v for h, v in zip(hidden, x, strict=True)]))).collect()}
    first, at = min(grid), np.flatnonzero(hidden)
    filled, sd = (np.array([grid[first + int(k)][c] for k in at]) for c in ("value", "sd"))
    line = np.interp(at, np.flatnonzero(~hidden), x[~hidden])
    rmse = lambda p: float(np.sqrt(np.mean((p - x[at]) ** 2)))
    assert all(grid[first + int(k)].missing for k in at)
    assert rmse(filled) < rmse(line)
    assert 0.85 < np.mean(np.abs(filled - x[at]) < 2 * np.sqrt(sd**2 + 1.0)) <= 1.0


def test_blocks_agree_with_the_whole_record():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=600)) + 100
    x[rng.random(600) < 0.3] = np.nan
    none, zero, one = np.array([np.nan]), np.zeros((600, 1)), np.ones(1)
    whole, _ = smooth(x[:, None], zero, one, np.array([100.0]), none, one, none, one)
    part, _ = smooth(x[128:560, None], zero[:432], one, np.array([100.0]), none, one, none, one)
    assert np.nanmax(np.abs(whole[200:488, 0] - part[72:360, 0])) < 1e-2


def test_implausible_values(spark):
    rng = np.random.default_rng(1)
    x = np.round(150 + 30 * np.sin(np.arange(3000) / 40) + rng.normal(0, 1.5, 3000))
    x[500:502], x[900], x[1200:1230], x[1023:1025], x[2500:2530] = x[500] + 90, 999, 133, x[1023] - 80, 400
    rows = series(list(x))
    rows += [{**rows[500], "cgm": float(x[500] + 1)}, {**rows[7], "cgm": math.inf}, {**rows[9], "date": None, "cgm": -5.0}]
    rows += [{"source_file": "s", "id": "tiny", "date": T0, "cgm": v} for v in (8.0, 800.0)]
    got = {r.row_pos: r.reason for r in implausible(readings(spark, rows)).filter("field = 'cgm'").collect()}
    flagged = {k: v for k, v in got.items() if k < 3000}
    assert {k for k, v in flagged.items() if v == "spike"} == {500, 501, 1023, 1024} and flagged[900] == "impossible"
    assert set(range(1200, 1230)) == {k for k, v in flagged.items() if v == "stuck"}
    assert got[3000] == "spike" and 3001 not in got and 3002 not in got
    assert implausible(readings(spark, [])).count() == 0


def test_stuck_runs_of_a_logger_that_repeats_each_value(spark):
    rng = np.random.default_rng(4)
    own = np.round(150 + 40 * np.sin(np.arange(400) / 15) + rng.normal(0, 2, 400), 1) + np.arange(400) % 2 * 0.05  # no two neighbours are the same
    for n in (300, 1200):  # the record's length plays no part
        x = np.repeat(own, 3)[:n].copy()
        x[90:96], x[245:280] = x[90], 133.33  # over the end of a chunk of 256
        got = {r.row_pos: r.reason for r in implausible(readings(spark, series(list(x))), chunk=256, margin=64).collect()}
        assert {k for k, v in got.items() if v == "stuck"} == set(range(245, 280))
    assert _hanging(np.array([1.0, 2, 2]), 3, (1.0, 2), (2.0, 1)).tolist() == [True, True, True] and not _hanging(np.array([1.0, 2]), 3, (3.0, 9), (np.nan, 0)).any()


def test_stuck_runs_over_chunk_ends(spark):
    """Runs across every end of chunks of 256 readings, one over three chunks, of a sensor that often repeats itself."""
    rng = np.random.default_rng(5)
    x = np.round(150 + 40 * np.sin(np.arange(4000) / 60) + rng.normal(0, 1.0, 4000))
    want = set()
    for i, end in enumerate(range(256, 3800, 512)):
        at = range(end - 100 - i, end + 100 + i) if i != 3 else range(end - 300, end + 300)
        x[list(at)] = 200.5 + i
        want |= set(at)
    for chunk in (256, 4096):
        got = {r.row_pos for r in implausible(readings(spark, series(list(x))), chunk=chunk).filter("reason = 'stuck'").collect()}
        assert got == want


def test_doses_out_of_scale(spark):
    rng = np.random.default_rng(6)
    u = np.round(rng.uniform(3, 5, 300), 2)
    u[149:152] = 3.0, 18.5, 3.0  # below five median doses, above six times its neighbours
    rows = [{**r, "insulin": float(v), "basal": 0.6, "cgm": None} for r, v in zip(series(list(u), step=180), u, strict=True)]
    assert {(r.row_pos, r.reason) for r in implausible(readings(spark, rows)).collect()} == {(150, "spike")}


def test_implausible_doses(spark):
    rng = np.random.default_rng(2)
    u = np.where(rng.random(800) < 0.1, np.round(rng.uniform(2, 9, 800), 2), 0.05)
    u[100], u[200:208], u[300] = 300.0, 6.5, -1.0
    rows = [{**r, "insulin": float(v), "basal": 0.6, "cgm": None} for r, v in zip(series(list(u)), u, strict=True)]
    got = {(r.row_pos, r.reason) for r in implausible(readings(spark, rows)).collect()}
    assert got == {(100, "impossible"), *((k, "stuck") for k in range(200, 208))}


def test_runs_and_excursions():
    assert _hanging(np.array([1.0, 1, 1, 2, 3, 3]), 3).tolist() == [True, True, True, False, False, False]
    assert _hanging(np.array([]), 3).tolist() == []
    x, sec = np.array([100.0, 101, 180, 181, 102, 103]), np.arange(6) * 300.0
    assert _spikes(x, sec, 300.0, 1.0, 28.0, LIMITS).tolist() == [False, False, True, True, False, False]
    lasting = np.array([100.0, 101, 180, 181, 182, 183, 184, 185])
    assert not _spikes(lasting, np.arange(8) * 300.0, 300.0, 1.0, 28.0, LIMITS).any()


def test_filling_with_provenance(spark):
    rows = [{"source_file": "s", "id": "a", "date": T0 + dt.timedelta(minutes=i), "basal": b, "bolus": 0.0, "insulin": b / 12, "carbs": 0.0} for i, b in enumerate([0.6, 1.2] * 20)]
    rows += [{**rows[0], "insulin": None}, {**rows[1], "insulin": math.nan}, {**rows[0], "insulin": -99.0, "date": None}, {**rows[0], "basal": 7.0, "insulin": math.inf, "carbs": -1.0}]
    got = {(r.row_pos, r.field): r for r in fill_from_similar(readings(spark, rows)).collect()}
    assert len(got) == 2 * len(rows)
    assert got[40, "insulin"].value == pytest.approx(0.05) and got[40, "insulin"].provenance == "dependency: participant,basal,bolus"
    assert got[41, "insulin"].value == pytest.approx(0.1) and got[42, "insulin"].value == pytest.approx(0.05)
    assert got[43, "insulin"].provenance.startswith("median") and got[43, "carbs"].value == 0.0 and got[43, "carbs"].filled
    assert not got[0, "insulin"].filled and got[0, "insulin"].provenance == "recorded"
    bare = fill_from_similar(readings(spark, [{"source_file": None, "id": None}])).collect()
    assert {(r.provenance, r.value) for r in bare} == {("none", None)}
    assert fill_from_similar(readings(spark, [])).count() == 0
