"""Checks that raise, side inputs, caches, provenance, wrapped hooks, medians and places on small cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotline.operators import guards as V
from slotline.operators import lookups as J
from slotline.operators.hooks import SlotSums, WithCodes, batched_inference
from slotline.operators.quantiles import exact_median
from slotline.operators.sampling import evenly_spaced, hash_place, shuffled, spread_blocks
from slotline.sources import sinks
from slotline.sources.tables import read_csv, read_json, require_path


def test_checks_raise(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", math.nan, "y"), (None, 2.0, "y")], "k string, v double, source_file string")
    assert V.complete(df.filter("not isnan(v)"), ["v"], 2).count() == 2
    for bad in (lambda: V.complete(df, ["v"]), lambda: V.complete(df.filter("k = 'a'"), ["v"], 7), lambda: V.found_all(df.select("k"), df.filter("k = 'a'"), ["k"], "v", "v"), lambda: V.only_sources(df, ["x", "no"]), lambda: V.in_range("cap", 0, 1), lambda: V.in_range("share", math.nan)):
        with pytest.raises(V.GuardError):
            bad()
    assert V.found_all(df.filter("k is null").select("k"), df, ["k"], "v", "v").first().v == 2.0
    assert V.only_sources(df, ["x"]).count() == 1 and V.in_range("cap", 3, 1, 5) == 3
    assert V.parity(df.filter("k = 'a'"), df.filter("k = 'a'").withColumn("v", F.col("v") + 1e-5), ["k"], "v") < 2e-4
    for other in (df.filter("k = 'a'").withColumn("v", F.lit(1.1)), df.filter("k = 'b'").withColumn("v", F.lit(1.0))):
        with pytest.raises(V.GuardError):
            V.parity(df.filter("k = 'a'"), other, ["k"], "v")


def test_report_errors(spark):
    template = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "pos bigint, id string")
    made = spark.createDataFrame([(0, "p0", 1.0, 1.0), (1, "other", None, 1.0), (9, "p9", None, 1.0)], "pos bigint, id string, half double, full double")
    report = J.format_report(made, template, "pos", ["id"], ["half", "full"])
    assert V.report_errors(report, ["full", "gone"]) == ["n_unmatched: 3", "id_mismatches: 1", "gone is absent", "half is partial"]
    assert "nothing is populated" in V.report_errors(J.format_report(made.withColumn("full", F.lit(None).cast("double")), template, "pos", ["id"], ["full"]), [])


def test_side_inputs_caches_and_provenance(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\n")
    (tmp_path / "a.json").write_text(json.dumps([{"k": "x", "v": 2}]))
    assert read_csv(spark, str(tmp_path / "a.csv"), "k string, v int").first().v == 1 and read_json(spark, str(tmp_path / "a.json"), "k string, v int").first().v == 2
    with pytest.raises(FileNotFoundError):
        require_path(spark, str(tmp_path / "none"))
    made = []

    def make(n):
        made.append(n)
        return spark.range(n).withColumn("v", F.when(F.col("id") > 0, 1.0))

    for n in (3, 3, 4):
        assert sinks.cached(spark, str(tmp_path / "cache"), {"n": n}, lambda n=n: make(n)).count() == n
    assert made == [3, 4]
    found = sinks.provenance(spark, str(tmp_path / "cache" / "*"), ["v"]).agg(F.sum("n"), F.sum("n_v")).first()
    assert tuple(found) == (7, 5)
    orders = [[r.id for r in sinks.shuffled_shards(spark, str(tmp_path / "cache" / "*"), ["id"], 1, e).collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] and sorted(orders[0]) == sorted(orders[2]) == [0, 0, 1, 1, 2, 2, 3]
    sinks.write_csv(spark.createDataFrame([("x", 1)], "k string, v int"), str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out"), "k string, v int").count() == 1


def test_scattered_and_wanted(spark):
    template = spark.createDataFrame([(i, None if i == 2 else f"k{i}") for i in range(4)], "pos bigint, k string")
    values = spark.createDataFrame([(1, 0.5), (3, 0.7)], "pos bigint, pred double")
    assert {r.pos: r.pred for r in J.scattered(template, values, "pos").collect()} == {0: None, 1: 0.5, 2: None, 3: 0.7}
    with pytest.raises(J.NotUnique):
        J.scattered(template, values.union(values), "pos")
    wanted = spark.createDataFrame([("k1",), ("k1",), (None,)], "k string")
    assert sorted(r.pos for r in J.wanted_rows(template, wanted, ["k"]).collect()) == [1, 2]


def test_hooks_and_inference(spark):
    df = spark.createDataFrame([("s", "a", k, float(k)) for k in range(4)], "source_file string, id string, slot bigint, bolus double")
    h = WithCodes(SlotSums(["bolus"], 2), ["source_file", "id"])
    out = h.apply(df)
    assert set(h.columns) <= set(out.columns) and out.select("code").distinct().count() == 1
    loads = batched_inference(df.select("bolus"), lambda: lambda f: f * 2, "bolus double")
    assert sorted(r.bolus for r in loads.collect()) == [0.0, 2.0, 4.0, 6.0]


def test_medians_and_places(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 30, 501)] + [("b", 1.0), ("b", 4.0), (None, 2.5), ("none", None), ("none", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.median, r.n) for r in exact_median(df, ["k"], "v", width=7).collect()}
    assert got == {"hot": (float(np.median([v for k, v in rows if k == "hot"])), 501), "b": (2.5, 2), None: (2.5, 1)}
    assert exact_median(df.limit(0), ["k"], "v").count() == 0
    ids = spark.range(1000).withColumn("k", F.lit("x"))
    assert sorted(r._place for r in hash_place(ids, ["k"], ["id"], 1).collect()) == list(range(1000))
    assert sorted(r.id for r in evenly_spaced(ids, ["k"], "id", 5, F.floor(F.col("id") / 10)).collect()) == [0, 250, 500, 749, 999]
    assert {r.id // 100 for r in spread_blocks(ids, "id", 100, 3).collect()} == {0, 4, 9} and shuffled(ids, ["id"], 1, 2).count() == 1000
