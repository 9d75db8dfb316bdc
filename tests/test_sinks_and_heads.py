"""Round trips of the sinks, guards of the assembly, heads on a known function."""

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from slotline.operators.heads import BoostedHead, RidgeHead, horizon_columns, normalised, sweep
from slotline.sources import sinks
from slotline.sources.tables import columns_like, read_blocks


def predictions(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, id string, pred double")


def test_predictions_keep_schema_and_refuse_to_overwrite(spark, tmp_path):
    df = predictions(spark, [(2, "b", 2.0), (1, "a", 1.0)])
    path = str(tmp_path / "p")
    sinks.write_predictions(df.select("pred", "pos", "id"), path, df.schema, "pos")
    assert spark.read.parquet(path).schema == df.schema and sinks.exists(spark, path)
    with pytest.raises(AnalysisException):
        sinks.write_predictions(df, path, df.schema, "pos")
    back = read_blocks(spark, [path], ["pos"])
    assert {"_file", "_pos"} <= set(back.columns) and back.count() == 2


def test_shards_results_metadata(spark, tmp_path):
    df = spark.createDataFrame([(i, "val" if i % 4 else "train") for i in range(40)], "i int, split string").coalesce(1)
    sinks.write_shards(df, str(tmp_path / "s"), shard_size=7)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().count() == 2 and len(list((tmp_path / "s" / "split=val").glob("*.parquet"))) == 5
    one = spark.createDataFrame([("2024-01-01", "x", 1.0)], "date string, experiment string, rmse double")
    sinks.append_results(one, str(tmp_path / "r"))
    sinks.append_results(one, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    sinks.write_metadata(spark, {"b": 1, "a": [2]}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"a": [2], "b": 1}
    assert columns_like(df, ["SPL"]) == ["split"]


def test_assembly(spark, tmp_path):
    template = predictions(spark, [(1, "a", None), (2, "b", None)])
    write = lambda name, rows: predictions(spark, rows).select("id", "pred").write.parquet(str(tmp_path / name))
    write("base_h60_x", [(1, "a", 1.0)])
    glob = str(tmp_path / "*_h60_*")
    with pytest.raises(sinks.ShardConflict, match="not covered"):
        sinks.assemble(spark, glob, template, ["id"], ["pred"])
    write("base_h60_y", [(2, "b", 2.0)])
    out = sinks.assemble(spark, glob, template, ["id"], ["pred"])
    assert out.columns == template.columns and {(r.pos, r.pred) for r in out.collect()} == {(1, 1.0), (2, 2.0)}
    write("other_h60_z", [(3, "c", 3.0)])
    with pytest.raises(sinks.ShardConflict, match="configuration"):
        sinks.assemble(spark, glob, template, ["id"], ["pred"])
    (tmp_path / "other_h60_z").rename(tmp_path / "away")
    write("base_h60_w", [(2, "b", 9.0)])
    with pytest.raises(sinks.ShardConflict, match="overlap"):
        sinks.assemble(spark, glob, template, ["id"], ["pred"])


def test_heads(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (500, 2))
    rows = [(float(a), float(b), 150 + 50 * float(np.sign(a)) + float(b)) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = {(r.variant, r.head): r.rmse for r in sweep(df, df, {"both": ["a", "b"], "b": ["b"]}, {"ridge": RidgeHead(), "trees": BoostedHead(5, 3)}, "y", 30).collect()}
    assert len(got) == 4 and 2 * got["both", "trees"] < got["both", "ridge"] < got["b", "ridge"]
    z = normalised(df, ["a"]).toPandas().a
    assert abs(z.mean()) < 1e-9 and abs(z.std(ddof=0) - 1) < 1e-9
    assert horizon_columns(["c_past_0_30", "c_next_0_30", "c_next_30_60"], 30) == ["c_past_0_30", "c_next_0_30"]
