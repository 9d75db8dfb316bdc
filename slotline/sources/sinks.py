"""Writing: schema-cast predictions, split shards, appended results, metadata, guards against overwriting."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotline.operators.lookups import duplicate_keys


def write_predictions(df: DataFrame, path: str, schema: StructType, pos: str) -> None:
    """In the template's own schema, sorted by position in ranges; refuses to overwrite."""
    df.repartitionByRange(F.col(pos)).sortWithinPartitions(pos).select(*schema.names).to(schema).write.mode("errorifexists").parquet(path)


def write_shards(df: DataFrame, path: str, split: str = "split", shard_size: int = 100_000) -> None:
    """One folder per split, at most ``shard_size`` records a file."""
    df.write.mode("errorifexists").partitionBy(split).option("maxRecordsPerFile", shard_size).parquet(path)


def append_results(df: DataFrame, path: str, by: Sequence[str] = ("date", "experiment")) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_metadata(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


class ShardConflict(ValueError):
    """Raised where shards overlap, mix configurations or leave rows uncovered."""


def assemble(spark: SparkSession, glob: str, template: DataFrame, keys: Sequence[str], values: Sequence[str], config: str = r"([^/]+)_h\d+_[^/]*$") -> DataFrame:
    """The template's rows with the predictions of shards written one by one.

    All shards must be of one configuration (the first group of ``config`` in their folder names),
    no key may be in two of them, and every row of the template must be covered.
    """
    shards = spark.read.parquet(glob).withColumn("_file", F.input_file_name())
    shards = shards.withColumn("_config", F.regexp_extract(F.regexp_replace("_file", "/[^/]*$", ""), config, 1))
    configs = shards.select("_config").distinct().limit(10).collect()
    if len(configs) > 1:
        raise ShardConflict(f"more than one configuration: {sorted(c[0] for c in configs)}")
    twice = duplicate_keys(shards, keys).limit(5).collect()
    if twice:
        raise ShardConflict(f"shards overlap: {twice}")
    out = template.drop(*values).join(shards.select(*keys, *values), list(keys), "left")
    bare = out.filter(F.coalesce(*(F.col(v) for v in values)).isNull()).count()
    if bare:
        raise ShardConflict(f"{bare} rows are not covered")
    return out.select(*template.columns)


def cached(spark: SparkSession, root: str, arguments: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, kept under a name made of the arguments: a later call with the same ones reads it back.

    A folder without the mark of a finished write is written anew.
    """
    name = hashlib.sha256(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{root}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def provenance(spark: SparkSession, glob: str, values: Sequence[str]) -> DataFrame:
    """Per file of a result: its rows, and how many of them have each value."""
    rows = spark.read.parquet(glob).withColumn("_file", F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1))
    return rows.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n"), *(F.count(v).alias(f"n_{v}") for v in values))


def shuffled_shards(spark: SparkSession, glob: str, identity: Sequence[str], seed: int, epoch: int) -> DataFrame:
    """The records of shards, each once, in an order that depends on seed and epoch only."""
    from slotline.operators.sampling import shuffled

    return shuffled(spark.read.parquet(glob), identity, seed, epoch)
