"""Session settings and the folder that checkpoints go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("slotline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests, a single machine) is a temporary folder of this machine taken. Executors of a
    cluster can't share such a folder, so there the setting is required.
    """
    now = spark.sparkContext.getCheckpointDir()
    if now:
        return now
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        to = tempfile.mkdtemp(prefix="slotline-checkpoint-")
    spark.sparkContext.setCheckpointDir(to)
    return to


def written(df: DataFrame) -> DataFrame:
    """The table, written once to the shared checkpoint folder (as compressed columns) and read from there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/slotline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
