"""Reading tables: projection at the scan, required-column guard, missing values made NULL once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """Raised before any job runs when a table lacks required columns."""


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns: {', '.join(lacking)}; present: {', '.join(df.columns)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``name`` of a data folder; with ``columns``, only those reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return require_columns(df, columns).select(*columns) if columns else df


def finite(c: Column | str) -> Column:
    """The number, or NULL where it is NULL, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def normalise_missing(df: DataFrame, columns: Sequence[str] | None = None, sentinels: Sequence[float] = ()) -> DataFrame:
    """NaN, infinities and the given stand-in codes become NULL in the float columns (all, or those named)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    wanted = [c for c in (columns or floats) if c in floats]
    clean = {c: finite(F.col(f"`{c}`")) for c in wanted}
    if sentinels:
        clean = {c: F.when(~x.isin(*sentinels), x) for c, x in clean.items()}
    return df.withColumns(clean) if clean else df


def to_double(c: str) -> Column:
    """Coerce to a finite double; what is no number becomes NULL."""
    return finite(F.col(c).try_cast("double"))


def epoch_seconds(c: Column | str) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 of a zoneless timestamp, whatever the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def from_epoch_seconds(c: Column) -> Column:
    """The zoneless timestamp of whole seconds since 1970-01-01 00:00:00."""
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))).cast("timestamp_ntz")


def read_blocks(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A scan that keeps the place of every row: ``_file``, ``_pos`` within the file."""
    return spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))


def columns_like(df: DataFrame, hints: Sequence[str]) -> list[str]:
    """Names of the schema that hold one of the hints, in schema order and without regard to case."""
    return [c for c in df.schema.names if any(h.lower() in c.lower() for h in hints)]


def require_path(spark: SparkSession, path: str) -> str:
    """The path, if something is there; else an error before any scan is planned."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV side input with a header, in the given schema."""
    return spark.read.schema(schema).option("header", True).csv(require_path(spark, path))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON side input, one document or a list of them a file, in the given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(require_path(spark, path))
