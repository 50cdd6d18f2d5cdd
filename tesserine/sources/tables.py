"""Declared-schema readers and typed, deterministic writers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions.columns import nan_to_null, parse_coordinate, significant
from tesserine.session import ensure_checkpoint_dir
from tesserine.sources import files as FI

#: Declared layout of the raw monthly location series.
LOCATION_CSV = T.StructType([
    T.StructField("dt", T.DateType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("uncertainty", T.DoubleType()),
    T.StructField("place", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited scan with a declared schema (no inference pass); malformed rows stop the query."""
    return (
        spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST")
        .option("recursiveFileLookup", "true").csv(path)
    )


def read_titled_csv(spark: SparkSession, path: str, schema: T.StructType, title_prefix: str) -> DataFrame:
    """CSV whose files start with a title line and a header line."""
    header = ",".join(schema.names)
    lines = spark.read.text(path).where(
        ~F.col("value").startswith(title_prefix) & (F.trim("value") != header) & (F.trim("value") != "")
    )
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = lines.select(F.from_csv("value", text.simpleString()[len("struct<"):-1].replace(":", " ")).alias("r"))
    return parsed.select(*[F.trim(F.col(f"r.{f.name}")).try_cast(f.dataType).alias(f.name) for f in schema])


def read_whitespace_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns separated by runs of blanks, first line of names; markers such as *** become NULL."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.trim("value") != "") & (F.element_at(parts, 1) != schema.names[0]))
    return lines.select(
        *[F.try_element_at(parts, F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    )


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated numeric code -> three-letter code; rows with a blank code are skipped."""
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("iso3", T.StringType())])
    return read_csv(spark, path, schema, sep="\t").where(F.trim(F.coalesce("iso3", F.lit(""))) != "")


def ingest_locations(raw: DataFrame) -> DataFrame:
    """Typed location series: signed coordinates, NaN as NULL, every input row kept."""
    return raw.select(
        "dt", nan_to_null("value").alias("value"), nan_to_null("uncertainty").alias("uncertainty"), "place", "unit",
        parse_coordinate("latitude", 90.0).alias("latitude"), parse_coordinate("longitude", 180.0).alias("longitude"),
    )


def ingest_summary(table: DataFrame) -> DataFrame:
    """Row count, distinct (place, unit) pairs and date range."""
    return table.agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.struct("place", "unit")).alias("n_places"),
        F.date_format(F.min("dt"), "yyyy-MM-dd").alias("dt_min"), F.date_format(F.max("dt"), "yyyy-MM-dd").alias("dt_max"),
    )


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, in order, cast to the declared types."""
    missing = [n for n in schema.names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the frame: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_typed(df: DataFrame, path: str, schema: T.StructType, order_by: Sequence[str], codec: str = "zstd") -> None:
    """Range-sorted parquet: globally ordered across files without a single-task sort."""
    typed(df, schema).orderBy(*order_by).write.mode("overwrite").option("compression", codec).parquet(path)


def read_required(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Parquet scan that refuses a table lacking any required column."""
    df = spark.read.parquet(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"stale table at {path}: missing {missing}")
    return df.select(*required)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing is stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(target) else None


def json_document(df: DataFrame, digits: int = 10) -> Column:
    """All columns as one JSON document with floats at `digits` significant figures."""
    return F.to_json(F.struct(*[
        significant(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema
    ]))


def round_floats(obj, digits: int = 10):
    """Significant-figure rounding of a small summary document."""
    if isinstance(obj, float):
        return float(f"{obj:.{digits}g}") if obj == obj and abs(obj) != float("inf") else obj
    if isinstance(obj, Mapping):
        return {k: round_floats(v, digits) for k, v in obj.items()}
    if isinstance(obj, (list, tuple)):
        return [round_floats(v, digits) for v in obj]
    return obj


def dump_summary(obj) -> str:
    return json.dumps(round_floats(obj), indent=2, sort_keys=True, allow_nan=False)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name below `path`, size and SHA-256 of every file; contents are streamed, never held whole."""
    return FI.digests(spark, path, glob).select(FI.relative(path).alias("file"), "bytes", "sha256")


def verify_checksum(spark: SparkSession, path: str, expected_sha256: str) -> None:
    """Refuse a source file whose content differs from the pinned one."""
    found = [r["sha256"] for r in file_manifest(spark, path).select("sha256").limit(2).collect()]
    if found != [expected_sha256]:
        raise ValueError(f"{path} does not match the pinned checksum")
