"""Ingestion in bounded slabs: new files are read a few at a time and only sums are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.sources.tables import LOCATION_CSV, ingest_locations


def ingest_slabs(spark: SparkSession, source: str, target: str, progress: str, files_per_slab: int = 100) -> None:
    """Read every CSV file under `source` not seen before and append its partial sums to `target`.

    `progress` is the stream's own record of finished slabs. A slab that is
    retried overwrites its own folder, so a lost executor or a restarted driver
    never counts a row twice.
    """
    stream = (
        spark.readStream.schema(LOCATION_CSV).option("header", "true").option("maxFilesPerTrigger", files_per_slab).csv(source)
    )

    def write(slab: DataFrame, number: int) -> None:
        sums = ingest_locations(slab).where("value is not null").groupBy(
            "unit", "place", "latitude", "longitude", F.month("dt").cast("bigint").alias("moy")
        ).agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        sums.write.mode("overwrite").parquet(f"{target}/slab={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def merged_climatology(spark: SparkSession, target: str) -> DataFrame:
    """Means per location and calendar month over all slabs."""
    return spark.read.parquet(target).groupBy("unit", "place", "latitude", "longitude", "moy").agg(
        (F.sum("total") / F.sum("n")).alias("climatology"), F.sum("n").alias("n"))
