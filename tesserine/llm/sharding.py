"""Proportional stratified interleaving: every shard holds the mixture of the whole table.

Rows are shuffled by a seeded digest inside their stratum and ranked; rank r of n becomes the fraction (r + 0.5) / n. Sorted by
that fraction, every stretch of the order holds each stratum in its share, so equal cuts of the order are the shards: row counts
differ by at most one, and a stratum's rows differ from its share by about one row a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import query, ranked_in_buckets, row_buckets, saved, table

#: Digits of the digest that order rows: 15 hexadecimal digits are a positive long.
DIGITS, SPAN = 15, 16 ** 15


def interleave(docs: DataFrame, shards: int, seed: str = "mixture-1", id_col: str = "doc_id", text_col: str = "text",
               stratum_col: str = "source") -> DataFrame:
    """One row per input row: id, stratum, size, text_crc32, fraction, position, shard, slot.

    Only digests and sizes move, never texts. Null text counts as none (size 1, crc 0); null id and null stratum are values like
    others; rows equal in id and text are interchangeable and get slots of their own; an empty table gives no rows. Columns
    other than the three named ones are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("-")), "size", "text_crc32"))
    slim = saved(slim.withColumn("h", F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")), "shards")
    rows = slim.count()
    buckets = row_buckets(rows)
    ties = [F.col("h"), F.col("id"), F.col("size"), F.col("text_crc32")]
    bucket = F.floor(F.col("h") / F.lit(float(SPAN)) * buckets).cast("int")
    ranked = ranked_in_buckets(slim, bucket, buckets, ties, "rank", by="stratum")
    sizes = slim.groupBy(F.col("stratum").alias("s")).agg(F.count("*").alias("n"))
    placed = saved(ranked.join(sizes, F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s").withColumn(
        "fraction", (F.col("rank") + 0.5) / F.col("n")), "ranks")
    spread = ranked_in_buckets(placed, F.floor(F.col("fraction") * buckets).cast("int"), buckets, [F.col("fraction"), F.col("stratum"), *ties],
                               "position")
    shard = F.floor(F.col("position") * shards / F.lit(max(rows, 1)))
    first = F.ceil(F.col("shard") * F.lit(max(rows, 1)) / shards)
    return spread.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("position") - first).cast("long")).select(
        "id", "stratum", "size", "text_crc32", "fraction", "position", "shard", "slot")


@query("op9_interleaved_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleave(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"))
