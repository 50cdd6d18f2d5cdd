"""Helpers of the training-data operators: tables, written intermediates, ranks without a global window."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.session import ensure_checkpoint_dir

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}

#: Words are runs of anything but these six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query of this subpackage and, where SQL can state it, its SQL."""

    def register(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, after setting how many rows travel to Python at a time in its session: rows here hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read back: later jobs and retried tasks read the same rows."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_buckets(rows: int, per_bucket: int = 65_536, least: int = 64) -> int:
    """How many even buckets hold `rows` rows."""
    return max(least, -(-rows // per_bucket))


def ranked_in_buckets(df: DataFrame, bucket: Column, buckets: int, order: list[Column], out: str, by: str | None = None) -> DataFrame:
    """Rank from 0 over all rows, or over the rows of each `by`, ordered by (bucket, order).

    Buckets are ranges of the order, about equal in size. Rows are numbered inside a bucket; what lies before a bucket comes
    from a table of counts. So no task holds more than its buckets, whatever share of the rows one `by` owns.
    """
    names = ["__b"] + ([by] if by else [])
    parts = df.withColumn("__b", bucket).repartition(buckets, "__b")
    local = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    counts = parts.groupBy(*names).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.col(by) if by else F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__b").alias("__ob"), *([F.col(by).alias("__oby")] if by else []),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col("__b") == F.col("__ob")
    if by:
        on &= F.col(by).eqNullSafe(F.col("__oby"))
    ranked = parts.withColumn("__r", local).join(offsets, on, "left")
    drop = ["__b", "__ob", "__r", "__before"] + (["__oby"] if by else [])
    return ranked.withColumn(out, F.col("__before") + F.col("__r") - 1).drop(*drop)


#: Rows of one or two numbers that may be sent to every executor; longer tables are joined by a shuffle.
SENT_ROWS = 1_000_000


def sent(keys: DataFrame) -> DataFrame:
    """`keys` (a written table of one or two numeric columns) marked for broadcast if its counted rows stay within `SENT_ROWS`."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys.hint("shuffle_hash")


def halves(md5: Column) -> list[Column]:
    """A digest as two longs, to be sent or joined at sixteen bytes."""
    return [F.conv(F.substring(md5, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "__k1"), (16, "__k2"))]


def with_texts(docs: DataFrame, md5: Column, texts: DataFrame, how: str) -> DataFrame:
    """`docs` whose text digest is (left_semi) or is not (left_anti) among the digests `texts` (column text_md5).

    The digests go to the rows while their counted number allows it; whole texts move only beyond that.
    """
    keys = saved(texts.select(*halves(F.col("text_md5"))).distinct(), "digests")
    a, b = halves(md5)
    return docs.join(sent(keys), (a == F.col("__k1")) & (b == F.col("__k2")), how)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the label is the least node that can be reached.

    Rounds of taking the least neighbouring label and the label of one's label, so the number of rounds follows the logarithm of
    the longest chain. Each round is written, so a lost executor costs one round.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = saved(near.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return labels
