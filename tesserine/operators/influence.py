"""Moran's I after units are left out: lists of neighbours are repaired only where a unit was in them.

A scenario is a set of units that go. Sums over neighbour lists are kept per unit, so a scenario subtracts the lists of units that go or that
have lost a neighbour and adds the repaired ones, in which the next neighbours move up. Leaving out each of n units once takes about
k rows per unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.spatial import nearest
from tesserine.session import cut_lineage

#: Neighbours beyond the k wanted that are found at once, to move up where others go.
SPARE = 4


def _lists(lists: DataFrame, v: DataFrame) -> DataFrame:
    """(.., i, j) with the values of both ends."""
    return lists.join(v.select(F.col("_u").alias("i"), F.col("z").alias("_zi")), "i").join(v.select(F.col("_u").alias("j"), F.col("z").alias("_zj")), "j")


def _sums() -> list[Column]:
    return [F.sum(F.col("_zi") * F.col("_zj")).alias("_x"), F.sum(F.col("_zi") + F.col("_zj")).alias("_y"), F.count("*").alias("_e")]


def moran_without(points: DataFrame, key: str, value: str, drops: DataFrame, k: int = 8) -> DataFrame:
    """(scenario, n, moran, reason) for every scenario of `drops` (scenario, `key`); neighbours are the k nearest of those left.

    The mean is that of the units left, as in a fresh computation; a scenario of fewer than three units or equal values has a reason
    instead of a statistic. Drops that name no unit count for nothing.
    """
    points = cut_lineage(points.select(F.col(key).alias("_u"), "lat", "lon", F.col(value).cast("double").alias("_v")))
    total = points.agg(F.count("*").alias("n"), F.avg("_v").alias("m")).first()
    n, usual = total["n"], min(k, max(total["n"] - 1, 0))
    v = cut_lineage(points.select("_u", (F.col("_v") - F.lit(total["m"])).alias("z")))
    drops = cut_lineage(drops.select("scenario", F.col(key).alias("_u")).distinct().join(v, "_u"))
    left = drops.groupBy("scenario").agg(F.count("*").alias("_d"), F.sum("z").alias("_dz"), F.sum(F.col("z") * F.col("z")).alias("_dq")).withColumn("n", n - F.col("_d"))
    left = cut_lineage(left.withColumn("_need", F.least(F.lit(k), F.col("n") - 1)))
    names = {"_u": "i", "neighbour": "j"}
    lists = cut_lineage(nearest(points, points, min(usual + SPARE, max(n - 1, 1)), "_u", "_u").select(*[F.col(a).alias(b) for a, b in names.items()], "rank"))
    base = cut_lineage(_lists(lists.where(F.col("rank") <= usual), v).groupBy("i").agg(*_sums()))
    gone = drops.select("scenario", F.col("_u").alias("j"))
    hurt = lists.where(F.col("rank") <= usual).join(gone, "j").select("scenario", "i").distinct()
    hurt = cut_lineage(hurt.join(drops.select("scenario", F.col("_u").alias("i")), ["scenario", "i"], "left_anti").join(left.select("scenario", "_need"), "scenario"))
    # repaired lists; those still too short ask for more neighbours
    repaired, open_lists, depth = None, hurt, usual + SPARE
    while True:
        found = open_lists.join(lists, "i").join(gone, ["scenario", "j"], "left_anti")
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("scenario", "i").orderBy("rank"))).where(F.col("_r") <= F.col("_need"))
        full = cut_lineage(found.withColumn("_have", F.count("*").over(Window.partitionBy("scenario", "i"))))
        done = full.where((F.col("_have") == F.col("_need")) | F.lit(depth >= n - 1)).select("scenario", "i", "j")
        repaired = done if repaired is None else repaired.unionByName(done)
        if depth >= n - 1:
            break
        open_lists = cut_lineage(open_lists.join(done.select("scenario", "i").distinct(), ["scenario", "i"], "left_anti"))
        if open_lists.isEmpty():
            break
        depth = min(2 * depth, n - 1)
        some = points.join(open_lists.select(F.col("i").alias("_u")).distinct(), "_u")
        lists = cut_lineage(nearest(some.withColumnRenamed("_u", "_q"), points, depth + 1, "_q", "_u", None).where("_q <> _u").select(F.col("_q").alias("i"), F.col("_u").alias("j"), "rank"))
    fresh = _lists(repaired, v).groupBy("scenario").agg(*_sums())
    lost = drops.select("scenario", F.col("_u").alias("i")).unionByName(hurt.select("scenario", "i")).join(base, "i")
    lost = lost.groupBy("scenario").agg(*[F.sum(c).alias(f"{c}_lost") for c in ("_x", "_y", "_e")])
    whole = base.agg(*[F.sum(c).alias(c) for c in ("_x", "_y", "_e")]).first()
    square = v.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    at = left.join(fresh, "scenario", "left").join(lost, "scenario", "left")
    x, y, e = (F.lit(whole[c]) - F.coalesce(f"{c}_lost", F.lit(0)) + F.coalesce(c, F.lit(0)) for c in ("_x", "_y", "_e"))
    mu = -F.col("_dz") / F.col("n")
    spread = F.lit(square) - F.col("_dq") - F.col("n") * mu * mu
    flat = spread <= 1e-12 * F.lit(square)
    reason = F.when(F.col("n") < 3, "insufficient_samples").when(flat, "constant_residuals")
    moran = (x - mu * y + mu * mu * e) / F.col("_need") / spread
    return at.select("scenario", "n", F.when(reason.isNull(), moran).alias("moran"), reason.alias("reason"))


def largest_first(points: DataFrame, key: str, value: str, sizes: list[int]) -> DataFrame:
    """Scenarios `drop_top_<size>`: the units farthest from the mean, ties by key."""
    mean = points.agg(F.avg(value)).scalar()
    most = points.select(key, F.abs(F.col(value) - mean).alias("_a")).orderBy(F.desc("_a"), key).limit(max(sizes)).withColumn(
        "_r", F.row_number().over(Window.orderBy(F.desc("_a"), key)))  # at most the largest size
    each = most.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("_r <= _s")
    return each.select(F.concat(F.lit("drop_top_"), "_s").alias("scenario"), key)


def label_clusters(labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Scenarios without the units of local clusters: high, low, and both."""
    name = F.explode(F.array(F.concat(F.lit("drop_cluster_"), F.col(label)), F.lit("drop_both_clusters")))
    return labels.where(F.col(label).isin("HH", "LL")).select(name.alias("scenario"), key)


def leave_each_out(points: DataFrame, key: str) -> DataFrame:
    return points.select(F.col(key).alias("scenario"), key)
