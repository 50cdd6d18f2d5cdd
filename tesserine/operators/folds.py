"""Cross-validation folds: grouped random, k-means on the sphere, labels, buffered training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions.columns import unit_xyz
from tesserine.operators.ordering import row_ids
from tesserine.operators.spatial import near_coordinates
from tesserine.session import cut_lineage


def grouped_random(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Records at one coordinate share a fold; coordinates are dealt out in digest order."""
    coords = points.select("lat", "lon").distinct().withColumn(
        "_digest", F.md5(F.concat_ws("|", F.lit(seed), F.col("lat").cast("bigint"), F.col("lon").cast("bigint"), *_fraction())))
    dealt = row_ids(coords, ["_digest", "lat", "lon"], "_i").select("lat", "lon", (F.col("_i") % k).cast("bigint").alias("fold"))
    return points.join(dealt, ["lat", "lon"])


def _fraction() -> list:
    """Fractional parts enter the digest only where a coordinate has any."""
    return [F.when(F.col(c) != F.col(c).cast("bigint"), F.col(c).cast("string")) for c in ("lat", "lon")]


def from_labels(df: DataFrame, label: str) -> DataFrame:
    """Fold number = position of the label in sorted order."""
    levels = row_ids(df.select(label).distinct(), [label], "_f")
    return df.join(levels.select(label, F.col("_f").cast("bigint").alias("fold")), label)


def spherical_kmeans(points: DataFrame, k: int, seed: int = 0, restarts: int = 20) -> DataFrame:
    """Best of several seeded runs over distinct coordinates; labels follow mean longitude."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    coords = points.select("lat", "lon").distinct()
    x, y, z = unit_xyz("lat", "lon")
    vectors = cut_lineage(coords.select("lat", "lon", F.array(x, y, z).alias("_xyz"))).withColumn("features", array_to_vector("_xyz"))
    best = None
    for r in range(restarts):
        model = KMeans(k=k, seed=seed + r, maxIter=100, tol=1e-9).fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost - 1e-12:
            best = model
    labelled = best.transform(vectors).select("lat", "lon", F.col("prediction").alias("_c"))
    members = points.join(labelled, ["lat", "lon"])
    order = row_ids(members.groupBy("_c").agg(F.avg("lon").alias("_m")), ["_m", "_c"], "_f", max_rows=k)
    return members.join(order.select("_c", F.col("_f").cast("bigint").alias("fold")), "_c").drop("_c")


def training_rows(points: DataFrame, key: str, fold: str, buffer_km: float) -> DataFrame:
    """(key, fold) for every training membership after the exclusion buffer, all folds in one plan."""
    points = cut_lineage(points.select(key, fold, "lat", "lon"))
    folds = points.select(F.col(fold).alias("_t")).distinct()
    tests = points.select("lat", "lon", F.col(fold).alias("t")).distinct()
    near = near_coordinates(points.select("lat", "lon").distinct(), tests, buffer_km).select("lat", "lon", F.col("bt").alias("_t")).distinct()
    # One row per record and other fold: the fold list is a handful of values.
    every = F.array_sort(F.collect_set("_t"))
    spread = points.withColumn("_all", folds.agg(every).scalar()).select(key, "lat", "lon", F.col(fold).alias("_own"), F.explode("_all").alias("_t"))
    return spread.where("_t <> _own").join(near, ["lat", "lon", "_t"], "left_anti").select(key, F.col("_t").alias("fold"))
