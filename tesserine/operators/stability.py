"""Stability of Shapley shares: draws of units and of blocks, units left out, and autocorrelation of the full model's residuals.

Outcome and kind of draw are keys: one aggregate gives the cross products of every outcome, kind and draw, one the products of every unit,
from which leaving it out subtracts. The blocks share one long table, so a result is read by filters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators import linear as L
from tesserine.operators import resample as RS
from tesserine.operators import spatial as S
from tesserine.session import cut_lineage

#: Units reported per group of columns and outcome.
TOP = 10
RESIDUAL = "residual"


def _long(design: DataFrame, key: str, features: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """(key, outcome, features, _y): complete rows of every outcome, on rows that have the first outcome."""
    rows = design.select(key, *features, F.col(outcomes[0]).alias("_first"), F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("_y")) for o in outcomes])).alias("_o"))
    rows = rows.select(key, "_first", "_o.outcome", F.col("_o._y").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    kept = ["_first", "_y", *features]
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in kept])).drop("_first")


def _scaled(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns centred and scaled within their outcome; R2 does not change, cross products keep their digits."""
    moments = rows.groupBy("outcome").agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_m_{c}") for c in columns])
    at = rows.join(F.broadcast(moments), "outcome")  # one row per outcome
    return at.select(key, "outcome", *[
        ((F.col(c) - F.col(f"_m_{c}.m")) / F.when(F.col(f"_m_{c}.s") > 0, F.col(f"_m_{c}.s")).otherwise(1.0)).alias(c) for c in columns])


def keyed_shares(sums: DataFrame, by: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(by..., group, share) of cross products `g` of (1, columns, outcome); a matrix without rows has null shares."""
    columns = [c for cols in groups.values() for c in cols]
    index = {name: [columns.index(c) + 1 for c in cols] for name, cols in groups.items()}
    p = len(columns) + 2
    schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("group", T.StringType()), T.StructField("share", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g = L.unpack(r["g"], p)
                found = L.lmg(g, index, p - 1) if g[0, 0] > 0 else dict.fromkeys([*groups, RESIDUAL])
                rows += [(*[r[c] for c in by], name, share) for name, share in found.items()]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return sums.select(*by, "g").mapInPandas(solve, schema)


def drawn_shares(scaled: DataFrame, draws: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(outcome, kind, draw, group, share) for draws (kind, draw, `key`, times)."""
    columns = [c for cols in groups.values() for c in cols]
    by = ["outcome", "kind", "draw"]
    return keyed_shares(L.gram(draws.join(scaled, key), [*columns, "_y"], by, F.col("times")), by, groups)


def share_statistics(shares: DataFrame, point: DataFrame, groups: Mapping[str, Sequence[str]], draws: int) -> DataFrame:
    """(block, outcome, group, item, value): point, mean, deviation, interval, chance to lead and to be positive, failed draws.

    The leading group of a draw is the one of largest share among the named ones, the first in their order where several are equal.
    A draw in which no complete row is left is counted as failed.
    """
    place = F.create_map(*[F.lit(v) for name, at in zip(groups, range(len(groups))) for v in (name, -at)])
    named = F.col("group") != RESIDUAL
    by = ["outcome", "kind", "draw"]
    lead = shares.where(named).groupBy(*by).agg(F.max_by("group", F.struct("share", place[F.col("group")])).alias("_lead"))
    q = F.percentile("share", F.array(F.lit(0.025), F.lit(0.975)))
    stats = shares.join(lead, by).groupBy("outcome", "kind", "group").agg(
        F.avg("share").alias("mean"), F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("std"), q[0].alias("ci_low"), q[1].alias("ci_high"),
        F.when(F.first(named), F.avg((F.col("_lead") == F.col("group")).cast("double"))).alias("p_largest"),
        F.when(F.first(named), F.avg((F.col("share") > 0).cast("double"))).alias("p_positive"),
        (F.lit(draws) - F.count("share")).cast("double").alias("n_failed"))
    stats = stats.join(point, ["outcome", "group"])
    items = ["point", "mean", "std", "ci_low", "ci_high", "p_largest", "p_positive", "n_failed"]
    long = stats.select(F.col("kind").alias("block"), "outcome", "group", F.explode(F.array(*[
        F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])).alias("_i"))
    return long.select("block", "outcome", "group", "_i.*").where("value is not null")


def left_out_shares(scaled: DataFrame, total: DataFrame, point: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(outcome, group, key, delta): share of all rows less the share without the unit, from the total less the unit's own products."""
    columns = [c for cols in groups.values() for c in cols]
    own = L.gram(scaled, [*columns, "_y"], ["outcome", key])
    left = own.join(F.broadcast(total.select("outcome", F.col("g").alias("_t"))), "outcome").select("outcome", key, F.zip_with("_t", "g", lambda a, b: a - b).alias("g"))
    found = keyed_shares(left, ["outcome", key], groups).where(F.col("share").isNotNull() & (F.col("group") != RESIDUAL))
    return found.join(point, ["outcome", "group"]).select("outcome", "group", key, (F.col("point") - F.col("share")).alias("delta"))


def residual_autocorrelation(rows: DataFrame, points: DataFrame, key: str, features: Sequence[str], k: int, draws: int, seed: int = 0,
                             max_rows: int | None = None) -> DataFrame:
    """(item, value) of Moran's I of the residuals of one outcome, by `points` (key, lat, lon), and a reason where there is none.

    Units without coordinates are left out; k or fewer units give no statistic.
    """
    beta = L.fit(rows, features, "_y").select("beta").scalar()
    located = points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").groupBy(key).agg(
        F.min_by(F.struct("lat", "lon"), F.struct("lat", "lon")).alias("_p")).select(key, "_p.lat", "_p.lon")
    values = cut_lineage(rows.select(key, (F.col("_y") - L.predicted(beta, features)).alias("_e")).join(located, key))
    n = values.count()
    base = {"n": float(n), "k_neighbors": float(k), "n_permutations": float(draws)}
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, v, None) for i, v in base.items()], "item string, value double, reason string")
    if n < k + 1:
        missing = spark.createDataFrame([(i, None, "insufficient_samples_for_requested_neighbors") for i in ("morans_i", "p_value")], known.schema)
        return known.unionByName(missing)
    m = S.moran(values, S.knn_weights(values, key, k), key, "_e", draws, seed, max_rows)
    parts = F.array(F.struct(F.lit("morans_i").alias("item"), F.col("statistic").alias("value")), F.struct(F.lit("p_value").alias("item"), F.col("p_value").alias("value")))
    found = m.select(F.explode(parts).alias("_i"), "reason").select("_i.item", F.when(F.col("reason").isNull(), F.col("_i.value")).alias("value"), "reason")
    return known.unionByName(found)


def prepared(design: DataFrame, key: str, groups: Mapping[str, Sequence[str]], outcomes: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Complete rows, their scaled copies, cross products and point shares (outcome, group, point) of every outcome."""
    features = [c for cols in groups.values() for c in cols]
    rows = cut_lineage(_long(design, key, features, outcomes))
    scaled = cut_lineage(_scaled(rows, key, [*features, "_y"]))
    total = cut_lineage(L.gram(scaled, [*features, "_y"], ["outcome"]))
    return rows, scaled, total, cut_lineage(keyed_shares(total, ["outcome"], groups).withColumnRenamed("share", "point"))


def both_draws(design: DataFrame, key: str, block: str, draws: int, seed: int, block_seed: int, max_rows: int | None = None) -> DataFrame:
    """(kind, draw, key, times): draws of units and of whole blocks in one table."""
    blocked = design.where(F.col(block).isNotNull())
    return RS.digest_draws(design, key, draws, seed, max_rows).withColumn("kind", F.lit("unit_draws")).unionByName(
        RS.block_draws(blocked, key, block, draws, block_seed, max_rows).withColumn("kind", F.lit("block_draws")))


def stability_blocks(design: DataFrame, points: DataFrame, key: str, block: str, groups: Mapping[str, Sequence[str]], outcomes: Sequence[str],
                     draws: int = 2_000, k: int = 8, permutations: int = 199, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """(block, outcome, group, item, rank, value, reason): the whole summary of every outcome.

    `unit_draws` and `block_draws` hold the share statistics, `influence` the `TOP` units of the first outcome that move each group's share
    most (item is the unit, ties by key), `residual_spatial` Moran's I of the full model's residuals. Further outcomes keep to the rows that
    have the first. Draws are taken from all units of the design; incomplete ones count for nothing, and units without a block are in no
    block draw. An empty design has no rows.
    """
    features = [c for cols in groups.values() for c in cols]
    design = cut_lineage(design.dropDuplicates([key]).where(F.col(key).isNotNull()))
    rows, scaled, total, point = prepared(design, key, groups, outcomes)
    kinds = both_draws(design, key, block, draws, seed, seed + 1, max_rows)
    shares = cut_lineage(drawn_shares(scaled, kinds, key, groups))
    empty = F.lit(None)
    parts = [share_statistics(shares, point, groups, draws).withColumns({"rank": empty.cast("int"), "reason": empty.cast("string")})]
    moved = left_out_shares(scaled.where(F.col("outcome") == outcomes[0]), total, point, key, groups)
    order = Window.partitionBy("outcome", "group").orderBy(F.round(F.abs("delta"), 9).desc(), key)
    parts.append(moved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select(
        F.lit("influence").alias("block"), "outcome", "group", F.col(key).cast("string").alias("item"), F.col("delta").alias("value"), "rank", empty.cast("string").alias("reason")))
    for o in [r["outcome"] for r in total.select("outcome").collect()]:  # one row per outcome
        found = residual_autocorrelation(rows.where(F.col("outcome") == o), points, key, features, k, permutations, seed, max_rows)
        parts.append(found.withColumns({"block": F.lit("residual_spatial"), "outcome": F.lit(o), "group": F.lit(""), "rank": empty.cast("int")}))
    return reduce(lambda a, b: a.unionByName(b), [p.select("block", "outcome", "group", "item", "rank", "value", "reason") for p in parts])
