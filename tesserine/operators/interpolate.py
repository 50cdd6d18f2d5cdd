"""Inverse-distance and kriging predictions from neighbour lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.spatial import nearest, ring_statistics, training_semivariances
from tesserine.session import cut_lineage


def idw(neighbours: DataFrame, query: str, value: str, power: float = 2.0) -> DataFrame:
    """Weighted by distance; exact hits return the mean of the coincident values."""
    hit = F.col("km") == 0
    w = 1.0 / F.pow(F.nullif(F.col("km"), F.lit(0.0)), F.lit(power))
    return neighbours.groupBy(query).agg(
        F.coalesce(F.avg(F.when(hit, F.col(value))), F.sum(w * F.col(value)) / F.sum(w)).alias("idw"), F.count("*").alias("n_used"))


_FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("nugget", "psill", "range_km")])


def _fit_spherical(bins: pd.DataFrame) -> tuple[float, float, float]:
    """Least squares over the range; nugget and partial sill follow for each range."""
    h, g, n = (bins[c].to_numpy(float) for c in ("h", "gamma", "n"))
    root = np.sqrt(n)
    best, chosen = np.inf, (0.0, 0.0, float(h.max()))
    for rng in np.geomspace(max(h.min(), 1e-6), 2.0 * h.max(), 400):
        u = np.minimum(h / rng, 1.0)
        shape, flat = 1.5 * u - 0.5 * u**3, np.ones_like(u)
        for has_nugget, has_sill in ((True, True), (False, True), (True, False)):
            columns = [c for c, used in ((flat, has_nugget), (shape, has_sill)) if used]
            design = np.column_stack(columns)
            coef = np.linalg.lstsq(design * root[:, None], g * root, rcond=None)[0]
            loss = float(np.sum(n * (design @ coef - g) ** 2))
            if (coef >= 0).all() and loss < best:
                best = loss
                chosen = (float(coef[0]) if has_nugget else 0.0, float(coef[-1]) if has_sill else 0.0, float(rng))
    return chosen


def variogram(points: DataFrame, value: str, max_km: float, n_bins: int = 12) -> DataFrame:
    """Spherical variogram (nugget, partial sill, range) from binned semivariances; one row."""
    edges = [max_km * i / n_bins for i in range(n_bins + 1)]
    rings = ring_statistics(points, value, edges)
    mid = (F.col("ring") + 0.5) * (max_km / n_bins)

    def fit(batches):
        frame = pd.concat(list(batches), ignore_index=True)  # at most n_bins rows
        if len(frame):
            yield pd.DataFrame([_fit_spherical(frame.sort_values("h"))], columns=["nugget", "psill", "range_km"])

    return rings.select(mid.alias("h"), F.col("semivariance").alias("gamma"), F.col("n_pairs").cast("double").alias("n")).coalesce(1).mapInPandas(fit, _FIT)


def fold_variograms(points: DataFrame, value: str, fold: str, max_km: float, n_bins: int = 12) -> DataFrame:
    """(fold, nugget, psill, range_km): the variogram of the rows outside each fold, all from one comparison of pairs."""
    edges = [max_km * i / n_bins for i in range(n_bins + 1)]
    rings = training_semivariances(points, value, fold, edges)
    kind = dict(rings.dtypes)[fold]

    def fit(key, bins):
        return pd.DataFrame([(key[0], *_fit_spherical(bins.sort_values("h")))], columns=[fold, "nugget", "psill", "range_km"])  # at most n_bins rows

    mid = (F.col("ring") + 0.5) * (max_km / n_bins)
    bins = rings.select(fold, mid.alias("h"), F.col("semivariance").alias("gamma"), F.col("n_pairs").cast("double").alias("n"))
    return bins.groupBy(fold).applyInPandas(fit, f"`{fold}` {kind}, nugget double, psill double, range_km double")


_KRIGE = T.StructType([T.StructField("kriging", T.DoubleType()), T.StructField("variance", T.DoubleType())])


def _krige_batch(params: tuple[float, float, float], qlat, qlon, lat, lon, val) -> pd.DataFrame:
    nugget, psill, rng = params

    def gamma(km):
        u = np.minimum(km / rng, 1.0)
        return np.where(km > 0, nugget + psill * (1.5 * u - 0.5 * u**3), 0.0)

    def km(a1, o1, a2, o2):
        p1, p2 = np.radians(a1), np.radians(a2)
        a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(o2 - o1) / 2) ** 2
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))

    out = np.full((len(qlat), 2), np.nan)
    sizes = np.array([len(v) for v in val])
    for k in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == k)
        la, lo, v = (np.stack([np.asarray(c.iloc[r], float) for r in rows]) for c in (lat, lon, val))
        qa, qo = qlat.to_numpy()[rows][:, None], qlon.to_numpy()[rows][:, None]
        system = np.zeros((len(rows), k + 1, k + 1))
        system[:, :k, :k] = gamma(km(la[:, :, None], lo[:, :, None], la[:, None, :], lo[:, None, :]))
        system[:, k, :k] = system[:, :k, k] = 1.0
        target = np.ones((len(rows), k + 1))
        target[:, :k] = gamma(km(qa, qo, la, lo))
        weights = (np.linalg.pinv(system) @ target[:, :, None])[:, :, 0]
        out[rows, 0] = np.sum(weights[:, :k] * v, axis=1)
        out[rows, 1] = np.sum(weights * target, axis=1)
    return pd.DataFrame(out, columns=["kriging", "variance"])


def ordinary_kriging(neighbours: DataFrame, query: str, value: str, model: DataFrame) -> DataFrame:
    """Kriging in a moving neighbourhood: one small system per query, solved in Arrow batches.

    `neighbours` holds the query position (qlat, qlon), the neighbour position
    (lat, lon) and its value; at most k rows per query. The variogram rides along
    as three columns of every query.
    """
    lists = neighbours.groupBy(query).agg(
        F.first("qlat").alias("qlat"), F.first("qlon").alias("qlon"),
        F.array_sort(F.collect_list(F.struct("rank", "lat", "lon", F.col(value).alias("v")))).alias("n"))
    m = model.select(F.struct("nugget", "psill", "range_km").alias("m")).scalar()

    @F.pandas_udf(_KRIGE)
    def solve(nug: pd.Series, sill: pd.Series, rng: pd.Series, qlat: pd.Series, qlon: pd.Series, lat: pd.Series, lon: pd.Series, val: pd.Series) -> pd.DataFrame:
        return _krige_batch((nug.iloc[0], sill.iloc[0], rng.iloc[0]), qlat, qlon, lat, lon, val)

    lists = lists.withColumn("m", m)
    return lists.select(query, solve("m.nugget", "m.psill", "m.range_km", "qlat", "qlon", F.col("n.lat"), F.col("n.lon"), F.col("n.v")).alias("r")).select(query, "r.kriging", "r.variance")


def neighbour_values(queries: DataFrame, points: DataFrame, k: int, qkey: str, pkey: str, value: str, exclude: str | None) -> DataFrame:
    """Neighbour lists with positions and values."""
    near = nearest(queries, points, k, qkey, pkey, exclude)
    name = "neighbour" if qkey == pkey else pkey
    right = points.select(F.col(pkey).alias(name), "lat", "lon", value)
    left = queries.select(qkey, F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    return near.join(right, name).join(left, qkey)


def left_out_neighbours(points: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(left_out, q, rank, km, qlat, qlon, lat, lon, v): neighbours of every point with its whole location or only its row left out.

    k is clamped so that every point still has a full list: to all points without the largest location, or without one row.
    """
    size = points.groupBy("lat", "lon").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.max("c").alias("m")).first()
    others = points.select(F.col(key).alias("_o"), "lat", "lon", F.col(value).alias("v"))
    out = None
    for name, exclude, gone in (("location", "coordinate", size["m"] or 0), ("row", "self", 1)):
        wanted = min(k, (size["n"] or 0) - gone)
        if wanted < 1:
            raise ValueError(f"no neighbours are left to predict from: {size['n']} points, {gone} left out")
        if exclude == "self":
            near = nearest(points.select(F.col(key).alias("_o"), "lat", "lon"), others.select("_o", "lat", "lon"), wanted, "_o", "_o", "self").select(F.col("_o").alias("q"), F.col("neighbour").alias("_o"), "km", "rank")
        else:
            near = nearest(points.select(F.col(key).alias("q"), "lat", "lon"), others, wanted, "q", "_o", exclude)
        rows = near.join(others, "_o").join(points.select(F.col(key).alias("q"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), "q")
        rows = rows.select(F.lit(name).alias("left_out"), "q", "rank", "km", "qlat", "qlon", "lat", "lon", "v")
        out = rows if out is None else out.unionByName(rows)
    return out


def interpolation_scores(points: DataFrame, key: str, value: str, k: int, model: DataFrame) -> DataFrame:
    """(left_out, method, n, rmse, mae) of inverse distance and kriging, for both ways of leaving out, in one plan.

    The variogram `model` is fitted on all points; leaving a location out removes its twins from the lists, not that dependence.
    """
    near = cut_lineage(left_out_neighbours(points, key, value, k).withColumn("_q", F.struct("left_out", "q")))
    both = idw(near, "_q", "v").select("_q", "idw").join(ordinary_kriging(near, "_q", "v", model).select("_q", "kriging"), "_q")
    truth = points.select(F.col(key).alias("q"), F.col(value).alias("_t"))
    long = both.select("_q.left_out", "_q.q", "idw", "kriging").join(truth, "q").unpivot(["left_out", "_t"], ["idw", "kriging"], "method", "p").withColumn("e", F.col("p") - F.col("_t"))
    return long.groupBy("left_out", "method").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))


def best_surface(points: DataFrame, key: str, value: str, nodes: DataFrame, node: str, k: int, model: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """(scores, winner, surface): the method with the smaller error with locations left out predicts the nodes (node, method, value).

    Equal errors go to inverse distance.
    """
    scores = cut_lineage(interpolation_scores(points, key, value, k, model))
    error = {r["method"]: r["rmse"] for r in scores.where("left_out = 'location'").collect()}  # two rows
    winner = "kriging" if error["kriging"] < error["idw"] else "idw"
    near = neighbour_values(nodes, points, k, node, key, value, None)
    made = idw(near, node, value).select(node, F.col("idw").alias("value")) if winner == "idw" else ordinary_kriging(near, node, value, model).select(node, F.col("kriging").alias("value"))
    return scores, winner, made.select(node, F.lit(winner).alias("method"), "value")
