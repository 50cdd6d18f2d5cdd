"""Out-of-fold evaluation: predictions under several exclusion buffers from one distance pass, scorecards, and a candidate's verdict.

The training sums of a fold are those of all rows less the fold's own and less those of the rows that a buffer takes out, so only rows
within a buffer are written once more; nothing is copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators import resample as RS
from tesserine.operators.neighbours import closest_coordinates
from tesserine.session import cut_lineage

#: Fixed values of the verdict rules: a useful gain, the loss that vetoes, the share of training fits that must agree, rows of a region that counts.
PRACTICAL, VETO, SIGN_STABILITY, LEAST_REGION = -0.002, 0.001, Fraction(4, 5), 5


def _sums(columns: Sequence[str]) -> list[Column]:
    """Products of intercept, columns and outcome, row by row of the upper triangle."""
    parts = [F.lit(1.0), *[F.col(c) for c in columns]]
    return [F.sum(parts[a] * parts[b]).alias(f"_g{a}_{b}") for a in range(len(parts)) for b in range(a, len(parts))]


def fold_distances(points: DataFrame, fold: str) -> DataFrame:
    """(lat, lon, fold, km): how far every coordinate is from the nearest row of every fold; one search per fold."""
    coords = cut_lineage(points.select("lat", "lon", fold).distinct())
    out = None
    for f in [r[0] for r in coords.select(fold).distinct().orderBy(fold).collect()]:  # a handful of folds
        test = coords.where(F.col(fold) == f).select("lat", "lon", F.lit(0).alias("_first"))
        near = closest_coordinates(coords, test, 1).groupBy("lat", "lon").agg(F.min("km").alias("km")).withColumn("fold", F.lit(f))
        out = near if out is None else out.unionByName(near)
    return cut_lineage(out)


def buffered_fits(points: DataFrame, columns: Sequence[str], outcome: str, fold: str, buffers: Sequence[float], distances: DataFrame | None = None) -> DataFrame:
    """(buffer_km, fold, n_train, beta): least squares of every fold under every buffer; beta begins with the intercept.

    A training row is of another fold and farther than the buffer from all rows of this one. Fold and buffer -1 with all rows is the fit in sample.
    A fold that a buffer leaves without training rows has no fit.
    """
    columns, used = list(columns), [*columns, outcome]
    centre = points.agg(*[F.avg(c).alias(c) for c in used]).first()
    rows = points.select("lat", "lon", F.col(fold).alias("fold"), *[(F.col(c) - F.lit(float(centre[c]))).alias(c) for c in used])
    names = [f"_g{a}_{b}" for a in range(len(used) + 1) for b in range(a, len(used) + 1)]
    own = cut_lineage(rows.groupBy("fold").agg(*_sums(used)))
    total = own.agg(*[F.sum(n).alias(n) for n in names]).first()
    reach = (fold_distances(points, fold) if distances is None else distances).withColumnRenamed("fold", "_f")
    taken = F.explode(F.filter(F.array(*[F.lit(float(b)) for b in buffers]), lambda b: b >= F.col("km"))).alias("buffer_km")
    removed = rows.join(reach, ["lat", "lon"]).where("fold <> _f").select("*", taken).groupBy("buffer_km", F.col("_f").alias("fold")).agg(*_sums(used))
    every = own.withColumn("buffer_km", F.explode(F.array(*[F.lit(float(b)) for b in buffers])))
    both = every.join(removed.select("buffer_km", "fold", *[F.col(n).alias(f"r{n}") for n in names]), ["buffer_km", "fold"], "left")
    left = both.select("buffer_km", "fold", *[(F.lit(float(total[n] or 0.0)) - F.col(n) - F.coalesce(f"r{n}", F.lit(0.0))).alias(n) for n in names])
    left = left.where(F.col("_g0_0") > 0.5)  # the intercept's own product counts the rows
    kind = dict(left.dtypes)["fold"]
    whole = own.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit(-1.0).alias("buffer_km"), F.lit(-1).cast(kind).alias("fold"), *names)
    width = len(used) + 1
    means = np.array([centre[c] for c in used], float)

    def solve(batches):
        for frame in batches:
            betas = []
            for values in frame[names].to_numpy(float):
                g = np.zeros((width, width))
                g[np.triu_indices(width)] = values
                g = g + np.triu(g, 1).T
                size = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))
                slope = np.linalg.lstsq(g[:-1, :-1] / np.outer(size, size), g[:-1, -1] / size, rcond=1e-12)[0] / size
                betas.append([means[-1] + slope[0] - slope[1:] @ means[:-1], *slope[1:]])
            yield pd.DataFrame({"buffer_km": frame["buffer_km"], "fold": frame["fold"], "n_train": np.rint(frame["_g0_0"]).astype(np.int64), "beta": betas})

    return cut_lineage(left.unionByName(whole).mapInPandas(solve, f"buffer_km double, fold {kind}, n_train long, beta array<double>"))


def predictions(points: DataFrame, key: str, columns: Sequence[str], outcome: str, fold: str, fits: DataFrame) -> DataFrame:
    """(buffer_km, key, fold, y, prediction, fitted, n_train): out of fold under every buffer, and in sample."""
    def value(beta: Column) -> Column:
        return sum((beta[k + 1] * F.col(c) for k, c in enumerate(columns)), beta[0])

    inner = fits.where("buffer_km = -1").select("beta").first()["beta"]
    fitted = value(F.array(*[F.lit(b) for b in inner]))
    rows = points.select(key, F.col(fold).alias("fold"), F.col(outcome).alias("y"), *columns).withColumn("fitted", fitted)
    joined = rows.join(fits.where("buffer_km >= 0"), "fold")
    return cut_lineage(joined.select("buffer_km", key, "fold", "y", value(F.col("beta")).alias("prediction"), "fitted", "n_train"))


def residual_moran(residuals: DataFrame, edges: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """(by, moran) of every group's residuals on one graph."""
    mean = residuals.groupBy(by).agg(F.avg(value).alias("_m"))
    z = residuals.join(mean, by).select(by, key, (F.col(value) - F.col("_m")).alias("z"))
    square = z.groupBy(by).agg(F.sum(F.col("z") * F.col("z")).alias("_q"), F.count("*").alias("_n"))
    pairs = edges.join(z.select(by, F.col(key).alias("i"), F.col("z").alias("_a")), "i").join(z.select(by, F.col(key).alias("j"), F.col("z").alias("_b")), [by, "j"])
    cross = pairs.groupBy(by).agg(F.sum(F.col("w") * F.col("_a") * F.col("_b")).alias("_c"), F.sum("w").alias("_w"))
    return cross.join(square, by).select(by, (F.col("_n") / F.col("_w") * F.col("_c") / F.nullif(F.col("_q"), F.lit(0.0))).alias("moran"))


def scorecards(points: DataFrame, key: str, columns: Sequence[str], outcome: str, fold: str, buffers: Sequence[float], edges: DataFrame) -> DataFrame:
    """One row per buffer: errors and R2 in and out of sample, folds, calibration, training rows, and Moran's I of both residuals."""
    points = cut_lineage(points.select(*dict.fromkeys([key, "lat", "lon", fold, outcome, *columns])))
    p = predictions(points, key, columns, outcome, fold, buffered_fits(points, columns, outcome, fold, buffers))
    p = cut_lineage(p.withColumns({"e": F.col("y") - F.col("prediction"), "ei": F.col("y") - F.col("fitted")}))
    spread = F.var_pop("y") * F.count("*")
    square = lambda c: F.sum(F.col(c) * F.col(c))
    card = p.groupBy("buffer_km").agg(
        F.count("*").alias("n"), (1 - square("ei") / spread).alias("in_sample_r2"), (1 - square("e") / spread).alias("cv_r2"), F.sqrt(square("e") / F.count("*")).alias("cv_rmse"),
        F.avg(F.abs("e")).alias("cv_mae"), F.sqrt(square("ei") / F.count("*")).alias("in_sample_rmse"), F.stddev_samp("y").alias("outcome_sd"),
        F.regr_slope("y", "prediction").alias("calibration_slope"), F.regr_intercept("y", "prediction").alias("calibration_intercept"), F.avg("n_train").alias("mean_n_train"))
    per = p.groupBy("buffer_km", "fold").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("_r"), F.count("*").alias("_n"))
    folds = per.groupBy("buffer_km").agg(F.count("*").alias("n_folds"), F.median("_r").alias("fold_rmse_median"), F.min("_r").alias("fold_rmse_min"), F.max("_r").alias("fold_rmse_max"),
                                         F.max_by(F.struct("fold", F.col("_n").alias("n")), F.struct("_r", -F.col("fold"))).alias("_w"))
    folds = folds.select("*", F.col("_w.fold").alias("worst_fold"), F.col("_w.n").alias("worst_fold_n")).drop("_w")
    outer = residual_moran(p, edges, key, "e", "buffer_km").withColumnRenamed("moran", "residual_moran_cv")
    inner = residual_moran(p, edges, key, "ei", "buffer_km").withColumnRenamed("moran", "residual_moran_in_sample")
    return card.join(folds, "buffer_km").join(inner, "buffer_km", "left").join(outer, "buffer_km", "left")


# -- verdict ------------------------------------------------------------------------


def paired_interval(losses: DataFrame, unit: str, draws: int, seed: int = 0) -> DataFrame:
    """(delta_rmse, ci_low, ci_high): candidate less comparator, and the interval when whole units are drawn again with both their errors."""
    sums = cut_lineage(losses.groupBy(unit).agg(F.sum(F.col("comparator") * F.col("comparator")).alias("_a"), F.sum(F.col("candidate") * F.col("candidate")).alias("_b"), F.count("*").alias("_n")))
    rms = lambda c, t: F.sqrt(F.sum(t * F.col(c)) / F.sum(t * F.col("_n")))
    one = F.lit(1)
    delta = sums.agg((rms("_b", one) - rms("_a", one)).alias("delta_rmse"))
    t = F.col("times")
    per = RS.digest_draws(sums, unit, draws, seed).join(sums, unit).groupBy("draw").agg((rms("_b", t) - rms("_a", t)).alias("d"))
    return RS.percentile_interval(per, "d").select(delta.scalar().alias("delta_rmse"), "ci_low", "ci_high")


def worst_region(losses: DataFrame, region: str, error: str) -> DataFrame:
    """(region, rmse) with the largest error among regions of at least `LEAST_REGION` rows."""
    per = losses.groupBy(region).agg(F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"), F.count("*").alias("_n")).where(F.col("_n") >= LEAST_REGION)
    return per.agg(F.max_by(F.col(region), F.struct("rmse", F.col(region))).alias("region"), F.max("rmse").alias("rmse"))


def verdict(delta: float, interval: tuple[float, float], secondary_change: float, region_change: float, coefficient: float, negative: int, fits: int) -> dict[str, object]:
    """The rules on finite inputs; a missing or infinite one is refused, never read as a failed rule."""
    inputs = {"delta_rmse": delta, "interval_low": interval[0], "interval_high": interval[1], "secondary_rmse_change": secondary_change,
              "worst_region_rmse_change": region_change, "coefficient_full": coefficient}
    for name, value in inputs.items():
        if value is None or not np.isfinite(value):
            raise ValueError(f"verdict input {name} is not finite")
    if fits < 1:
        raise ValueError("no training fits")
    gain, sign = delta < 0 and interval[1] < 0, coefficient < 0 and Fraction(negative, fits) >= SIGN_STABILITY
    material, secondary, regions = delta <= PRACTICAL, secondary_change <= VETO, region_change <= VETO
    supported = gain and sign
    label = "not supported" if not supported else "supported and promoted" if material and secondary and regions else "supported but sub-material / not promoted"
    return {"verdict": label, "s1_interval_below_zero": gain, "s2_sign_negative_and_stable": sign, "a2_material": material, "a3_secondary_veto_passed": secondary,
            "a4_worst_region_veto_passed": regions, "improvement_without_stated_sign": gain and not sign, "worsened": delta > 0 and interval[0] > 0, **inputs,
            "coefficient_negative_n": negative, "coefficient_n_fits": fits}


def candidate_verdict(points: DataFrame, key: str, unit: str, region: str, comparator: Sequence[str], feature: str, outcome: str, fold: str, second_fold: str,
                      buffer_km: float, draws: int, seed: int = 0) -> DataFrame:
    """One row: is `feature` worth adding to `comparator`?

    Errors are out of fold behind the buffer; the secondary folds leave out whole groups and rows at the same place. Paired resampling
    draws whole units. The sign is that of the feature in all training fits of the primary folds.
    """
    spark = points.sparkSession
    candidate = [*comparator, feature]
    points = cut_lineage(points.select(*dict.fromkeys([key, unit, region, "lat", "lon", fold, second_fold, outcome, *candidate])))

    def errors(by: str, buffer: float) -> tuple[DataFrame, DataFrame]:
        far = fold_distances(points, by)
        fits = {name: buffered_fits(points, columns, outcome, by, [buffer], far) for name, columns in (("comparator", comparator), ("candidate", candidate))}
        parts = [predictions(points, key, columns, outcome, by, fits[name]).select(key, (F.col("y") - F.col("prediction")).alias(name)) for name, columns in (("comparator", comparator), ("candidate", candidate))]
        return cut_lineage(parts[0].join(parts[1], key).join(points.select(*dict.fromkeys([key, unit, region])), key)), fits["candidate"]

    primary, fits = errors(fold, buffer_km)
    secondary, _ = errors(second_fold, 0.0)
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c)
    other = secondary.agg(rms("comparator"), rms("candidate")).first()
    paired = paired_interval(primary, unit, draws, seed).first()
    worst = {c: worst_region(primary, region, c).first()["rmse"] for c in ("comparator", "candidate")}
    slope = F.col("beta")[len(candidate)]
    sign = fits.agg(F.max(F.when(F.col("buffer_km") < 0, slope)).alias("full"), F.count_if((F.col("buffer_km") >= 0) & (slope < 0)).alias("negative"), F.count_if(F.col("buffer_km") >= 0).alias("fits")).first()
    missing = float("nan")
    row = verdict(paired["delta_rmse"], (paired["ci_low"], paired["ci_high"]), other["candidate"] - other["comparator"],
                  missing if None in worst.values() else worst["candidate"] - worst["comparator"], sign["full"], sign["negative"], sign["fits"])
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, (bool, np.bool_)) else 'long' if isinstance(v, int) else 'double'}" for n, v in row.items()))
