"""One global series with drivers: lags, whitening, conjugate regression, rolling origins.

The series holds one row per period of the calendar. Lags, moments, lagged cross
products and scores are Spark windows and aggregates; a fit solves systems of a
dozen columns from those products, one row per origin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.distributions import t_quantile

# Fixed values of the estimator: priors, tolerance, iteration bound, search interval.
V0, ALPHA0, BETA0 = 1e8, 1e-3, 1e-3
RHO_TOL, MAX_ITERS, RHO_MARGIN = 1e-8, 100, 1e-6
LAMBDA_LOG10 = (-6.0, 6.0)


def lagged_design(series: DataFrame, time: str, outcome: str, lags: dict[str, int]) -> DataFrame:
    """Driver values `lag` periods earlier, complete cases only (calendar-bounded ordering)."""
    w = Window.orderBy(time)
    return series.select(time, outcome, *[F.lag(d, k).over(w).alias(d) if k else F.col(d) for d, k in lags.items()]).dropna()


def gaps(series: DataFrame, time: str) -> DataFrame:
    """Periods that do not follow their predecessor by exactly one."""
    step = F.col(time) - F.lag(time).over(Window.orderBy(time))
    return series.select(time, step.alias("step")).where("step <> 1")


def standardise(design: DataFrame, columns: Sequence[str], training) -> DataFrame:
    """Scale by the moments of the training rows (population deviation)."""
    m = design.agg(F.struct(*[F.struct(F.avg(F.when(training, F.col(c))).alias("m"), F.stddev_pop(F.when(training, F.col(c))).alias("s")).alias(c) for c in columns]).alias("t")).scalar()
    return design.withColumns({c: (F.col(c) - m[c]["m"]) / F.nullif(m[c]["s"], F.lit(0.0)) for c in columns})


def whiten(series: DataFrame, time: str, columns: Sequence[str], rho: float) -> DataFrame:
    """First row scaled by sqrt(1 - rho^2), later rows minus rho times the row before."""
    w = Window.orderBy(time)
    return series.select(time, *[
        F.when(F.row_number().over(w) == 1, F.col(c) * math.sqrt(1 - rho * rho)).otherwise(F.col(c) - rho * F.lag(c).over(w)).alias(c) for c in columns])


def lag_one_autocorrelation(series: DataFrame, time: str, residual: str) -> DataFrame:
    pairs = series.select(F.col(residual).alias("e"), F.lag(residual).over(Window.orderBy(time)).alias("p"))
    return pairs.agg((F.sum(F.col("e") * F.col("p")) / F.nullif(F.sum(F.col("e") * F.col("e")), F.lit(0.0))).alias("rho"))


# -- conjugate fit from lagged cross products -------------------------------------
#
# With rows m = (1, drivers, outcome), the whitened cross products at any rho are
#   G(rho) = S0 - rho (S1 + S1') + rho^2 (S0 - first first' - last last'),
# where S0 sums m m' and S1 sums m and the row before. One aggregate of S0 and S1, cut at the origins,
# serves every origin, rho and lambda; only systems as wide as the design are solved.

_FIT = ("origin int, n_train long, rho double, log10_lambda double, alpha double, beta double, evidence double, iterations int, converged boolean, "
        "mean array<double>, cov array<double>, mu array<double>, sd array<double>, last array<double>, eps double")


def _products(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], origins: Sequence[int]) -> DataFrame:
    """(origin, n, s0, s1, first, last, center): sums up to every origin, of columns less their overall means."""
    center = design.agg(F.struct(*[F.avg(c).alias(c) for c in (*drivers, outcome)]).alias("c")).scalar()
    w = Window.orderBy("t")  # one row per period of the calendar
    row = F.array(F.lit(1.0), *[F.col(c) - center[c] for c in (*drivers, outcome)])
    rows = design.select(F.col(time).alias("t"), row.alias("m")).withColumn("b", F.lag("m").over(w))
    k = len(drivers) + 2
    cut = F.array(*[F.lit(int(o)) for o in sorted(origins)])
    rows = rows.withColumn("segment", F.array_min(F.filter(cut, lambda o: o >= F.col("t")))).where("segment is not null")
    at = lambda c, i: F.col(c)[i]
    sums = rows.groupBy("segment").agg(
        F.count("*").alias("n"), F.array(*[F.sum(at("m", i) * at("m", j)) for i in range(k) for j in range(k)]).alias("s0"),
        F.array(*[F.coalesce(F.sum(at("m", i) * at("b", j)), F.lit(0.0)) for i in range(k) for j in range(k)]).alias("s1"),
        F.min_by("m", "t").alias("first"), F.max_by("m", "t").alias("last"), F.min("t").alias("from"), F.max("t").alias("to"))
    every = design.sparkSession.createDataFrame([(int(o),) for o in origins], "origin int")  # as many rows as origins were asked for
    add = lambda c: F.array(*[F.sum(at(c, i)) for i in range(k * k)]).alias(c)
    upto = sums.join(every, F.col("segment") <= F.col("origin")).groupBy("origin").agg(
        F.sum("n").alias("n"), add("s0"), add("s1"), F.min_by("first", "from").alias("first"), F.max_by("last", "to").alias("last"))
    return upto.withColumn("center", F.array(*[center[c] for c in (*drivers, outcome)]))


class _Products:
    """Cross products of one training series after its drivers are scaled by its own moments."""

    def __init__(self, n, s0, s1, first, last, center) -> None:
        k = len(first)
        s0, s1 = np.reshape(s0, (k, k)), np.reshape(s1, (k, k))
        d, self.n = k - 2, int(n)
        mean = s0[0, 1:1 + d] / n
        self.sd = np.sqrt(np.maximum(np.diag(s0)[1:1 + d] / n - mean**2, 0.0))
        self.mu = mean + np.asarray(center)[:d]
        move = np.eye(k)  # row -> (1, scaled drivers, outcome as it was)
        move[1:1 + d, 0], move[range(1, 1 + d), range(1, 1 + d)] = -mean / self.sd, 1.0 / self.sd
        move[-1, 0] = center[-1]
        self.s0, self.s1 = move @ s0 @ move.T, move @ s1 @ move.T
        self.first, self.last = move @ np.asarray(first), move @ np.asarray(last)

    def whitened(self, rho: float) -> np.ndarray:
        ends = np.outer(self.first, self.first) + np.outer(self.last, self.last)
        return self.s0 - rho * (self.s1 + self.s1.T) + rho * rho * (self.s0 - ends)

    def autocorrelation(self, mean: np.ndarray) -> float:
        c = np.append(-mean, 1.0)
        total = c @ self.s0 @ c
        return float(np.clip(c @ self.s1 @ c / total, RHO_MARGIN - 1, 1 - RHO_MARGIN)) if total > 0 else 0.0


def _posterior(g: np.ndarray, n: int, lam: float):
    """Mean, covariance scale, shape, rate and log evidence of the conjugate regression with products `g` of (X, y)."""
    prior = np.r_[1.0 / V0, np.full(len(g) - 2, lam)]
    precision = g[:-1, :-1] + np.diag(prior)
    mean = np.linalg.solve(precision, g[:-1, -1])
    alpha, beta = ALPHA0 + n / 2.0, BETA0 + 0.5 * float(g[-1, -1] - g[:-1, -1] @ mean)
    evidence = (0.5 * (np.log(prior).sum() - np.linalg.slogdet(precision)[1] - n * math.log(2 * math.pi)) + ALPHA0 * math.log(BETA0)
                - alpha * math.log(beta) + math.lgamma(alpha) - math.lgamma(ALPHA0))
    return mean, np.linalg.inv(precision), alpha, beta, float(evidence)


def _best_lambda(g: np.ndarray, n: int) -> float:
    """Lambda of the greatest evidence: ever finer grids of log10 lambda around the best point."""
    lo, hi = LAMBDA_LOG10
    while hi - lo > 1e-10:
        grid = np.linspace(lo, hi, 25)
        k = int(np.argmax([_posterior(g, n, 10.0**v)[4] for v in grid]))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, 24)]
    return 10.0 ** ((lo + hi) / 2)


def settled(p: _Products) -> dict:
    """The rho that the residuals of its own fit return, found from the products alone, and the fit at it."""
    rho, rounds, moved = 0.0, 0, math.inf
    while moved >= RHO_TOL and rounds < MAX_ITERS:
        g = p.whitened(rho)
        back = p.autocorrelation(_posterior(g, p.n, _best_lambda(g, p.n))[0])
        rho, moved, rounds = back, abs(back - rho), rounds + 1
    g = p.whitened(rho)
    lam = _best_lambda(g, p.n)
    mean, cov, alpha, beta, evidence = _posterior(g, p.n, lam)
    return dict(rho=rho, lam=lam, mean=mean, cov=cov, alpha=alpha, beta=beta, evidence=evidence, iterations=rounds, converged=moved < RHO_TOL)


def fits(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], origins: Sequence[int]) -> DataFrame:
    """One row per origin: the model of the rows up to it."""
    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p = _Products(r.n, r.s0, r.s1, r.first, r.last, r.center)
                f = settled(p)
                eps = float(p.last[-1] - p.last[:-1] @ f["mean"])
                rows.append((r.origin, r.n, f["rho"], math.log10(f["lam"]), f["alpha"], f["beta"], f["evidence"], f["iterations"], f["converged"],
                             f["mean"].tolist(), f["cov"].ravel().tolist(), p.mu.tolist(), p.sd.tolist(), p.last[:-1].tolist(), eps))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FIT.split(", ")])

    return _products(design, time, outcome, drivers, origins).mapInPandas(solve, _FIT)


def _critical(alpha: pd.Series) -> pd.Series:
    return alpha.map(lambda a: t_quantile(0.975, 2 * a))


def _with_critical(models: DataFrame) -> DataFrame:
    return models.withColumn("crit", F.pandas_udf(_critical, "double")("alpha"))


def fitted_model(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], end: int) -> DataFrame:
    """Sensitivity per driver in natural units with Student-t intervals, plus rho and lambda."""
    k, m = len(drivers) + 1, _with_critical(fits(design, time, outcome, drivers, [end]))
    v = lambda i: F.col("cov")[(i + 1) * (k + 1)]
    mean = lambda i: F.col("mean")[i + 1] / F.col("sd")[i]
    half = lambda i: F.col("crit") * F.sqrt(F.col("beta") / F.col("alpha") * v(i)) / F.col("sd")[i]
    rows = F.array(*[F.struct(F.lit(d).alias("driver"), mean(i).alias("mean"), (F.sqrt(F.col("beta") / (F.col("alpha") - 1) * v(i)) / F.col("sd")[i]).alias("sd"),
                              (mean(i) - half(i)).alias("ci_low"), (mean(i) + half(i)).alias("ci_high")) for i, d in enumerate(drivers)])
    return m.select(F.inline(rows), "rho", "log10_lambda", "evidence", "iterations", "converged")


def posterior(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], end: int) -> DataFrame:
    """Posterior of the scaled coefficients: mean, scale, shape and rate, with evidence and lambda."""
    k = len(drivers) + 1
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.col("mean")[i].alias("mean"), F.sqrt(F.col("cov")[i * (k + 1)]).alias("scale"))
                      for i, t in enumerate(("intercept", *drivers))])
    return fits(design, time, outcome, drivers, [end]).select(F.inline(terms), "alpha", "beta", "evidence", "log10_lambda")


def origin_fits(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], origins: Sequence[int]) -> DataFrame:
    """Fit record of every origin: training length, rho, lambda, iterations, convergence."""
    return fits(design, time, outcome, drivers, origins).select("origin", "n_train", "rho", "log10_lambda", "iterations", "converged")


def _paths(design: DataFrame, models: DataFrame, time: str, outcome: str, drivers: Sequence[str], condition) -> DataFrame:
    """Predictive mean and 95 % band of every period and model, anchored at the last training residual."""
    k = len(drivers) + 1
    both = design.select(F.col(time).cast("long").alias("t"), F.col(outcome).alias("observed"), *drivers).join(_with_critical(models), condition)
    inside, steps = F.col("t") <= F.col("origin"), (F.col("t") - F.col("origin")).cast("double")
    x = [F.lit(1.0), *[(F.col(d) - F.col("mu")[i]) / F.col("sd")[i] for i, d in enumerate(drivers)]]
    decay = F.when(inside, F.lit(0.0)).otherwise(F.pow("rho", steps))
    noise = F.when(inside, F.lit(1.0)).otherwise(1.0 - F.pow("rho", 2.0 * steps)) / (1.0 - F.col("rho") * F.col("rho"))
    z = [x[i] - decay * F.col("last")[i] for i in range(k)]
    spread = sum((z[i] * z[j] * F.col("cov")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    mean = sum((x[i] * F.col("mean")[i] for i in range(k)), F.lit(0.0)) + decay * F.col("eps")
    half = F.col("crit") * F.sqrt(F.col("beta") / F.col("alpha") * (noise + spread))
    return both.select("origin", "t", "observed", mean.alias("predicted"), (mean - half).alias("lower"), (mean + half).alias("upper"), inside.alias("in_sample"))


def predicted(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], end: int) -> DataFrame:
    return _paths(design, fits(design, time, outcome, drivers, [end]), time, outcome, drivers, F.col("origin") == end).drop("origin")


def rolling_origin(design: DataFrame, time: str, outcome: str, drivers: Sequence[str], origins: Sequence[int], horizon: int) -> DataFrame:
    """Forecasts of every origin up to the horizon; rows meet only the origins that forecast them."""
    ahead = (F.col("t") > F.col("origin")) & (F.col("t") <= F.col("origin") + horizon)
    p = _paths(design, fits(design, time, outcome, drivers, origins), time, outcome, drivers, ahead).withColumn("horizon", F.col("t") - F.col("origin"))
    p = p.select("origin", "horizon", "t", "observed", "predicted", "lower", "upper")
    width = F.col("upper") - F.col("lower")
    score = width + 40.0 * F.greatest(F.col("lower") - F.col("observed"), F.lit(0.0)) + 40.0 * F.greatest(F.col("observed") - F.col("upper"), F.lit(0.0))
    return p.withColumns({"error": F.col("predicted") - F.col("observed"), "width": width, "covered": F.col("observed").between(F.col("lower"), F.col("upper")), "interval_score": score})


def horizon_summary(predictions: DataFrame) -> DataFrame:
    e = F.col("error")
    return predictions.groupBy("horizon").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.avg(F.col("covered").cast("double")).alias("coverage"), F.count_if("covered").alias("covered_count"), F.avg("width").alias("mean_width"),
        F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.avg("interval_score").alias("interval_score"))
