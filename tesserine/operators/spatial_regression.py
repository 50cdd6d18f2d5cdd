"""Spatial error (sem) and spatial lag (sar) models by concentrated likelihood.

Spark forms the lags by an edge join and one matrix of cross products of
(1, X, y) and their lags per fold; the likelihood for any dependence value is a
polynomial in those products. Only the log-determinant and the trend solve need
the graph itself, which is refused beyond `GRAPH_LIMIT` units per fold. Folds
are solved in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.linear import gram, group_shares, standardised, unpack
from tesserine.operators.robust import Z_975
from tesserine.operators.spatial import TIE_DIGITS, near_pairs
from tesserine.session import cut_lineage

GRAPH_LIMIT = 3_000
# Fixed values of the search: domain bound, grid size.
DOMAIN_BOUND, GRID_POINTS = 0.99, 199
_WHOLE_EARTH_KM = 20_100.0


def lagged(values: DataFrame, edges: DataFrame, key: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Weighted neighbour sums of the columns, as lag_<column>."""
    by = list(by)
    right = values.select(*by, F.col(key).alias("j"), *columns)
    sums = edges.join(right, [*by, "j"]).groupBy(*by, "i").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"lag_{c}") for c in columns])
    joined = values.join(sums.withColumnRenamed("i", key), [*by, key], "left")
    return joined.fillna(0.0, subset=[f"lag_{c}" for c in columns])


def spatial_filter(values: DataFrame, edges: DataFrame, key: str, columns: Sequence[str], theta: float) -> DataFrame:
    """Columns minus theta times their spatial lag."""
    both = lagged(values, edges, key, columns)
    return both.withColumns({c: F.col(c) - theta * F.col(f"lag_{c}") for c in columns}).drop(*[f"lag_{c}" for c in columns])


def _systems(values: DataFrame, edges: DataFrame, key: str, outcome: str, columns: Sequence[str], fold: str) -> DataFrame:
    """Per fold: cross products of (1, X, y, lags), the graph and the rows of X, all of bounded size."""
    largest = values.groupBy(fold).count().agg(F.max("count")).collect()[0][0]
    if largest and largest > GRAPH_LIMIT:
        raise ValueError(f"{largest} units exceed the dense-graph limit of {GRAPH_LIMIT}")
    scaled, moments = standardised(values, columns, keep=[fold, key, outcome])
    scaled = cut_lineage(scaled.withColumn("_one", F.lit(1.0)))
    work = lagged(scaled, edges, key, ["_one", *columns, outcome], [fold])
    names = [*columns, outcome, "lag__one", *[f"lag_{c}" for c in columns], f"lag_{outcome}"]
    sums = gram(work, names, [fold])
    graph = edges.groupBy(fold).agg(F.collect_list(F.struct("i", "j", "w")).alias("e"))
    rows = scaled.groupBy(fold).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.array(*[F.col(c) for c in columns]).alias("x")))).alias("x"))
    return sums.join(graph, fold).join(rows, fold).select(
        fold, "n", "g", F.col("e.i").alias("ei"), F.col("e.j").alias("ej"), F.col("e.w").alias("ew"), F.col("x.id").alias("ids"), F.col("x.x").alias("x"),
        F.array(*[moments[c]["m"] for c in columns]).alias("_m"), F.array(*[F.when(moments[c]["s"] > 0, moments[c]["s"]).otherwise(1.0) for c in columns]).alias("_s"))


class _System:
    """One fold's likelihood, evaluated from its cross products."""

    def __init__(self, row, p: int, family: str):
        k = p + 2  # intercept, p columns, outcome
        full = unpack(row.g, 2 * k)
        self.n, self.p, self.family = float(row.n), p, family
        self.g00, self.g01, self.g11 = full[:k, :k], full[:k, k:], full[k:, k:]
        ids = np.asarray(row.ids)
        place = {v: i for i, v in enumerate(ids)}
        self.w = np.zeros((len(ids), len(ids)))
        for i, j, w in zip(row.ei, row.ej, row.ew):
            self.w[place[i], place[j]] += w
        self.ids = ids
        self.x = np.column_stack([np.ones(len(ids)), np.stack([np.asarray(v, float) for v in row.x])]) if p else np.ones((len(ids), 1))
        self.eigen = np.linalg.eigvals(self.w)
        self.mean, self.scale = np.asarray(row._m, float), np.asarray(row._s, float)

    def at(self, theta: float) -> tuple[float, np.ndarray, float]:
        """Log-likelihood, coefficients (scaled columns) and innovation variance."""
        p = self.p + 1
        moved = self.g00 - theta * (self.g01 + self.g01.T) + theta * theta * self.g11
        if self.family == "sem":
            a, b, c = moved[:p, :p], moved[:p, p], moved[p, p]
        else:
            a, b, c = self.g00[:p, :p], self.g00[:p, p] - theta * self.g01[:p, p], moved[p, p]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        sigma2 = float(c - beta @ b) / self.n
        logdet = float(np.sum(np.log(np.abs(1.0 - theta * self.eigen))))
        if not sigma2 > 0.0 or not math.isfinite(logdet):
            raise ArithmeticError(f"likelihood undefined at {theta!r}")
        return -(self.n / 2) * (math.log(2 * math.pi) + 1.0) - (self.n / 2) * math.log(sigma2) + logdet, beta, sigma2

    def best(self) -> float:
        """The likeliest theta: the best of a fixed grid, then ever finer grids between its neighbours."""
        lo, hi, points = -DOMAIN_BOUND, DOMAIN_BOUND, GRID_POINTS
        while True:
            grid = np.linspace(lo, hi, points)
            top = int(np.argmax([self.at(t)[0] for t in grid]))
            lo, hi, points = grid[max(top - 1, 0)], grid[min(top + 1, len(grid) - 1)], 9
            if hi - lo < 1e-13:
                return float(grid[top])

    def natural(self, beta: np.ndarray) -> list[float]:
        slopes = beta[1:] / self.scale
        return [float(beta[0] - slopes @ self.mean), *map(float, slopes)]

    def interval(self, theta: float, beta: np.ndarray, sigma2: float) -> tuple[float | None, float | None, float | None]:
        """Wald interval of theta.

        The expected information of theta left after variance and coefficients are eliminated has a closed form in
        A = W (I - theta W)^-1: tr(A^2) + tr(A'A) - 2 tr(A)^2 / n, and for a lagged outcome also the part of A X beta that the
        columns of X do not explain, over sigma^2.
        """
        if abs(theta) > DOMAIN_BOUND - 1e-6:
            return None, None, None
        a = np.linalg.solve((np.eye(len(self.w)) - theta * self.w).T, self.w.T).T
        left = float(np.sum(a * a.T) + np.sum(a * a) - 2.0 * np.trace(a) ** 2 / self.n)
        if self.family == "sar":
            pull = a @ (self.x @ beta)
            unexplained = pull - self.x @ np.linalg.lstsq(self.x, pull, rcond=None)[0]
            left += float(unexplained @ unexplained) / sigma2
        if not left > 0:
            return None, None, None
        se = left**-0.5
        return se, theta - Z_975 * se, theta + Z_975 * se


_FIT = [("theta", T.DoubleType()), ("loglik", T.DoubleType()), ("sigma2", T.DoubleType()), ("beta", T.ArrayType(T.DoubleType())),
        ("at_bound", T.BooleanType()), ("se", T.DoubleType()), ("lower", T.DoubleType()), ("upper", T.DoubleType())]


def _fits(systems: DataFrame, p: int, family: str, fold: str) -> DataFrame:
    schema = T.StructType([systems.schema[fold], *[T.StructField(n, t) for n, t in _FIT]])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                s = _System(_Row(pdf.columns, r), p, family)
                theta = s.best()
                loglik, beta, sigma2 = s.at(theta)
                rows.append((r[0], theta, loglik, sigma2, s.natural(beta), bool(abs(theta) > DOMAIN_BOUND - 1e-6), *s.interval(theta, beta, sigma2)))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return systems.mapInPandas(solve, schema)


class _Row:
    """Attribute access to one record whose column names may start with an underscore."""

    def __init__(self, names, values):
        self.__dict__.update(zip(names, values))


def _single(df: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.withColumn("_fold", F.lit(0)), edges.withColumn("_fold", F.lit(0))


def fit_spatial(df: DataFrame, edges: DataFrame, key: str, outcome: str, columns: Sequence[str], family: str) -> DataFrame:
    """One row: dependence, likelihood, variance, coefficients and Wald interval."""
    values, graph = _single(df, edges)
    return _fits(_systems(values, graph, key, outcome, columns, "_fold"), len(columns), family, "_fold").drop("_fold")


def likelihood_profile(df: DataFrame, edges: DataFrame, key: str, outcome: str, columns: Sequence[str], family: str, thetas: Sequence[float]) -> DataFrame:
    values, graph = _single(df, edges)
    systems = _systems(values, graph, key, outcome, columns, "_fold")
    p = len(columns)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                s = _System(_Row(pdf.columns, r), p, family)
                rows += [(float(t), s.at(t)[0], s.at(t)[2]) for t in thetas]
            yield pd.DataFrame(rows, columns=["theta", "loglik", "sigma2"])

    return systems.mapInPandas(solve, "theta double, loglik double, sigma2 double")


def _with_mean(df: DataFrame, model: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds the linear predictor `mean` and the dependence `theta`."""
    m = model.select(F.struct("theta", "beta").alias("m")).scalar()
    work = df.withColumn("_m", m)
    mean = F.col("_m.beta")[0]
    for i, c in enumerate(columns):
        mean = mean + F.col("_m.beta")[i + 1] * F.col(c)
    return work.withColumns({"mean": mean, "theta": F.col("_m.theta")}).drop("_m")


def fitted_quantities(df: DataFrame, edges: DataFrame, key: str, outcome: str, columns: Sequence[str], family: str) -> DataFrame:
    """Trend, structural residual, one-step fitted value and innovation per unit."""
    model = cut_lineage(fit_spatial(df, edges, key, outcome, columns, family))
    work = cut_lineage(_with_mean(df.select(key, outcome, *columns), model, columns))
    if family == "sem":
        work = work.withColumn("residual", F.col(outcome) - F.col("mean"))
        lag = lagged(work, edges, key, ["residual"])
        return lag.withColumn("one_step", F.col("mean") + F.col("theta") * F.col("lag_residual")).select(
            key, F.col("mean").alias("trend"), "residual", "one_step", (F.col(outcome) - F.col("one_step")).alias("innovation"))
    lag = lagged(work, edges, key, [outcome]).withColumn("one_step", F.col("theta") * F.col(f"lag_{outcome}") + F.col("mean"))
    trend = _solve_trend(work, edges, key)
    return lag.join(trend, key).select(key, "trend", (F.col(outcome) - F.col("trend")).alias("residual"), "one_step", (F.col(outcome) - F.col("one_step")).alias("innovation"))


def _solve_trend(work: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(I - theta W)^-1 mean for a unit table within the graph limit."""
    graph = edges.agg(F.collect_list(F.struct("i", "j", "w")).alias("e")).withColumn("_k", F.lit(1))
    rows = work.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), "mean"))).alias("r"), F.first("theta").alias("theta")).withColumn("_k", F.lit(1))

    def solve(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = [v["id"] for v in r.r]
                place = {v: i for i, v in enumerate(ids)}
                m = np.eye(len(ids))
                for e in r.e:
                    m[place[e["i"]], place[e["j"]]] -= r.theta * e["w"]
                yield pd.DataFrame({key: ids, "trend": np.linalg.solve(m, np.array([v["mean"] for v in r.r]))})

    schema = T.StructType([work.schema[key], T.StructField("trend", T.DoubleType())])
    return rows.join(graph, "_k").select("r", "theta", "e").mapInPandas(solve, schema)


def accounting(df: DataFrame, edges: DataFrame, key: str, outcome: str, columns: Sequence[str], family: str) -> DataFrame:
    """Static, dependence and innovation parts of the total sum of squares; they add to one."""
    from tesserine.operators.linear import fit

    q = fitted_quantities(df, edges, key, outcome, columns, family).join(df.select(key, outcome), key)
    static = fit(df, columns, outcome).select("r2").scalar()
    tss = F.var_pop(outcome) * F.count("*")
    inn = F.sum(F.col("innovation") * F.col("innovation")) / tss
    trend = F.sum(F.col("residual") * F.col("residual")) / tss
    parts = q.agg(inn.alias("a_innovation"), (1.0 - inn).alias("one_step_r2"), (1.0 - trend).alias("trend_r2")).withColumn("a_static", static)
    return parts.withColumn("a_dependence", 1.0 - F.col("a_static") - F.col("a_innovation"))


def filtered_shares(df: DataFrame, edges: DataFrame, key: str, outcome: str, groups: dict[str, Sequence[str]], family: str) -> DataFrame:
    """Shapley shares of the spatially filtered outcome."""
    columns = [c for cols in groups.values() for c in cols]
    theta = fit_spatial(df, edges, key, outcome, columns, family).select("theta").collect()[0][0]
    moved = [outcome, *columns] if family == "sem" else [outcome]
    filtered = spatial_filter(df.select(key, outcome, *columns), edges, key, moved, theta)
    return group_shares(cut_lineage(filtered), groups, outcome)


def cross_validated(df: DataFrame, key: str, outcome: str, columns: Sequence[str], families: Sequence[str], fold: str, k: int, folds: Sequence[int]) -> DataFrame:
    """Held-out predictions of every fold and family: graphs, fits and sink attachment in one plan.

    All folds share one pair table; a fold's training graph is the first k
    pairs per unit among the fold's training units.
    """
    if df.count() > GRAPH_LIMIT:
        raise ValueError(f"more units than the dense-graph limit of {GRAPH_LIMIT}")
    base = cut_lineage(df.select(key, outcome, "lat", "lon", F.col(fold).alias("_own"), *columns))
    pairs = near_pairs(base, key, _WHOLE_EARTH_KM)
    spread = base.withColumn("_fold", F.explode(F.array(*[F.lit(f) for f in folds])))
    train = spread.where("_own <> _fold")
    members = spread.select("_fold", F.col(key).alias("i"), (F.col("_own") == F.col("_fold")).alias("_test"))
    targets = train.select("_fold", F.col(key).alias("j"))
    nearest_k = Window.partitionBy("_fold", "i").orderBy(F.round("km", TIE_DIGITS), "j")
    links = cut_lineage(
        pairs.join(members, "i").join(targets, ["_fold", "j"]).withColumn("_r", F.row_number().over(nearest_k)).where(F.col("_r") <= k)
        .select("_fold", "i", "j", F.lit(1.0 / k).alias("w"), "_test"))
    systems = cut_lineage(_systems(train, links.where("not _test").drop("_test"), key, outcome, columns, "_fold"))
    fits = None
    for family in families:
        part = _fits(systems, len(columns), family, "_fold").select("_fold", "theta", "beta", F.lit(family).alias("family"))
        fits = part if fits is None else fits.unionByName(part)
    fits = cut_lineage(fits)
    mean = F.col("beta")[0]
    for i, c in enumerate(columns):
        mean = mean + F.col("beta")[i + 1] * F.col(c)
    placed = spread.join(fits, "_fold").withColumn("mean", mean)
    pulled = F.when(F.col("family") == "sem", F.col(outcome) - F.col("mean")).otherwise(F.col(outcome))
    source = placed.where("_own <> _fold").select("_fold", "family", F.col(key).alias("j"), pulled.alias("_s"))
    pull = (links.where("_test").join(source, ["_fold", "j"]).groupBy("_fold", "family", "i").agg(F.sum(F.col("w") * F.col("_s")).alias("_pull"))
            .withColumnRenamed("i", key))
    return placed.where("_own = _fold").join(pull, ["_fold", "family", key]).select(
        key, "family", F.col("_fold").alias("fold"), (F.col("mean") + F.col("theta") * F.col("_pull")).alias("prediction"))
