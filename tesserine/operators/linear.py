"""Least squares from distributed cross-product sums.

Rows never leave Spark: one aggregate yields the cross products of all design
columns (per group where asked), and only that p x p matrix, bounded by the
number of columns, is solved inside a task. Columns are centred and scaled
before the products are formed, so solving does not square a large condition
number.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions.distributions import normal_two_sided
from tesserine.operators.robust import Z_975

_RCOND = 1e-11


def dummy_columns(df: DataFrame, feature: str, levels: Sequence[str]) -> dict[str, Column]:
    """Indicator columns of the sorted levels, first level dropped."""
    return {f"{feature}={v}": (F.col(feature) == v).cast("double") for v in sorted(levels)[1:]}


def feature_levels(df: DataFrame, feature: str, limit: int = 1_000) -> list[str]:
    """Sorted levels of a categorical feature; refuses features that are not categorical in size."""
    rows = df.select(feature).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{feature} has more than {limit} levels")
    return sorted(str(r[0]) for r in rows if r[0] is not None)


def standardised(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, Column]:
    """Centred and scaled copies of the columns, plus the moments as one struct."""
    moments = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).alias("t")).scalar()
    scaled = df.select(*keep, *[
        ((F.col(c) - moments[c]["m"]) / F.when(moments[c]["s"] > 0, moments[c]["s"]).otherwise(1.0)).alias(c) for c in columns])
    return scaled, moments


def gram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Cross products of (1, columns): `n` and the upper triangle `g` row by row, per group."""
    terms: list[Column] = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    w = F.lit(1.0) if weight is None else weight
    cells = [F.sum(w * terms[a] * terms[b]) for a in range(len(terms)) for b in range(a, len(terms))]
    return df.groupBy(*by).agg(F.sum(w).alias("n"), F.array(*cells).alias("g"))


def unpack(values: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = values
    return out + np.triu(out, 1).T


def subset_r2(g: np.ndarray, chosen: Sequence[int], y: int) -> float:
    """R2 of y on an intercept and the chosen columns (least-norm where rank deficient)."""
    n = g[0, 0]
    tss = g[y, y] - g[0, y] ** 2 / n
    if not chosen or tss <= 0:
        return 0.0
    idx = list(chosen)
    mean = g[0, idx] / n
    s = g[np.ix_(idx, idx)] - n * np.outer(mean, mean)
    c = g[idx, y] - n * mean * g[0, y] / n
    scale = np.sqrt(np.clip(np.diag(s), 0, None))
    scale[scale == 0] = 1.0
    beta = np.linalg.pinv(s / np.outer(scale, scale), rcond=_RCOND, hermitian=True) @ (c / scale)
    return float(beta @ (c / scale) / tss)


def coefficients(g: np.ndarray, chosen: Sequence[int], y: int) -> tuple[np.ndarray, np.ndarray]:
    """(intercept, slopes) and the pseudo-inverse of the cross products."""
    idx = [0, *chosen]
    s = g[np.ix_(idx, idx)]
    scale = np.sqrt(np.diag(s))
    scale[scale == 0] = 1.0
    inv = np.linalg.pinv(s / np.outer(scale, scale), rcond=_RCOND, hermitian=True) / np.outer(scale, scale)
    return inv @ g[idx, y], inv


def shapley_weight(size: int, groups: int) -> float:
    return math.factorial(size) * math.factorial(groups - size - 1) / math.factorial(groups)


def lmg(g: np.ndarray, groups: dict[str, Sequence[int]], y: int) -> dict[str, float]:
    """Shapley shares of R2 over all coalitions of column groups, plus the residual share."""
    names = list(groups)
    r2: dict[frozenset, float] = {}
    for size in range(len(names) + 1):
        for combo in itertools.combinations(names, size):
            r2[frozenset(combo)] = subset_r2(g, [c for name in combo for c in groups[name]], y)
    shares = {}
    for name in names:
        rest = [o for o in names if o != name]
        shares[name] = sum(
            shapley_weight(size, len(names)) * (r2[frozenset(combo) | {name}] - r2[frozenset(combo)])
            for size in range(len(rest) + 1) for combo in itertools.combinations(rest, size))
    shares["residual"] = 1.0 - r2[frozenset(names)]
    if abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ArithmeticError(f"shares sum to {sum(shares.values())!r}")
    return shares


def group_shares(df: DataFrame, groups: dict[str, Sequence[str]], outcome: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Long table (by..., group, share): one row per column group and the residual.

    With `by`, each group of rows (a bootstrap draw, a fold) contributes one
    matrix; the matrices are solved in Arrow batches spread over the cluster.
    """
    by = list(by)
    columns = [c for cols in groups.values() for c in cols]
    needed = [*columns, outcome]
    complete = df.dropna(subset=needed)
    scaled, _ = standardised(complete, needed, keep=[c for c in df.columns if c not in needed])
    sums = gram(scaled, needed, by, weight)
    at = {c: i + 1 for i, c in enumerate(needed)}
    index = {name: [at[c] for c in cols] for name, cols in groups.items()}
    p, y = len(needed) + 1, at[outcome]
    schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("group", T.StringType()), T.StructField("share", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for name, share in lmg(unpack(r.g, p), index, y).items():
                    rows.append((*[getattr(r, c) for c in by], name, share))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return sums.mapInPandas(solve, schema)


def coalition_table(df: DataFrame, groups: dict[str, Sequence[str]], outcome: str) -> DataFrame:
    """R2 of every coalition of column groups."""
    columns = [c for cols in groups.values() for c in cols]
    needed = [*columns, outcome]
    scaled, _ = standardised(df.dropna(subset=needed), needed)
    at = {c: i + 1 for i, c in enumerate(needed)}
    p = len(needed) + 1

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = unpack(r.g, p)
                for size in range(len(groups) + 1):
                    for combo in itertools.combinations(groups, size):
                        rows.append(("+".join(combo), subset_r2(g, [at[c] for name in combo for c in groups[name]], at[outcome])))
            yield pd.DataFrame(rows, columns=["coalition", "r2"])

    return gram(scaled, needed).mapInPandas(solve, "coalition string, r2 double")


def partial_r2(df: DataFrame, terms: dict[str, Sequence[str]], outcome: str) -> DataFrame:
    """(R2 full - R2 without the terms) / (1 - R2 without them), on the same rows."""
    columns = [c for cols in terms.values() for c in cols]
    needed = [*columns, outcome]
    scaled, _ = standardised(df.dropna(subset=needed), needed)
    at = {c: i + 1 for i, c in enumerate(needed)}
    p = len(needed) + 1

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = unpack(r.g, p)
                full = subset_r2(g, [at[c] for c in columns], at[outcome])
                for name, cols in terms.items():
                    less = subset_r2(g, [at[c] for c in columns if c not in cols], at[outcome])
                    rows.append((name, full, (full - less) / (1.0 - less)))
            yield pd.DataFrame(rows, columns=["term", "r2_full", "partial_r2"])

    return gram(scaled, needed).mapInPandas(solve, "term string, r2_full double, partial_r2 double")


def fit(df: DataFrame, columns: Sequence[str], outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., beta array of intercept and slopes, r2, n) in natural units."""
    by = list(by)
    needed = [*columns, outcome]
    complete = df.dropna(subset=needed)
    scaled, moments = standardised(complete, needed, keep=by)
    sums = gram(scaled, needed, by).withColumn("_m", F.array(*[moments[c]["m"] for c in needed])).withColumn(
        "_s", F.array(*[F.when(moments[c]["s"] > 0, moments[c]["s"]).otherwise(1.0) for c in needed]))
    p = len(needed) + 1
    schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("beta", T.ArrayType(T.DoubleType())),
                           T.StructField("r2", T.DoubleType()), T.StructField("n", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g, m, s = unpack(r.g, p), np.asarray(r._m if hasattr(r, "_m") else r[-2]), np.asarray(r[-1])
                chosen = list(range(1, p - 1))
                beta, _ = coefficients(g, chosen, p - 1)
                slopes = beta[1:] * s[-1] / s[:-1]
                intercept = m[-1] + beta[0] * s[-1] - float(slopes @ m[:-1])
                rows.append((*[getattr(r, c) for c in by], [float(intercept), *map(float, slopes)], subset_r2(g, chosen, p - 1), float(r.n)))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return sums.mapInPandas(solve, schema)


def predicted(beta: Column, columns: Sequence[str]) -> Column:
    """Linear predictor from a beta array column."""
    value = beta[0]
    for i, c in enumerate(columns):
        value = value + beta[i + 1] * F.col(c)
    return value


def robust_terms(df: DataFrame, columns: Sequence[str], outcome: str, cluster: str | None = None) -> DataFrame:
    """Coefficients with HC1 or cluster-robust errors, normal p and 95 % interval.

    Second pass: cross products weighted by squared residuals, or the products
    of score sums per cluster; both are aggregates of the same small size.
    """
    needed = [*columns, outcome]
    complete = df.dropna(subset=needed)
    model = fit(complete, columns, outcome)
    beta = model.select("beta").scalar()
    work = complete.withColumn("_e", F.col(outcome) - predicted(beta, columns))
    p = len(columns) + 1
    bread = gram(work, columns)
    if cluster is None:
        meat = gram(work, columns, weight=F.col("_e") * F.col("_e")).select(F.col("g").alias("meat"), F.lit(0.0).alias("n_groups"))
    else:
        scores = work.groupBy(cluster).agg(F.sum("_e").alias("_s0"), *[F.sum(F.col("_e") * F.col(c)).alias(f"_s{i + 1}") for i, c in enumerate(columns)])
        cells = [F.sum(F.col(f"_s{a}") * F.col(f"_s{b}")) for a in range(p) for b in range(a, p)]
        meat = scores.agg(F.array(*cells).alias("meat"), F.count("*").cast("double").alias("n_groups"))
    joined = bread.withColumn("_k", F.lit(1)).join(meat.withColumn("_k", F.lit(1)), "_k").join(model.select("beta", "r2").withColumn("_k", F.lit(1)), "_k")
    names = ["intercept", *columns]
    schema = "term string, coef double, se double, z double, p double, ci_low double, ci_high double, r2 double, n double"

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                xtx, m, n = unpack(r.g, p), unpack(r.meat, p), float(r.n)
                scale = np.sqrt(np.diag(xtx))
                inv = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=_RCOND, hermitian=True) / np.outer(scale, scale)
                factor = n / (n - p) if cluster is None else r.n_groups / (r.n_groups - 1) * (n - 1) / (n - p)
                cov = factor * inv @ m @ inv
                for i, name in enumerate(names):
                    se = math.sqrt(max(cov[i, i], 0.0))
                    z = r.beta[i] / se if se > 0 else float("nan")
                    rows.append((name, float(r.beta[i]), se, z, normal_two_sided(z), r.beta[i] - Z_975 * se, r.beta[i] + Z_975 * se, float(r.r2), n))
            yield pd.DataFrame(rows, columns=["term", "coef", "se", "z", "p", "ci_low", "ci_high", "r2", "n"])

    return joined.mapInPandas(solve, schema)


def influence(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Fitted value, residual, leverage, studentised residual and Cook's distance per row.

    The pseudo-inverse of the scaled cross products is one small array that every
    row reads; leverage is a quadratic form inside the projection.
    """
    needed = [*columns, outcome]
    complete = df.dropna(subset=needed)
    keep = [c for c in df.columns if c not in columns]
    scaled, _ = standardised(complete, columns, keep=keep)
    p = len(columns) + 1

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = unpack(r.g, p + 1)
                beta, inv = coefficients(g, list(range(1, p)), p)
                s = g[:p, :p]
                d = np.sqrt(np.diag(s))
                d[d == 0] = 1.0
                rank = int(np.linalg.matrix_rank(s / np.outer(d, d), tol=_RCOND * p, hermitian=True))
                out.append((list(map(float, beta)), list(map(float, inv.ravel())), float(rank), float(r.n)))
            yield pd.DataFrame(out, columns=["beta", "inv", "rank", "n"])

    solved = gram(scaled, [*columns, outcome]).mapInPandas(solve, "beta array<double>, inv array<double>, rank double, n double")
    m = solved.select(F.struct("beta", "inv", "rank", "n").alias("m")).scalar()
    work = scaled.withColumn("_m", m).withColumn("_x", F.array(F.lit(1.0), *[F.col(c) for c in columns]))
    inv, x = F.col("_m.inv"), F.col("_x")
    h = F.lit(0.0)
    fitted = F.lit(0.0)
    for a in range(p):
        fitted = fitted + F.col("_m.beta")[a] * x[a]
        for b in range(p):
            h = h + x[a] * inv[a * p + b] * x[b]
    work = work.withColumns({"fitted": fitted, "leverage": h}).withColumn("residual", F.col(outcome) - F.col("fitted"))
    rss = work.agg(F.sum(F.col("residual") * F.col("residual"))).scalar()
    free = F.greatest(1.0 - F.col("leverage"), F.lit(1e-12))
    dof = F.col("_m.n") - F.col("_m.rank")
    sigma2 = rss / dof
    own = F.greatest((rss - F.col("residual") * F.col("residual") / free) / (dof - 1), F.lit(1e-18))
    exact = F.col("leverage") > 1 - 1e-8
    return work.withColumns({
        "studentized": F.when(~exact, F.col("residual") / F.sqrt(own * free)),
        "cooks_d": F.when(~exact, F.col("residual") * F.col("residual") / (F.col("_m.rank") * sigma2) * F.col("leverage") / (free * free)),
    }).drop("_m", "_x")


def redundancy(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """How well the design predicts one more column: R2, adjusted R2, VIF, ranks, condition numbers."""
    needed = [*columns, target]
    complete = df.dropna(subset=needed)
    scaled, _ = standardised(complete, needed)
    p = len(columns) + 1
    raw = gram(complete, columns).select(F.col("g").alias("raw"), F.lit(1).alias("_k"))
    joined = gram(scaled, needed).withColumn("_k", F.lit(1)).join(raw, "_k")

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g, raw_g, n = unpack(r.g, p + 1), unpack(r.raw, p), float(r.n)
                r2 = subset_r2(g, list(range(1, p)), p)
                rank = int(np.linalg.matrix_rank(g[:p, :p], tol=_RCOND * n, hermitian=True))
                both = int(np.linalg.matrix_rank(g, tol=_RCOND * n, hermitian=True))
                d = np.sqrt(np.diag(raw_g))
                unit = np.linalg.eigvalsh(raw_g / np.outer(d, d))
                natural = np.linalg.eigvalsh(raw_g)
                def cond(v):
                    return float(math.sqrt(v[-1] / v[0])) if v[0] > 0 else float("inf")
                rows.append((r2, 1 - (1 - r2) * (n - 1) / (n - rank), 1 / (1 - r2) if r2 < 1 else None, rank, both, cond(natural), cond(unit)))
            yield pd.DataFrame(rows, columns=["r2", "adjusted_r2", "vif", "rank", "rank_with_target", "cond_raw", "cond_unit"])

    return joined.mapInPandas(solve, "r2 double, adjusted_r2 double, vif double, rank int, rank_with_target int, cond_raw double, cond_unit double")


def fold_predictions(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], levels: dict[str, Sequence[str]],
                     outcome: str, fold: str) -> DataFrame:
    """Predictions per fold; a category level unseen in training gets the mean effect of the trained levels.

    `levels` lists every level of the whole table. One cross-product matrix per
    fold is formed in a single aggregate and solved in parallel.
    """
    all_dummies = [(c, v) for c in categorical for v in sorted(levels[c])]
    names = [f"_d{i}" for i in range(len(all_dummies))]
    def coded(df: DataFrame) -> DataFrame:
        return df.withColumns({n: (F.col(c) == v).cast("double") for n, (c, v) in zip(names, all_dummies)})
    needed = [*numeric, *names, outcome]
    sums = gram(coded(train.dropna(subset=[*numeric, *categorical, outcome])), needed, [fold])
    p = len(needed) + 1
    position = {c: [1 + len(numeric) + i for i, (f, _) in enumerate(all_dummies) if f == c] for c in categorical}

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = unpack(r.g, p)
                n = g[0, 0]
                chosen, effects = list(range(1, 1 + len(numeric))), np.zeros(p)
                for c in categorical:
                    seen = [i for i in position[c] if g[i, i] > 0]
                    chosen += seen[1:]
                beta, _ = coefficients(_centred_numeric(g, len(numeric)), chosen, p - 1)
                effects[0] = beta[0]
                for i, b in zip(chosen, beta[1:]):
                    effects[i] = b
                if len(numeric):
                    effects[0] -= float(sum(effects[i] * g[0, i] / n for i in range(1, 1 + len(numeric))))
                for c in categorical:
                    seen = [i for i in position[c] if g[i, i] > 0]
                    mean = float(np.mean([0.0, *[effects[i] for i in seen[1:]]])) if seen else 0.0
                    for i in position[c]:
                        if g[i, i] == 0:
                            effects[i] = mean
                rows.append((getattr(r, fold), list(map(float, effects[:-1])), float(n)))
            yield pd.DataFrame(rows, columns=[fold, "beta", "n_train"])

    schema = T.StructType([sums.schema[fold], T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("n_train", T.DoubleType())])
    solved = sums.mapInPandas(solve, schema)
    design = [*numeric, *names]
    return coded(test).join(solved, fold).withColumn("prediction", predicted(F.col("beta"), design)).drop("beta", *names)


def _centred_numeric(g: np.ndarray, k: int) -> np.ndarray:
    """Cross products after subtracting the mean of the first k columns."""
    if not k:
        return g
    n = g[0, 0]
    shift = np.eye(len(g))
    for i in range(1, k + 1):
        shift[i, 0] = -g[0, i] / n
    return shift @ g @ shift.T
