"""Theil-Sen slopes per key.

Series that come from `monthly_panel` hold at most one row per calendar month,
so a key is a short array: the points of a key are gathered by a partial
aggregate and the slopes are computed for whole Arrow batches of keys at once.
Keys longer than `max_points` take `long_theil_sen`, which never gathers a key:
pairs of row blocks count slopes per histogram bin, and only counts move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.session import cut_lineage

#: Two-sided 95 % standard normal quantile (fixed value).
Z_975 = 1.959963984540054
_SLOPES_PER_CHUNK = 2_000_000

_RESULT = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("slope", "low", "high", "intercept")]
    + [T.StructField("n_points", T.LongType())]
)


def rank_bounds(n_slopes: int, n: int, ties_x: Sequence[int] = (), ties_y: Sequence[int] = ()) -> tuple[int, int]:
    """Positions of the confidence bounds among the sorted slopes."""
    var = n * (n - 1) * (2 * n + 5)
    var -= sum(k * (k - 1) * (2 * k + 5) for k in ties_x)
    var -= sum(k * (k - 1) * (2 * k + 5) for k in ties_y)
    half = Z_975 * math.sqrt(max(var, 0) / 18.0)
    upper = min(int(np.round((n_slopes + half) / 2.0)), n_slopes - 1)
    lower = max(int(np.round((n_slopes - half) / 2.0)) - 1, 0)
    return lower, upper


def _tie_sizes(a: np.ndarray) -> np.ndarray:
    counts = np.unique(a, return_counts=True)[1]
    return counts[counts > 1]


def _stacked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope, bounds and intercept for K series of equal length n, shape (K, n) each."""
    k, n = x.shape
    out = np.full((k, 4), np.nan)
    if n < 2:
        return out
    i, j = np.triu_indices(n, 1)
    step = max(1, _SLOPES_PER_CHUNK // len(i))
    for at in range(0, k, step):
        xs, ys = x[at : at + step], y[at : at + step]
        dx, dy = xs[:, j] - xs[:, i], ys[:, j] - ys[:, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            slopes = np.where(dx != 0, dy / dx, np.nan)
        slopes.sort(axis=1)  # NaN (tied x) goes last
        usable = np.sum(~np.isnan(slopes), axis=1)
        for r, m in enumerate(usable):
            if m == 0:
                continue
            row = slopes[r, :m]
            low, high = rank_bounds(int(m), n, _tie_sizes(xs[r]), _tie_sizes(ys[r]))
            slope = float(np.median(row))
            out[at + r] = (slope, row[low], row[high], np.median(ys[r]) - slope * np.median(xs[r]))
    return out


@F.pandas_udf(_RESULT)
def _theil_sen_arrays(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    sizes = np.array([len(v) for v in xs])
    result = np.full((len(xs), 4), np.nan)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        x = np.stack([np.asarray(xs.iloc[r], dtype=float) for r in rows])
        y = np.stack([np.asarray(ys.iloc[r], dtype=float) for r in rows])
        result[rows] = _stacked(x, y)
    frame = pd.DataFrame(result, columns=["slope", "low", "high", "intercept"])
    frame["n_points"] = sizes
    return frame


def theil_sen(
    series: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    *,
    calendar_bound: bool = False,
    max_points: int = 4_000,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Median pairwise slope, 95 % bounds and intercept per key.

    `extra` holds further aggregates of the key's rows, taken in the same pass.

    `calendar_bound` states that (key, x) is unique on a calendar axis, which
    bounds a key's length; otherwise lengths are counted first and the long keys
    take the block path.
    """
    rows = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if calendar_bound:
        return _short(rows, keys, x, y, extra)
    lengths = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    long_keys = lengths.where(F.col("_n") > max_points)
    if long_keys.isEmpty():
        return _short(rows, keys, x, y, extra)
    short = _short(rows.join(long_keys.select(*keys), list(keys), "left_anti"), keys, x, y, extra)
    hot = rows.join(long_keys, list(keys))
    long = long_theil_sen(hot, keys, x, y, block=max_points)
    if extra:
        long = long.join(hot.groupBy(*keys).agg(*extra), list(keys))
    return short.unionByName(long)


def _short(rows: DataFrame, keys: Sequence[str], x: str, y: str, extra: Sequence[Column] = ()) -> DataFrame:
    arrays = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"), *extra
    )
    others = [c for c in arrays.columns if c not in (*keys, "p")]
    fitted = arrays.select(*keys, *others, _theil_sen_arrays(F.col("p.x"), F.col("p.y")).alias("f"))
    return fitted.select(*keys, "f.slope", "f.low", "f.high", "f.intercept", "f.n_points", *others)


# -- long keys ---------------------------------------------------------------

_BINS = 2_048


def _block_pairs(rows: DataFrame, keys: Sequence[str], x: str, y: str, block: int) -> DataFrame:
    """Rows tagged with the unordered block pairs they take part in.

    A key of n rows gets n/block blocks by hashed row id (copies spread too); a row is sent to each pair that
    holds its block, so no task ever sees more than two blocks of a key.
    """
    tagged = rows.select(
        *keys,
        F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"),
        F.ceil(F.col("_n") / block).cast("int").alias("_b"),
    ).withColumn("_own", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_other")
    return tagged.select("*", other).select(
        *keys, "_x", "_y", "_own", F.least("_own", "_other").alias("_p"), F.greatest("_own", "_other").alias("_q")
    )


def _pair_slopes(pdf: pd.DataFrame) -> np.ndarray:
    x, y, own = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_own"].to_numpy()
    p, q = int(pdf["_p"].iloc[0]), int(pdf["_q"].iloc[0])
    a = own == p
    if p == q:
        i, j = np.triu_indices(int(a.sum()), 1)
        dx, dy = x[a][j] - x[a][i], y[a][j] - y[a][i]
    else:
        b = own == q
        dx = (x[b][:, None] - x[a][None, :]).ravel()
        dy = (y[b][:, None] - y[a][None, :]).ravel()
    keep = dx != 0
    return dy[keep] / dx[keep]


def long_theil_sen(rows: DataFrame, keys: Sequence[str], x: str, y: str, block: int) -> DataFrame:
    """Exact order statistics of all pairwise slopes by histogram refinement.

    Each pass counts slopes per bin between the current edges of every wanted
    rank; the bin that holds a rank becomes its next interval, until the
    interval is one representable value wide. A pass moves counts only.
    """
    keys = list(keys)
    key_fields = [rows.schema[k] for k in keys]
    pairs = cut_lineage(_block_pairs(rows, keys, x, y, block))
    group = [*keys, "_p", "_q"]

    def extent(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _pair_slopes(pdf)
        head = pdf[keys].head(1).reset_index(drop=True)
        return head.assign(m=len(s), lo=s.min() if len(s) else np.nan, hi=s.max() if len(s) else np.nan)

    schema = T.StructType(key_fields + [
        T.StructField("m", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())
    ])
    spans = pairs.groupBy(*group).applyInPandas(extent, schema)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median(x).alias("_mx"), F.median(y).alias("_my"))
    for col, name in ((x, "_tx"), (y, "_ty")):
        ties = rows.groupBy(*keys, col).agg(F.count("*").cast("double").alias("_ties"))
        sizes = sizes.join(
            ties.groupBy(*keys).agg(F.sum(F.expr("_ties*(_ties-1)*(2*_ties+5)")).alias(name)), keys
        )
    total = spans.groupBy(*keys).agg(
        F.sum("m").alias("m"),
        F.min(F.when(~F.isnan("lo"), F.col("lo"))).alias("lo"),
        F.max(F.when(~F.isnan("hi"), F.col("hi"))).alias("hi"),
    ).where("m > 0").join(sizes, keys)
    half = F.lit(Z_975) * F.sqrt(F.greatest(
        F.expr("double(n)*(n-1)*(2*n+5)") - F.col("_tx") - F.col("_ty"), F.lit(0.0)) / 18.0)
    state = cut_lineage(total.select(
        *keys, "n", "m", "_mx", "_my", "lo", "hi",
        F.explode(F.array(
            F.struct(F.lit("a").alias("role"), F.floor((F.col("m") - 1) / 2).cast("bigint").alias("rank")),
            F.struct(F.lit("b").alias("role"), F.floor(F.col("m") / 2).cast("bigint").alias("rank")),
            F.struct(F.lit("low").alias("role"), F.greatest(
                F.bround((F.col("m") - half) / 2).cast("bigint") - 1, F.lit(0)).alias("rank")),
            F.struct(F.lit("high").alias("role"), F.least(
                F.bround((F.col("m") + half) / 2).cast("bigint"), F.col("m") - 1).alias("rank")),
        )).alias("w"),
    ).select(*keys, "n", "m", "_mx", "_my", "lo", "hi", "w.role", "w.rank", F.lit(0).cast("bigint").alias("below")))

    count_schema = T.StructType(key_fields + [
        T.StructField("role", T.StringType()), T.StructField("bin", T.IntegerType()),
        T.StructField("c", T.LongType()), T.StructField("bmin", T.DoubleType()), T.StructField("bmax", T.DoubleType()),
    ])

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _pair_slopes(pdf)
        frames = []
        for t in pdf["_targets"].iloc[0]:
            inside = s[(s >= t["lo"]) & (s <= t["hi"])]
            if not len(inside):
                continue
            at = np.minimum(((inside - t["lo"]) / (t["hi"] - t["lo"]) * _BINS).astype(int), _BINS - 1)
            grouped = pd.Series(inside).groupby(at).agg(["size", "min", "max"]).reset_index()
            grouped.columns = ["bin", "c", "bmin", "bmax"]
            for k in keys:
                grouped[k] = pdf[k].iloc[0]
            frames.append(grouped.assign(role=t["role"]))
        cols = [f.name for f in count_schema]
        return pd.concat(frames)[cols] if frames else pd.DataFrame(columns=cols)

    while not state.where("lo < hi").isEmpty():
        open_targets = state.where("lo < hi")
        # Four targets per long key ride along with its rows.
        targets = open_targets.groupBy(*keys).agg(F.collect_list(F.struct("role", "lo", "hi")).alias("_targets"))
        counts = (
            pairs.join(targets, keys).groupBy(*group).applyInPandas(counted, count_schema)
            .groupBy(*keys, "role", "bin").agg(F.sum("c").alias("c"), F.min("bmin").alias("bmin"), F.max("bmax").alias("bmax"))
        )
        # At most _BINS rows per key and role reach this window.
        w = Window.partitionBy(*keys, "role").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        cumulated = counts.withColumn("upto", F.sum("c").over(w))
        chosen = (
            cumulated.join(open_targets, [*keys, "role"])
            .where((F.col("below") + F.col("upto") > F.col("rank")) & (F.col("below") + F.col("upto") - F.col("c") <= F.col("rank")))
            .select(*keys, "n", "m", "_mx", "_my", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"), "role", "rank",
                    (F.col("below") + F.col("upto") - F.col("c")).alias("below"))
        )
        state = cut_lineage(state.where("lo >= hi").unionByName(chosen))
    return (
        state.groupBy(*keys, "n", "_mx", "_my")
        .agg(*[F.max(F.when(F.col("role") == r, F.col("lo"))).alias(f"_{r}") for r in ("a", "b", "low", "high")])
        .withColumn("slope", (F.col("_a") + F.col("_b")) / 2)
        .select(*keys, "slope", F.col("_low").alias("low"), F.col("_high").alias("high"),
                (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), F.col("n").alias("n_points"))
    )
