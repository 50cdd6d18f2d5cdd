"""Inequality indices as aggregates; ordered ones read `value_positions`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.ordering import value_positions, with_rank
from tesserine.operators.tables import pair_corr


def dispersion(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """n, mean, population variance and coefficient of variation."""
    x = F.col(value)
    w = F.lit(1.0) if weight is None else weight
    mean = F.sum(w * x) / F.sum(w)
    if weight is None:
        var = F.var_pop(value)
    else:  # sums about a value of the column, so that a large mean does not swallow a small spread
        start = df.agg(F.avg(value)).scalar()
        shift = F.sum(w * (x - start)) / F.sum(w)
        var = F.greatest(F.sum(w * (x - start) * (x - start)) / F.sum(w) - shift * shift, F.lit(0.0))
    return df.agg(F.count(value).alias("n"), mean.alias("mean"), var.alias("variance"),
                  (F.sqrt(var) / F.nullif(mean, F.lit(0.0))).alias("cv"))


def gini(df: DataFrame, value: str, weight: Column | None = None, max_rows: int | None = None) -> DataFrame:
    """Half the relative mean absolute difference, from cumulative weights in one ordered pass."""
    w = F.lit(1.0) if weight is None else weight
    pos = value_positions(df, value, {"w": w}, max_rows=max_rows)
    x = F.col(value)
    ordered = F.sum(F.col("w") * x * (2.0 * F.col("cum_w") - F.col("w") - F.col("all_w")))
    return pos.agg((ordered / F.nullif(F.max("all_w") * F.sum(F.col("w") * x), F.lit(0.0))).alias("gini"))


def _theil_parts(value: str, weight: Column | None) -> list[Column]:
    x = F.col(value)
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * x * F.ln(x)).alias("_l")]


def theil(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """Theil-T in one pass: sum(wx ln x)/sum(wx) - ln(mean)."""
    return df.agg(*_theil_parts(value, weight)).select((F.col("_l") / F.col("_x") - F.ln(F.col("_x") / F.col("_w"))).alias("theil"))


def theil_by_group(df: DataFrame, value: str, group: str, weight: Column | None = None) -> DataFrame:
    """Per group: share of the magnitude, within term and between term."""
    parts = df.groupBy(group).agg(*_theil_parts(value, weight))
    whole = df.agg(*_theil_parts(value, weight)).select(F.struct("_w", "_x").alias("t")).scalar()
    share = F.col("_x") / whole["_x"]
    mean = F.col("_x") / F.col("_w")
    return parts.select(
        group, share.alias("share"), (share * (F.col("_l") / F.col("_x") - F.ln(mean))).alias("within"),
        (share * F.ln(mean / (whole["_x"] / whole["_w"]))).alias("between"))


def lorenz_points(df: DataFrame, value: str, weight: Column | None = None, max_rows: int | None = None) -> DataFrame:
    """Cumulative unit and magnitude shares, one point per row plus the origin.

    Rows of one value lie on a straight segment: they share its weight evenly, so their order does not matter.
    """
    w = F.lit(1.0) if weight is None else weight
    pos = value_positions(df, value, {"w": w, "wx": w * F.col(value), "rows": F.lit(1)}, max_rows=max_rows)
    each = pos.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1))).withColumn("_left", F.col("_k") / F.col("rows"))
    points = each.select(((F.col("cum_w") - F.col("w") * F.col("_left")) / F.col("all_w")).alias("unit_share"),
                         ((F.col("cum_wx") - F.col("wx") * F.col("_left")) / F.col("all_wx")).alias("value_share"))
    origin = df.limit(1).select(F.lit(0.0).alias("unit_share"), F.lit(0.0).alias("value_share"))
    return origin.unionByName(points)


def concentration_coefficient(df: DataFrame, order: str, impact: str, max_rows: int | None = None) -> DataFrame:
    """Twice the area between the diagonal and the curve ordered by `order` only, in [0, 1].

    Rows that share an order value lie on one straight segment.
    """
    positive = df.where((F.col(order) > 0) & (F.col(impact) > 0))
    pos = value_positions(positive, order, {"r": F.col(order), "y": F.col(impact)}, max_rows=max_rows)
    strip = (F.col("r") / F.col("all_r")) * (2.0 * F.col("cum_y") - F.col("y")) / F.col("all_y") / 2.0
    return pos.agg(F.least(F.greatest(F.abs(1.0 - 2.0 * F.sum(strip)), F.lit(0.0)), F.lit(1.0)).alias("coefficient"))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None, min_n: int = 3, max_rows: int | None = None) -> DataFrame:
    """Rank correlation over complete pairs; NULL with a reason when undefined."""
    by = by or []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = with_rank(with_rank(pairs, "_a", "_ra", "average", by=by, max_rows=max_rows), "_b", "_rb", "average", by=by, max_rows=max_rows)
    rho = pair_corr(F.col("_ra"), F.col("_rb"))
    n = F.count("*")
    return ranked.groupBy(*by).agg(
        n.alias("n"), F.when(n >= min_n, rho).alias("rho"),
        F.when(n < min_n, "insufficient_finite_pairs").when(rho.isNull(), "constant_input").alias("reason"))
