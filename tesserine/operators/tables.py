"""Table-level building blocks: weighted means, guarded correlation, vintages, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over rows where both are present; NULL without positive weight."""
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))


def weighted_mean_or_plain(value: Column, weight: Column) -> Column:
    """Weighted by positive weights; the plain mean where a group has none."""
    usable = F.when(weight > 0, weight).otherwise(0.0)
    return F.coalesce(F.sum(usable * value) / F.nullif(F.sum(usable), F.lit(0.0)), F.avg(value))


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson r over complete pairs; NULL (not an error) when either side is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def years_of(df: DataFrame, column: str) -> list[int]:
    """The years a column holds, in order: as many values as the calendar has years."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect() if r[0] is not None]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order, by partial aggregation."""
    packed = F.min_by(F.struct(*take), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    packed = F.max_by(F.struct(*take), F.struct(*order))
    return df.groupBy(*keys).agg(packed.alias("_r")).select(*keys, "_r.*")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Refuse a side of a one-to-one join that repeats a key."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"key {list(keys)} is not unique")
    return df


def modal(value: str) -> Column:
    """Most frequent value, smallest on ties."""
    return F.mode(F.col(value), True)


def orphans(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def vintage_comparison(old: DataFrame, new: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Full outer comparison of two vintages: change and status per metric."""
    a = old.select(key, *[F.col(m).alias(f"{m}_old") for m in metrics], F.lit(True).alias("_a"))
    b = new.select(key, *[F.col(m).alias(f"{m}_new") for m in metrics], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    out = both.withColumn("presence", F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both"))
    for m in metrics:
        o, n = F.col(f"{m}_old"), F.col(f"{m}_new")
        out = out.withColumns({
            f"{m}_change": n - o,
            f"{m}_status": F.when(o.isNull() & n.isNull(), "missing").when(o.isNull(), "added").when(n.isNull(), "removed")
            .when(o == n, "unchanged").otherwise("revised")})
    return out.drop("_a", "_b")


def quartile_of(value: Column, edges: Sequence[Column]) -> Column:
    """Right-closed bins: 0 below the first edge, counting upward."""
    label = F.when(value.isNull(), None)
    for i, edge in enumerate(edges):
        label = label.when(value <= edge, i)
    return label.otherwise(len(edges)).cast("bigint")


def null_rate(*names: str) -> list[Column]:
    return [F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names]
