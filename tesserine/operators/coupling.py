"""Responsibility-impact comparison and stratified gradients."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.inequality import concentration_coefficient, spearman
from tesserine.operators.ordering import row_ids, row_ids_within, with_rank
from tesserine.operators.tables import pair_corr
from tesserine.session import cut_lineage

#: Two-sided comparisons of permuted statistics tolerate summation noise.
TIE_EPSILON = 1e-12


def require_columns(df: DataFrame, admissible: Iterable[str]) -> DataFrame:
    """The frame must hold exactly the admissible columns."""
    wanted, have = set(admissible), list(df.columns)
    extra = sorted(set(have) - wanted)
    if extra:
        raise ValueError(f"columns outside the contract: {extra}")
    missing = sorted(wanted - set(have))
    if missing:
        raise ValueError(f"columns missing from the contract: {missing}")
    return df


def zscore_gap(df: DataFrame, x: str, y: str) -> Column:
    """z(y) - z(x) with population deviations."""
    m = df.agg(F.struct(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy")).alias("m")).scalar()
    return (F.col(y) - m["my"]) / F.nullif(m["sy"], F.lit(0.0)) - (F.col(x) - m["mx"]) / F.nullif(m["sx"], F.lit(0.0))


def coupling_table(df: DataFrame, x: str, y: str, max_rows: int | None = None) -> DataFrame:
    """Ranks, rank gap and z gap of impact `y` against responsibility `x`."""
    gap = zscore_gap(df, x, y)
    ranked = with_rank(df.withColumn("z_gap", gap), x, "responsibility_rank", descending=True, max_rows=max_rows)
    ranked = with_rank(ranked, y, "impact_rank", descending=True, max_rows=max_rows)
    return ranked.withColumn("rank_gap", F.col("impact_rank") - F.col("responsibility_rank"))


def coupling_summary(df: DataFrame, x: str, y: str, max_rows: int | None = None) -> DataFrame:
    """One row: rank correlation, number of positive z gaps, concentration coefficient."""
    rho = spearman(df, x, y, max_rows=max_rows).select("rho")
    coefficient = concentration_coefficient(df, x, y, max_rows)
    gap = zscore_gap(df, x, y)
    return df.agg(
        F.count("*").alias("n"), F.count_if(gap > 0).alias("n_high_impact"), F.first(rho.scalar()).alias("rho"),
        F.first(coefficient.scalar()).alias("coefficient"))


def gap_leaders(df: DataFrame, label: str, x: str, y: str, n: int = 10) -> DataFrame:
    """The n largest and n smallest z gaps; ties by label."""
    gaps = df.select(F.col(label).alias("label"), zscore_gap(df, x, y).alias("z_gap"))
    top = gaps.orderBy(F.desc("z_gap"), F.desc("label")).limit(n).withColumn("side", F.lit("suffers most, causes least"))
    low = gaps.orderBy("z_gap", "label").limit(n).withColumn("side", F.lit("causes most, suffers least"))
    return top.unionByName(low)


def permuted(units: DataFrame, key: str, value: str, draws: int, seed: int, max_rows: int | None = None) -> DataFrame:
    """(draw, key, permuted value): each draw is a permutation given by digest order.

    Unit tables with a proven bound are ordered by a window inside the draw, others
    by one range-partitioned order over all draws.
    """
    indexed = row_ids(units.select(key, value), [key], "_i", max_rows)
    spread = indexed.select(key, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("draw"), F.col(key)))
    placed = row_ids_within(spread.withColumn("_digest", digest), "draw", ["_digest", key], "_i", max_rows)
    return placed.join(indexed.select("_i", F.col(value).alias("permuted")), "_i").select("draw", key, "permuted")


def spearman_gradient(df: DataFrame, key: str, value: str, ordinal: str, draws: int = 999, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """rho, n and label-permutation p (tail on |rho|), with a reason when undefined."""
    pairs = df.where(F.col(value).isNotNull() & F.col(ordinal).isNotNull()).select(key, value, ordinal)
    ranked = with_rank(with_rank(pairs, value, "_rv", "average", max_rows=max_rows), ordinal, "_ro", "average", max_rows=max_rows)
    observed = spearman(pairs, value, ordinal, max_rows=max_rows)
    shuffled = permuted(ranked, key, "_ro", draws, seed, max_rows).join(ranked.select(key, "_rv"), key)
    rhos = shuffled.groupBy("draw").agg(pair_corr(F.col("_rv"), F.col("permuted")).alias("r"))
    rho = observed.select("rho").scalar()
    p = rhos.agg(((F.count_if(F.abs("r") >= F.abs(rho) - TIE_EPSILON) + 1) / F.lit(draws + 1.0)).alias("p"))
    return observed.withColumn("p_permutation", F.when(F.col("rho").isNotNull(), p.scalar()))


def gradient_verdict(first: DataFrame, second: DataFrame, direction: int, alpha: float = 0.05) -> DataFrame:
    """Verdict on a responsibility gradient and a warming gradient.

    direction +1: responsibility rises and warming is weaker and not significant;
    direction -1: responsibility falls and warming is not significantly lower.
    Missing evidence never counts as support.
    """
    a = first.select(F.col("rho").alias("r_rho"), F.col("p_permutation").alias("r_p"), F.col("reason").alias("r_reason"), F.lit(1).alias("_k"))
    b = second.select(F.col("rho").alias("a_rho"), F.col("p_permutation").alias("a_p"), F.col("reason").alias("a_reason"), F.lit(1).alias("_k"))
    both = a.join(b, "_k").drop("_k")
    complete = F.col("r_rho").isNotNull() & F.col("r_p").isNotNull() & F.col("a_rho").isNotNull() & F.col("a_p").isNotNull()
    leg1 = (F.col("r_rho") * direction > 0) & (F.col("r_p") < alpha)
    leg2 = ((F.abs("a_rho") < F.abs("r_rho")) & (F.col("a_p") >= alpha)) if direction > 0 else ((F.col("a_rho") >= 0) | (F.col("a_p") >= alpha))
    reasons = F.filter(F.array(
        F.when(F.col("r_rho").isNull(), "responsibility.rho"), F.when(F.col("r_p").isNull(), "responsibility.p_permutation"),
        F.when(F.col("a_rho").isNull(), "area.rho"), F.when(F.col("a_p").isNull(), "area.p_permutation"),
        F.concat(F.lit("responsibility: "), "r_reason"), F.concat(F.lit("area: "), "a_reason")), lambda r: r.isNotNull())
    return both.select(
        "r_rho", "r_p", "a_rho", "a_p", (complete & leg1 & leg2).alias("holds"),
        F.when(~complete, "insufficient_evidence").when(leg1 & leg2, "supported").otherwise("not_supported").alias("status"),
        F.array_join(reasons, "; ").alias("reasons"))


def bh_adjust(df: DataFrame, p: str, name: str, max_rows: int | None = None) -> DataFrame:
    """False-discovery-rate adjusted p: the smallest p*n/rank at or above each rank."""
    from tesserine.operators.ordering import suffix_min, value_positions

    df = cut_lineage(df)  # joined back on p, which must be the same number on both sides
    pos = value_positions(df, p, max_rows=max_rows).withColumn("_cand", F.col(p) * F.col("n_all") / (F.col("n_lt") + F.col("n_eq")))
    adjusted = suffix_min(pos, p, "_cand", name, max_rows).withColumn(name, F.least(name, F.lit(1.0)))
    return df.join(adjusted.select(p, name), p)
