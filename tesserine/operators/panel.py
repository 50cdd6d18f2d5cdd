"""Long panels (key, month, value): climatology, anomalies, coverage gates.

Every step is an aggregate with map-side combine or a join on an aggregated
side, so a key that owns a large part of the rows never sits in one task whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.columns import decimal_decades, in_window, months_in_window


def cents(x: str) -> Column:
    """Two-decimal amounts as exact integers, so sums do not depend on row order."""
    return F.floor(F.col(x) * 100 + 0.5).cast("bigint")


def in_months(facts: DataFrame, date: str, months: tuple[dt.date, dt.date]) -> DataFrame:
    """Rows of the months from the first to the last, as a range on the raw date."""
    first, last = (m.replace(day=1) for m in months)
    after = (last + dt.timedelta(days=32)).replace(day=1)
    return facts.where((F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(after)))


def monthly_panel(
    facts: DataFrame, key: str, date: str, amount: str, scale: float = 99_991.0, months: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """One row per key and month: exact mean of `amount`, divided by a fixed unit scale.

    `months` (first and last month wanted) becomes a range on the raw date, which
    the parquet scan can skip by; a filter on the derived month could not.
    """
    if months is not None:
        facts = in_months(facts, date, months)
    month = F.trunc(F.col(date).cast("date"), "month")
    return (
        facts.groupBy(F.col(key).alias("site"), month.alias("month"))
        .agg(F.sum(cents(amount)).alias("_cents"), F.count("*").alias("n"))
        .select("site", "month", (F.col("_cents").cast("double") / F.col("n") / scale).alias("value"), "n")
    )


def climatology(
    panel: DataFrame, keys: Sequence[str], start: dt.date, end: dt.date, month: str = "month", value: str = "value"
) -> DataFrame:
    """Mean per key and calendar month over the baseline."""
    return (
        panel.where(in_window(month, start, end) & F.col(value).isNotNull())
        .groupBy(*keys, F.month(month).cast("bigint").alias("moy"))
        .agg(F.avg(value).alias("climatology"))
    )


def anomalies(
    panel: DataFrame,
    keys: Sequence[str],
    baseline: tuple[dt.date, dt.date],
    window: tuple[dt.date, dt.date],
    month: str = "month",
    value: str = "value",
) -> DataFrame:
    """Value minus the key's calendar-month baseline mean; NULL where no baseline exists."""
    base = climatology(panel, keys, *baseline, month=month, value=value)
    observed = panel.where(in_window(month, *window) & F.col(value).isNotNull()).withColumn(
        "moy", F.month(month).cast("bigint")
    )
    return observed.join(base, [*keys, "moy"], "left").withColumn(
        "anomaly", F.col(value) - F.col("climatology")
    )


def coverage(
    panel: DataFrame,
    keys: Sequence[str],
    window: tuple[dt.date, dt.date],
    min_fraction: float,
    month: str = "month",
    value: str = "value",
) -> DataFrame:
    """Observed share of the calendar months the window could hold."""
    possible = months_in_window(*window)
    return (
        panel.where(in_window(month, *window))
        .groupBy(*keys)
        .agg(F.count(value).alias("n_obs"))
        .select(
            *keys,
            "n_obs",
            F.lit(possible).cast("bigint").alias("n_possible"),
            (F.col("n_obs") / F.lit(float(possible))).alias("coverage"),
            (F.col("n_obs") / F.lit(float(possible)) >= min_fraction).alias("keep"),
        )
    )


def gated_anomalies(
    panel: DataFrame,
    keys: Sequence[str],
    baseline: tuple[dt.date, dt.date],
    window: tuple[dt.date, dt.date],
    min_fraction: float,
    month: str = "month",
    value: str = "value",
    calendar_bound: bool = False,
) -> DataFrame:
    """Anomalies of the keys that pass the coverage gate, without NULLs.

    `calendar_bound` states that (key, month) is unique, as `monthly_panel`
    guarantees: a key then holds at most one row per calendar month, and the
    whole chain runs over one scan and one shuffle on the key. Otherwise the
    baseline and the gate are aggregates joined back, which no key can skew.
    """
    if not calendar_bound:
        passed = coverage(panel, keys, window, min_fraction, month, value).where("keep").select(*keys)
        return (
            anomalies(panel, keys, baseline, window, month, value)
            .join(passed, list(keys), "left_semi")
            .where(F.col("anomaly").isNotNull())
        )
    first, last = min(baseline[0], window[0]), max(baseline[1], window[1])
    rows = panel.where(in_window(month, first, last) & F.col(value).isNotNull()).repartition(*keys)
    # Months in calendar order: keys with equal series get equal means and trends to the last bit, in every run.
    by_month = Window.partitionBy(*keys, "moy").orderBy(month).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_key = Window.partitionBy(*keys).orderBy(month).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = in_window(month, *window)
    return (
        rows.withColumn("moy", F.month(month).cast("bigint"))
        .withColumn("climatology", F.avg(F.when(in_window(month, *baseline), F.col(value))).over(by_month))
        .withColumn("_n", F.count(F.when(inside, F.col(value))).over(by_key))
        .withColumn("anomaly", F.col(value) - F.col("climatology"))
        .where(inside & (F.col("_n") / F.lit(float(months_in_window(*window))) >= min_fraction) & F.col("anomaly").isNotNull())
        .drop("_n")
    )


def ols_trend(
    series: DataFrame, keys: Sequence[str], month: str = "month", value: str = "anomaly"
) -> DataFrame:
    """Least-squares slope and intercept per key on the decade axis."""
    x = decimal_decades(month)
    return series.groupBy(*keys).agg(
        F.count(value).alias("n_obs"),
        F.regr_slope(F.col(value), x).alias("ols_slope"),
        F.regr_intercept(F.col(value), x).alias("ols_intercept"),
    )
