"""Analytic views of the driver tables: sites, monthly panel, unit table, grid cells, daily series.

Facts are always reduced by a partial aggregate on their own key before they
meet a dimension, so joins move aggregated rows and a hot key collapses early.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.columns import decimal_decades
from tesserine.operators.panel import cents, gated_anomalies, in_months, monthly_panel, ols_trend

BASELINE = (dt.date(1996, 1, 1), dt.date(1998, 12, 1))
WINDOW = (dt.date(1995, 2, 1), dt.date(2001, 10, 1))
MIN_COVERAGE = 0.9
CUTOFF_YEAR = 2000
CONSUMPTION_START = 1997


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def unit_bound(spark: SparkSession, sf: str) -> int:
    """Proven row bound of every unit-level table: the size of the nation dimension."""
    return table(spark, sf, "nation").count()


def sites(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("site"),
        F.col("s_nationkey").cast("bigint").alias("nk"),
        (k * 37 % 171 - 85).cast("double").alias("lat"),
        (k * 97 % 360 - 180).cast("double").alias("lon"),
        F.col("s_acctbal").alias("acct"),
    )


def units(spark, sf) -> DataFrame:
    region = table(spark, sf, "region")
    return (
        table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").cast("bigint").alias("nk"), F.col("n_name").alias("unit"), F.col("r_name").alias("zone"))
    )


def panel(spark, sf, months=None) -> DataFrame:
    return monthly_panel(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice", months=months)


def anom(spark, sf) -> DataFrame:
    return gated_anomalies(panel(spark, sf, WINDOW), ["site"], BASELINE, WINDOW, MIN_COVERAGE, calendar_bound=True).withColumn(
        "x", decimal_decades("month")
    )


def trend(spark, sf) -> DataFrame:
    return ols_trend(anom(spark, sf), ["site"])


def strend(spark, sf) -> DataFrame:
    return trend(spark, sf).join(sites(spark, sf), "site")


def emis(spark, sf) -> DataFrame:
    """Unit-year panel: production, consumption from 1997 on, constant population."""
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nk"))
    orders = (
        table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("yr"))
        .agg(F.sum(cents("o_totalprice")).alias("_c"))
    )
    production = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("nk", "yr")
        .agg((F.sum("_c").cast("double") / 1e8).alias("production"))
    )
    shipped = (
        table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit(dt.date(CONSUMPTION_START, 1, 1)))
        .groupBy("l_suppkey", F.year("l_shipdate").cast("bigint").alias("yr"))
        .agg(F.sum(cents("l_extendedprice")).alias("_c"))
    )
    home = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("nk"))
    consumption = (
        shipped.join(home, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("nk", "yr")
        .agg((F.sum("_c").cast("double") / 1e8).alias("consumption"))
    )
    people = customer.groupBy("nk").agg((F.count("*") * 1000).alias("population"))
    return (
        production.join(units(spark, sf).drop("zone"), "nk")
        .join(consumption, ["nk", "yr"], "left").join(people, "nk", "left")
        .select("nk", "unit", "yr", "production", "consumption", "population")
    )


def score(spark, sf) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nk"))
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum(cents("o_totalprice")).alias("_c"), F.count("*").alias("_n"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("nk")
        .agg((F.sum("_c").cast("double") / F.sum("_n") / 1e7).alias("vuln"), F.sum("_n").alias("n_orders"))
    )


def wealth(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nk"))
        .agg((F.sum(cents("c_acctbal")).cast("double") / F.count("*") / 100.0).alias("wealth"), F.count("*").alias("n_customers"))
    )


def resp(spark, sf) -> DataFrame:
    """Cumulative production and consumption per resident of the cutoff year."""
    upto = F.col("yr") <= CUTOFF_YEAR
    people = F.max(F.when(F.col("yr") == CUTOFF_YEAR, F.col("population")))
    cons = F.sum(F.when(upto & F.col("consumption").isNotNull(), F.col("consumption")))
    win = F.sum(F.when(upto & (F.col("yr") >= CONSUMPTION_START), F.col("production")))
    prod = F.sum(F.when(upto, F.col("production")))
    return emis(spark, sf).groupBy("nk").agg(
        prod.alias("cum_production"), people.alias("population"), (prod * 1e6 / people).alias("resp"),
        (cons * 1e6 / people).alias("resp_cons"), (win * 1e6 / people).alias("resp_win"))


def natrend(spark, sf) -> DataFrame:
    w = F.greatest(F.col("acct"), F.lit(0.0))
    a = F.abs("ols_slope")
    c = F.cos(F.radians("lat"))
    return strend(spark, sf).groupBy("nk").agg(
        F.count("*").alias("n_sites"), F.avg("ols_slope").alias("trend"), F.avg(a).alias("warming"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("acct").alias("elev"),
        F.coalesce(F.sum(w * a) / F.nullif(F.sum(w), F.lit(0.0)), F.avg(a)).alias("warming_people"),
        (F.sum(c * a) / F.sum(c)).alias("warming_area"))


def country(spark, sf) -> DataFrame:
    cols = ["nk", "unit", "zone", "n_sites", "trend", "warming", "warming_people", "warming_area", "lat", "lon", "elev",
            "cum_production", "population", "resp", "resp_cons", "resp_win", "vuln", "wealth"]
    return (
        units(spark, sf).join(natrend(spark, sf), "nk").join(resp(spark, sf), "nk")
        .join(score(spark, sf), "nk").join(wealth(spark, sf), "nk").select(*cols)
    )


def cells(spark, sf, months=None) -> DataFrame:
    """Monthly field on an 18 x 36 grid of ten-degree cells, long form; `months` reaches the scan."""
    facts = table(spark, sf, "lineitem")
    return (
        (facts if months is None else in_months(facts, "l_shipdate", months))
        .groupBy((F.col("l_suppkey") % 18).cast("bigint").alias("ilat"), (F.col("l_partkey") % 36).cast("bigint").alias("ilon"),
                 F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"))
        .agg((F.sum(F.col("l_quantity").cast("bigint")).cast("double") / F.count("*") / 0.99991).alias("value"), F.count("*").alias("n"))
    )


def with_zone(df: DataFrame) -> DataFrame:
    """Cell centres and the zone that owns a cell (every seventh cell is ocean)."""
    cell = F.col("ilat") * 36 + F.col("ilon")
    return df.withColumns({
        "clat": F.lit(-85.0) + 10.0 * F.col("ilat"), "clon": F.lit(-175.0) + 10.0 * F.col("ilon"),
        "nk": F.when(cell % 7 != 0, cell % 25)})


def mask(spark, sf) -> DataFrame:
    return with_zone(table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 18).cast("bigint").alias("ilat"), (F.col("l_partkey") % 36).cast("bigint").alias("ilon")).distinct())


def cellfit(spark, sf) -> DataFrame:
    return cells(spark, sf).groupBy("ilat", "ilon").agg(
        F.count("*").alias("n_months"), F.regr_slope("value", decimal_decades("month")).alias("slope"),
        F.avg("value").alias("mean_value"))


def zonal(spark, sf) -> DataFrame:
    return with_zone(cellfit(spark, sf)).withColumn("w", F.greatest(F.cos(F.radians("clat")), F.lit(0.0)))


def days(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    first = events.agg(F.min("event_type")).scalar()
    return events.groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"),
        F.sum(F.when(F.col("event_type") == first, 1).otherwise(0)).alias("n_first"),
        F.count_distinct("user_id").alias("n_users"))
