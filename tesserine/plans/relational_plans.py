"""Joins, grouped summaries, windows over units, reshaping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import linear as L
from tesserine.operators import ordering as O
from tesserine.operators import panel as P
from tesserine.operators import tables as B
from tesserine.operators.tables import years_of
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.session import cut_lineage

r6 = C.r6


# -- joins --------------------------------------------------------------------

@query("J1_two_small_maps", """SELECT s.lat AS latitude, s.lon AS longitude, sum(p.n)::BIGINT AS n FROM panel p JOIN sites s ON s.site = p.site GROUP BY 1, 2""", ("panel", "sites"))
def two_small_maps(spark, sf):
    text = V.sites(spark, sf).select("site", F.col("lat").cast("string").alias("lat_text"), F.col("lon").cast("string").alias("lon_text"))
    lat_map = text.select("lat_text").distinct().select("lat_text", F.col("lat_text").cast("double").alias("latitude"))
    lon_map = text.select("lon_text").distinct().select("lon_text", F.col("lon_text").cast("double").alias("longitude"))
    return (V.panel(spark, sf).join(text, "site").join(lat_map, "lat_text").join(lon_map, "lon_text")
            .groupBy("latitude", "longitude").agg(F.sum("n").alias("n")))


@query("J4_country_join", """SELECT u.unit, u.zone, round(r.resp, 4) AS resp, round(w.wealth, 4) AS wealth FROM units u JOIN resp r ON r.nk = u.nk
 LEFT JOIN wealth w ON w.nk = u.nk AND w.wealth > 4500""", ("units", "resp", "wealth"))
def country_join(spark, sf):
    rich = V.wealth(spark, sf).where("wealth > 4500")
    return (V.units(spark, sf).join(V.resp(spark, sf), "nk").join(rich, "nk", "left")
            .select("unit", "zone", F.round("resp", 4).alias("resp"), F.round("wealth", 4).alias("wealth")))


@query("J4_unmatched_log", "SELECT unit FROM units WHERE nk NOT IN (SELECT nk FROM wealth WHERE wealth > 4500)", ("units", "wealth"))
def unmatched_log(spark, sf):
    return B.orphans(V.units(spark, sf), V.wealth(spark, sf).where("wealth > 4500"), ["nk"]).select("unit")


@query("J5_bridge_join", """SELECT t.nk, b.code, round(z.area_slope, 6)+0.0 AS area_slope FROM natrend t JOIN (SELECT nk, upper(substr(unit, 1, 3)) || CAST(nk AS VARCHAR) AS code FROM units WHERE zone <> 'AFRICA') b ON b.nk = t.nk
 LEFT JOIN (SELECT nk, sum(w*slope)/sum(w) AS area_slope FROM zonal WHERE nk IS NOT NULL GROUP BY 1 HAVING count(*) >= 22) z ON z.nk = t.nk
 UNION ALL SELECT t.nk, NULL, NULL FROM natrend t JOIN units u ON u.nk = t.nk WHERE u.zone = 'AFRICA'""", ("natrend", "units", "zonal"))
def bridge_join(spark, sf):
    code = F.concat(F.upper(F.substring("unit", 1, 3)), F.col("nk").cast("string"))
    bridge = V.units(spark, sf).where("zone <> 'AFRICA'").select("nk", code.alias("code"))
    area = (V.zonal(spark, sf).where("nk is not null").groupBy("nk")
            .agg((F.sum(F.col("w") * F.col("slope")) / F.sum("w")).alias("area_slope"), F.count("*").alias("n")).where("n >= 22"))
    coded = area.join(bridge, "nk").select("code", "area_slope")
    return V.natrend(spark, sf).select("nk").join(bridge, "nk", "left").join(coded, "code", "left").select("nk", "code", r6("area_slope").alias("area_slope"))


@query("J6_outer_align", """SELECT coalesce(a.nk, b.nk) AS nk, a.n_old, b.n_new FROM (SELECT nk, CAST(count(*) AS DOUBLE) AS n_old FROM sites WHERE acct > 3000 GROUP BY 1) a
 FULL JOIN (SELECT nk, CAST(count(*) AS DOUBLE) AS n_new FROM sites WHERE acct <= 3000 GROUP BY 1) b ON a.nk = b.nk""", ("sites",))
def outer_align(spark, sf):
    s = V.sites(spark, sf)
    a = s.where("acct > 3000").groupBy("nk").agg(F.count("*").cast("double").alias("n_old"))
    b = s.where("acct <= 3000").groupBy("nk").agg(F.count("*").cast("double").alias("n_new"))
    return a.join(b, "nk", "full_outer")


@query("J7_left_merge_measure", "SELECT nk, yr, round(production, 6) AS production, round(consumption, 6) AS consumption FROM emis", ("emis",))
def left_merge_measure(spark, sf):
    return V.emis(spark, sf).select("nk", "yr", F.round("production", 6).alias("production"), F.round("consumption", 6).alias("consumption"))


@query("J8_first_row_dimension", """SELECT nk, site, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY lat, site) AS rn FROM sites) WHERE rn = 1""", ("sites",))
def first_row_dimension(spark, sf):
    return B.first_per_key(V.sites(spark, sf), ["nk"], ["lat", "site"], ["site", "lat", "lon"])


@query("J9_attach_class", """SELECT c.nk, CASE WHEN c.nk = 3 THEN 'OVERRIDE' ELSE m.seg END AS class FROM wealth c LEFT JOIN
 (SELECT CAST(c_nationkey AS BIGINT) AS nk, min(c_mktsegment) AS seg FROM customer GROUP BY 1) m ON m.nk = c.nk""", ("wealth",))
def attach_class(spark, sf):
    seg = (V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nk"))
           .agg(F.min("c_mktsegment").alias("seg")))
    override = C.mapped("nk", {3: "OVERRIDE"}, default=F.col("seg"))
    return V.wealth(spark, sf).join(seg, "nk", "left").select("nk", override.alias("class"))


@query("J16_series_on_year", """WITH a AS (SELECT year(month) AS yr, avg(value) AS temp FROM panel GROUP BY 1), b AS (SELECT yr, sum(production) AS forcing FROM emis GROUP BY 1),
 u AS (SELECT year(month) AS yr, avg(value/n) AS unc FROM panel WHERE n > 1 GROUP BY 1)
 SELECT CAST(a.yr AS BIGINT) AS yr, round(temp, 6) AS temp, round(forcing, 4) AS forcing, round(coalesce(unc, (SELECT avg(unc) FROM u)), 6) AS unc FROM a JOIN b ON a.yr = b.yr LEFT JOIN u ON u.yr = a.yr""", ("panel", "emis"))
def series_on_year(spark, sf):
    panel = V.panel(spark, sf).withColumn("yr", F.year("month").cast("bigint"))
    temp = panel.groupBy("yr").agg(F.avg("value").alias("temp"))
    forcing = V.emis(spark, sf).groupBy("yr").agg(F.sum("production").alias("forcing"))
    unc = panel.where("n > 1").groupBy("yr").agg(F.avg(F.col("value") / F.col("n")).alias("unc"))
    return (temp.join(forcing, "yr").join(unc, "yr", "left").select(
        "yr", F.round("temp", 6).alias("temp"), F.round("forcing", 4).alias("forcing"),
        F.round(F.coalesce("unc", unc.agg(F.avg("unc")).scalar()), 6).alias("unc")))


@query("J17_multiway_one_to_one", """SELECT t.site, t.n_obs, round(t.ols_slope, 6)+0.0 AS slope, round(c.coverage, 6) AS coverage, s.lat, round(m.mv, 6) AS mean_value
 FROM trend t JOIN cover c ON c.site = t.site JOIN sites s ON s.site = t.site JOIN (SELECT site, avg(value) AS mv FROM panel GROUP BY 1) m ON m.site = t.site""", ("trend", "cover", "sites", "panel"))
def multiway_one_to_one(spark, sf):
    panel = V.panel(spark, sf)
    cover = P.coverage(panel, ["site"], V.WINDOW, V.MIN_COVERAGE).select("site", F.round("coverage", 6).alias("coverage"))
    mean = panel.groupBy("site").agg(F.round(F.avg("value"), 6).alias("mean_value"))
    return (V.trend(spark, sf).select("site", "n_obs", r6("ols_slope").alias("slope")).join(cover, "site")
            .join(V.sites(spark, sf).select("site", "lat"), "site").join(mean, "site"))


def two_products(spark, sf):
    """Two independent monthly products of the same sites (odd and even order lines)."""
    lines = V.table(spark, sf, "lineitem")
    a = P.monthly_panel(lines.where("l_linenumber % 2 = 1"), "l_suppkey", "l_shipdate", "l_extendedprice")
    b = P.monthly_panel(lines.where("l_linenumber % 2 = 0"), "l_suppkey", "l_shipdate", "l_extendedprice")
    return a.select("site", "month", F.col("value").alias("a")), b.select("site", "month", F.col("value").alias("b"))


def _product_sql(parity: int) -> str:
    return ("SELECT l_suppkey AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, "
            "CAST(sum(CAST(floor(l_extendedprice*100+0.5) AS BIGINT)) AS DOUBLE)/count(*)/99991.0 AS value "
            f"FROM lineitem WHERE l_linenumber % 2 = {parity} GROUP BY 1, 2")


PRODUCTS_SQL = (f"pa AS ({_product_sql(1)}), pb AS ({_product_sql(0)}), "
                "al AS (SELECT pa.site, pa.month, pa.value AS a, pb.value AS b FROM pa JOIN pb ON pa.site = pb.site AND pa.month = pb.month)")


@query("J18_common_months", f"WITH {PRODUCTS_SQL} SELECT site, count(*) AS n, round(sum(b - a), 4)+0.0 AS gap FROM al GROUP BY 1")
def common_months(spark, sf):
    a, b = two_products(spark, sf)
    return a.join(b, ["site", "month"]).groupBy("site").agg(F.count("*").alias("n"), r6(F.sum(F.col("b") - F.col("a")), 4).alias("gap"))


def _vintages(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    agg = [F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.count("*").alias("n")]
    return [lines.where(F.col("l_linestatus") == s).groupBy("l_partkey").agg(*agg) for s in ("F", "O")]


@query("J19_vintage_comparison", """WITH o AS (SELECT l_partkey, sum(l_quantity)::BIGINT AS qty FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 n AS (SELECT l_partkey, sum(l_quantity)::BIGINT AS qty FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
 SELECT presence, qty_status, count(*) AS n, coalesce(sum(qty_change), 0)::BIGINT AS total_change FROM (SELECT CASE WHEN o.l_partkey IS NULL THEN 'right_only' WHEN n.l_partkey IS NULL THEN 'left_only' ELSE 'both' END AS presence,
 CASE WHEN o.qty IS NULL THEN 'added' WHEN n.qty IS NULL THEN 'removed' WHEN o.qty = n.qty THEN 'unchanged' ELSE 'revised' END AS qty_status, n.qty - o.qty AS qty_change FROM o FULL JOIN n ON o.l_partkey = n.l_partkey) GROUP BY 1, 2""")
def vintage_comparison(spark, sf):
    old, new = _vintages(spark, sf)
    return (B.vintage_comparison(old, new, "l_partkey", ["qty"]).groupBy("presence", "qty_status")
            .agg(F.count("*").alias("n"), F.coalesce(F.sum("qty_change"), F.lit(0)).alias("total_change")))


@query("J20_three_way_outer", """SELECT coalesce(a.k, b.k, c.k) AS k, a.x::DOUBLE AS x, b.y::DOUBLE AS y, c.z::DOUBLE AS z FROM (SELECT nk AS k, count(*) AS x FROM sites WHERE lat > 0 GROUP BY 1) a
 FULL JOIN (SELECT nk AS k, count(*) AS y FROM sites WHERE lat < -20 GROUP BY 1) b ON a.k = b.k
 FULL JOIN (SELECT nk AS k, count(*) AS z FROM sites WHERE lon > 90 GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""", ("sites",))
def three_way_outer(spark, sf):
    s = V.sites(spark, sf).withColumnRenamed("nk", "k")
    def counted(cond, name):
        return s.where(cond).groupBy("k").agg(F.count("*").cast("double").alias(name))
    return counted("lat > 0", "x").join(counted("lat < -20", "y"), "k", "full_outer").join(counted("lon > 90", "z"), "k", "full_outer")


@query("J21_attach_scores", """SELECT t.nk, round(s.vuln, 6) AS score FROM natrend t LEFT JOIN score s ON s.nk = t.nk AND s.n_orders >= 600""", ("natrend", "score"))
def attach_scores(spark, sf):
    return V.natrend(spark, sf).select("nk").join(V.score(spark, sf).where("n_orders >= 600"), "nk", "left").select("nk", F.round("vuln", 6).alias("score"))


@query("J22_validated_merge", "SELECT o.o_orderkey AS orderkey, c.c_mktsegment AS segment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def validated_merge(spark, sf):
    customer = B.require_unique(V.table(spark, sf, "customer"), ["c_custkey"])
    orders = V.table(spark, sf, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("orderkey"), F.col("c_mktsegment").alias("segment"))


@query("J23_orphan_detection", "SELECT count(*) AS n_orphans FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_detection(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return B.orphans(V.table(spark, sf, "customer"), orders, ["c_custkey"]).agg(F.count("*").alias("n_orphans"))


@query("J24_key_differences", """SELECT 'parts not sold' AS side, count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)
 UNION ALL SELECT 'sold not parts', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)
 UNION ALL SELECT 'large not sold', count(*) FROM (SELECT p_partkey FROM part WHERE p_size > 40 EXCEPT SELECT l_partkey FROM lineitem)""")
def key_differences(spark, sf):
    part = V.table(spark, sf, "part")
    keys, big = part.select("p_partkey"), part.where("p_size > 40").select("p_partkey")
    sold = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    def size(df, name):
        return df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return (size(keys.subtract(sold), "parts not sold").unionByName(size(sold.subtract(keys), "sold not parts"))
            .unionByName(size(big.subtract(sold), "large not sold")))


# -- grouped summaries --------------------------------------------------------

@query("A4_unit_mean", "SELECT nk, count(*) AS n_sites, round(avg(ols_slope), 6)+0.0 AS mean_slope FROM strend GROUP BY 1", ("strend",))
def unit_mean(spark, sf):
    return V.strend(spark, sf).groupBy("nk").agg(F.count("*").alias("n_sites"), r6(F.avg("ols_slope")).alias("mean_slope"))


@query("A5_cumulative_per_capita", "SELECT nk, round(cum_production, 6) AS cumulative, population, round(resp, 4) AS per_capita FROM resp", ("resp",))
def cumulative_per_capita(spark, sf):
    return V.resp(spark, sf).select("nk", F.round("cum_production", 6).alias("cumulative"), "population", F.round("resp", 4).alias("per_capita"))


@query("A6_matched_window", """WITH f AS (SELECT nk, min(yr) AS y0 FROM emis WHERE consumption IS NOT NULL AND yr <= 2000 GROUP BY 1)
 SELECT e.nk, CAST(any_value(f.y0) AS BIGINT) AS start_year, round(sum(consumption)*1e6/max(CASE WHEN yr = 2000 THEN population END), 4) AS consumption_pc,
 round(sum(production)*1e6/max(CASE WHEN yr = 2000 THEN population END), 4) AS production_pc FROM emis e JOIN f ON f.nk = e.nk WHERE yr >= f.y0 AND yr <= 2000 GROUP BY 1""", ("emis",))
def matched_window(spark, sf):
    e = V.emis(spark, sf).where(f"yr <= {V.CUTOFF_YEAR}")
    start = e.where("consumption is not null").groupBy("nk").agg(F.min("yr").alias("start_year"))
    people = F.max(F.when(F.col("yr") == V.CUTOFF_YEAR, F.col("population")))
    return (e.join(start, "nk").where("yr >= start_year").groupBy("nk", "start_year")
            .agg(F.round(F.sum("consumption") * 1e6 / people, 4).alias("consumption_pc"), F.round(F.sum("production") * 1e6 / people, 4).alias("production_pc")))


@query("A7_people_weighted", """SELECT nk, round(CASE WHEN sum(greatest(acct, 0)) > 0 THEN sum(greatest(acct, 0)*ols_slope)/sum(greatest(acct, 0)) ELSE avg(ols_slope) END, 6)+0.0 AS weighted,
 round(avg(CASE WHEN acct > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM strend GROUP BY 1""", ("strend",))
def people_weighted(spark, sf):
    return V.strend(spark, sf).groupBy("nk").agg(
        r6(B.weighted_mean_or_plain(F.col("ols_slope"), F.col("acct"))).alias("weighted"), F.round(F.avg((F.col("acct") > 0).cast("double")), 6).alias("coverage"))


@query("A11_means_and_modes", """WITH m AS (SELECT CAST(c_nationkey AS BIGINT) AS nk, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2),
 t AS (SELECT nk, seg, row_number() OVER (PARTITION BY nk ORDER BY n DESC, seg) AS rn FROM m)
 SELECT w.nk, round(w.wealth, 4) AS mean_balance, t.seg AS modal_segment FROM wealth w JOIN t ON t.nk = w.nk AND t.rn = 1""", ("wealth",))
def means_and_modes(spark, sf):
    return V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nk")).agg(
        F.round(F.sum(P.cents("c_acctbal")).cast("double") / F.count("*") / 100.0, 4).alias("mean_balance"), B.modal("c_mktsegment").alias("modal_segment"))


@query("A12_mean_coordinates", "SELECT nk, round(avg(lat), 6)+0.0 AS lat, round(avg(lon), 6)+0.0 AS lon FROM sites GROUP BY 1", ("sites",))
def mean_coordinates(spark, sf):
    return V.sites(spark, sf).groupBy("nk").agg(r6(F.avg("lat")).alias("lat"), r6(F.avg("lon")).alias("lon"))


@query("A13_mean_abs_latitude", "SELECT nk, round(avg(abs(lat)), 6)+0.0 AS abs_latitude FROM sites GROUP BY 1", ("sites",))
def mean_abs_latitude(spark, sf):
    return V.sites(spark, sf).groupBy("nk").agg(r6(F.avg(F.abs("lat"))).alias("abs_latitude"))


@query("A14_headline", """SELECT count(*) AS n, round(avg(ols_slope), 6)+0.0 AS mean_slope, round(avg(CASE WHEN lat > 60 THEN ols_slope END), 6)+0.0 AS high_mean,
 round(avg(CASE WHEN lat > 60 THEN ols_slope END)/avg(ols_slope), 4)+0.0 AS ratio FROM strend""", ("strend",))
def headline(spark, sf):
    high = F.avg(F.when(F.col("lat") > 60, F.col("ols_slope")))
    return V.strend(spark, sf).agg(F.count("*").alias("n"), r6(F.avg("ols_slope")).alias("mean_slope"), r6(high).alias("high_mean"),
                                   r6(high / F.nullif(F.avg("ols_slope"), F.lit(0.0)), 4).alias("ratio"))


TIER_SQL = """q AS (SELECT quantile_cont(wealth, 0.25) AS a, quantile_cont(wealth, 0.5) AS b, quantile_cont(wealth, 0.75) AS c FROM wealth),
 tier AS (SELECT w.nk, CASE WHEN wealth <= a THEN 0 WHEN wealth <= b THEN 1 WHEN wealth <= c THEN 2 ELSE 3 END AS tier, wealth, n_customers FROM wealth w, q)"""


def tiers(spark, sf):
    """Quartile tier of each unit by mean balance."""
    w = V.wealth(spark, sf)
    edges = O.quantiles(w, "wealth", (0.25, 0.5, 0.75), ("a", "b", "c"), max_rows=V.unit_bound(spark, sf))
    e = edges.select(F.struct("a", "b", "c").alias("e")).scalar()
    return w.withColumn("tier", B.quartile_of(F.col("wealth"), [e["a"], e["b"], e["c"]]))


@query("W6_quartile_bins", f"WITH {TIER_SQL} SELECT nk, CAST(tier AS BIGINT) AS tier FROM tier", ("wealth",))
def quartile_bins(spark, sf):
    return tiers(spark, sf).select("nk", "tier")


TIER_STATS = f"""WITH {TIER_SQL} SELECT CAST(tier AS BIGINT) AS tier, count(*) AS n, round(avg(t.warming), 6) AS mean, round(median(t.warming), 6) AS median,
 round(sum(t.warming*n_customers)/sum(n_customers), 6) AS weighted FROM tier JOIN natrend t ON t.nk = tier.nk GROUP BY 1"""


def _tier_stats(spark, sf):
    return tiers(spark, sf).join(V.natrend(spark, sf), "nk").groupBy("tier").agg(
        F.count("*").alias("n"), F.round(F.avg("warming"), 6).alias("mean"), F.round(F.median("warming"), 6).alias("median"),
        F.round(B.weighted_mean(F.col("warming"), F.col("n_customers").cast("double")), 6).alias("weighted"))


@query("A15_tier_stats", TIER_STATS, ("wealth", "natrend"))
def tier_stats(spark, sf):
    return _tier_stats(spark, sf)


TIER_NAMED = TIER_STATS.replace(
    "SELECT CAST(tier AS BIGINT) AS tier,",
    "SELECT CASE tier WHEN 0 THEN 'low' WHEN 1 THEN 'lower middle' WHEN 2 THEN 'upper middle' ELSE 'high' END AS label, CAST(tier AS BIGINT) AS tier,",
).replace("GROUP BY 1", "GROUP BY 1, 2")


@query("A16_by_tier", TIER_NAMED, ("wealth", "natrend"))
def by_tier(spark, sf):
    names = {0: "low", 1: "lower middle", 2: "upper middle", 3: "high"}
    return _tier_stats(spark, sf).withColumn("label", C.mapped(F.col("tier").cast("int"), names)).orderBy("tier")


QUART_SQL = """q AS (SELECT quantile_cont(vuln, 0.25) AS a, quantile_cont(vuln, 0.5) AS b, quantile_cont(vuln, 0.75) AS c FROM score),
 qt AS (SELECT s.nk, vuln, CASE WHEN vuln <= a THEN 0 WHEN vuln <= b THEN 1 WHEN vuln <= c THEN 2 ELSE 3 END AS quartile FROM score s, q)"""


def score_quartiles(spark, sf):
    s = V.score(spark, sf)
    e = O.quantiles(s, "vuln", (0.25, 0.5, 0.75), ("a", "b", "c"), max_rows=V.unit_bound(spark, sf)).select(F.struct("a", "b", "c").alias("e")).scalar()
    return s.withColumn("quartile", B.quartile_of(F.col("vuln"), [e["a"], e["b"], e["c"]]))


@query("A17_quartile_table", f"""WITH {QUART_SQL} SELECT CAST(quartile AS BIGINT) AS quartile, count(*) AS n, round(avg(warming), 6) AS mean, round(median(warming), 6) AS median
 FROM qt JOIN natrend t ON t.nk = qt.nk GROUP BY 1""", ("score", "natrend"))
def quartile_table(spark, sf):
    return score_quartiles(spark, sf).join(V.natrend(spark, sf), "nk").groupBy("quartile").agg(
        F.count("*").alias("n"), F.round(F.avg("warming"), 6).alias("mean"), F.round(F.median("warming"), 6).alias("median"))


@query("A18_null_safe_weighted_mean", """SELECT nk, round(sum(CASE WHEN acct > 0 THEN ols_slope*acct END)/sum(CASE WHEN acct > 0 THEN acct END), 6)+0.0 AS weighted FROM strend GROUP BY 1""", ("strend",))
def null_safe_weighted_mean(spark, sf):
    return V.strend(spark, sf).groupBy("nk").agg(r6(B.weighted_mean(F.col("ols_slope"), F.when(F.col("acct") > 0, F.col("acct")))).alias("weighted"))


ANNUAL_SQL = """g AS (SELECT month, avg(value) AS v, avg(value/n) AS u FROM panel GROUP BY 1),
 a AS (SELECT year(month) AS yr, avg(v) AS temp, sqrt(avg(u*u)) AS unc, count(*) AS k FROM g GROUP BY 1 HAVING count(*) = 12)"""


def global_months(spark, sf):
    return V.panel(spark, sf).groupBy("month").agg(
        F.avg("value").alias("v"), F.avg(F.col("value") / F.col("n")).alias("u"))


def complete_years(spark, sf):
    """Annual means of years that hold all twelve months."""
    return global_months(spark, sf).groupBy(F.year("month").cast("bigint").alias("yr")).agg(
        F.avg("v").alias("temp"), F.sqrt(F.avg(F.col("u") * F.col("u"))).alias("unc"), F.count("*").alias("k")).where("k = 12")


@query("A19_complete_years", f"WITH {ANNUAL_SQL} SELECT CAST(yr AS BIGINT) AS yr, round(temp, 6) AS temp, round(unc, 6) AS unc FROM a", ("panel",))
def a19(spark, sf):
    return complete_years(spark, sf).select("yr", F.round("temp", 6).alias("temp"), F.round("unc", 6).alias("unc"))


@query("A20_complete_seasons", """WITH g AS (SELECT month, avg(value) AS v FROM panel GROUP BY 1)
 SELECT CAST(year(month) AS BIGINT) AS yr, round(avg(v), 6) AS index FROM g GROUP BY 1 HAVING count(DISTINCT ((month(month) % 12) // 3)) = 4 AND count(*) = 12""", ("panel",))
def complete_seasons(spark, sf):
    season = F.floor((F.month("month") % 12) / 3)
    return (global_months(spark, sf).groupBy(F.year("month").cast("bigint").alias("yr"))
            .agg(F.avg("v").alias("index"), F.count_distinct(season).alias("s"), F.count("*").alias("k")).where("s = 4 and k = 12").select("yr", F.round("index", 6).alias("index")))


@query("A21_recentre", f"WITH {ANNUAL_SQL} SELECT CAST(yr AS BIGINT) AS yr, round(temp - (SELECT avg(temp) FROM a WHERE yr BETWEEN 1996 AND 1998), 6)+0.0 AS anomaly FROM a", ("panel",))
def recentre(spark, sf):
    a = complete_years(spark, sf)
    return a.select("yr", r6(F.col("temp") - a.where("yr between 1996 and 1998").agg(F.avg("temp")).scalar()).alias("anomaly"))


@query("A22_window_means", f"WITH {ANNUAL_SQL} SELECT round(avg(temp) FILTER (WHERE yr BETWEEN 1996 AND 1998), 6) AS baseline, round(avg(temp) FILTER (WHERE yr >= 1999), 6) AS late, count(*) FILTER (WHERE yr >= 1999) AS n_late FROM a", ("panel",))
def window_means(spark, sf):
    return complete_years(spark, sf).agg(
        F.round(F.avg(F.when(F.col("yr").between(1996, 1998), F.col("temp"))), 6).alias("baseline"),
        F.round(F.avg(F.when(F.col("yr") >= 1999, F.col("temp"))), 6).alias("late"), F.count_if(F.col("yr") >= 1999).alias("n_late"))


@query("A23_overlap_agreement", f"""WITH {PRODUCTS_SQL} SELECT site, count(*) AS n_overlap, round(corr(a, b), 6)+0.0 AS r, round(sqrt(avg((a-b)*(a-b))), 6) AS rmse, round(avg(b-a), 6)+0.0 AS bias,
 coalesce(corr(a, b) >= 0.05, false) AS gate_pass FROM al GROUP BY 1""")
def overlap_agreement(spark, sf):
    a, b = two_products(spark, sf)
    d = F.col("b") - F.col("a")
    r = B.pair_corr(F.col("a"), F.col("b"))
    return a.join(b, ["site", "month"]).groupBy("site").agg(
        F.count("*").alias("n_overlap"), r6(r).alias("r"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), r6(F.avg(d)).alias("bias"),
        F.coalesce(r >= 0.05, F.lit(False)).alias("gate_pass"))


@query("A24_column_means", f"WITH {PRODUCTS_SQL} SELECT month(month)::BIGINT AS moy, round(avg(CASE WHEN a > 30 THEN a END), 6) AS mean_a, count(CASE WHEN a > 30 THEN a END) AS n_a FROM al GROUP BY 1")
def column_means(spark, sf):
    a, b = two_products(spark, sf)
    kept = C.nan_to_null(F.when(F.col("a") > 30, F.col("a")).otherwise(F.lit(float("nan"))))
    return a.join(b, ["site", "month"]).groupBy(F.month("month").cast("bigint").alias("moy")).agg(F.round(F.avg(kept), 6).alias("mean_a"), F.count(kept).alias("n_a"))


FORECAST_SQL = """fit AS (SELECT site, regr_slope(anomaly, x) AS b, regr_intercept(anomaly, x) AS c FROM anom WHERE month < DATE '2000-01-01' GROUP BY 1),
 res AS (SELECT a.site, a.month, a.anomaly AS obs, f.c + f.b*a.x AS pred, a.anomaly - (f.c + f.b*a.x) AS resid FROM anom a JOIN fit f ON f.site = a.site)"""


def forecast_frame(spark, sf):
    """Observed and predicted anomalies from a line fitted before 2000."""
    # A site holds at most one row per calendar month, so the fit is a window over one scan.
    w = Window.partitionBy("site")
    early = F.when(F.col("month") < F.lit(dt.date(2000, 1, 1)), F.col("anomaly"))
    a = V.anom(spark, sf).withColumns({"ols_slope": F.regr_slope(early, F.col("x")).over(w), "ols_intercept": F.regr_intercept(early, F.col("x")).over(w)})
    pred = F.col("ols_intercept") + F.col("ols_slope") * F.col("x")
    return a.where(F.col("ols_slope").isNotNull()).select("site", "month", F.col("anomaly").alias("obs"), pred.alias("pred"), (F.col("anomaly") - pred).alias("resid"))


@query("A25_forecast_residuals", f"""WITH {FORECAST_SQL} SELECT site, count(*) AS n_forecast, round(avg(resid), 6)+0.0 AS mean_residual, round(avg(CASE WHEN month < DATE '2001-01-01' THEN resid END), 6)+0.0 AS mean_before_event
 FROM res WHERE month >= DATE '2000-01-01' GROUP BY 1""", ("anom",))
def forecast_residuals(spark, sf):
    f = forecast_frame(spark, sf).where(F.col("month") >= F.lit(dt.date(2000, 1, 1)))
    return f.groupBy("site").agg(F.count("*").alias("n_forecast"), r6(F.avg("resid")).alias("mean_residual"),
                                 r6(F.avg(F.when(F.col("month") < F.lit(dt.date(2001, 1, 1)), F.col("resid")))).alias("mean_before_event"))


@query("A25_global_monthly", f"WITH {FORECAST_SQL} SELECT strftime(month, '%Y-%m-%d') AS month, round(avg(obs), 6)+0.0 AS observed, round(avg(pred), 6)+0.0 AS predicted, count(*) AS n_sites FROM res GROUP BY 1", ("anom",))
def global_monthly(spark, sf):
    return forecast_frame(spark, sf).groupBy(F.date_format("month", "yyyy-MM-dd").alias("month")).agg(
        r6(F.avg("obs")).alias("observed"), r6(F.avg("pred")).alias("predicted"), F.count("*").alias("n_sites"))


@query("A26_validation_headline", f"""WITH {FORECAST_SQL}, s AS (SELECT site, avg(resid) AS m FROM res WHERE month >= DATE '2000-01-01' GROUP BY 1)
 SELECT count(*) AS n, round(avg(m), 6)+0.0 AS mean, round(median(m), 6)+0.0 AS median, round(1.96*stddev_samp(m)/sqrt(count(*)), 6) AS half_width FROM s""", ("anom",))
def validation_headline(spark, sf):
    s = (forecast_frame(spark, sf).where(F.col("month") >= F.lit(dt.date(2000, 1, 1))).groupBy("site").agg(F.avg("resid").alias("m")))
    mid = O.quantiles(s, "m", (0.5,), ("median",)).select("median").scalar()
    return s.agg(F.count("*").alias("n"), r6(F.avg("m")).alias("mean"), F.round(1.96 * F.stddev_samp("m") / F.sqrt(F.count("*")), 6).alias("half_width")).withColumn("median", r6(mid))


@query("A54_window_provenance", """WITH f AS (SELECT nk, min(yr) AS y0 FROM emis WHERE consumption IS NOT NULL GROUP BY 1)
 SELECT count(*) AS n, min(y0)::BIGINT AS earliest, median(y0) AS middle, max(y0)::BIGINT AS latest FROM f""", ("emis",))
def window_provenance(spark, sf):
    f = V.emis(spark, sf).where("consumption is not null").groupBy("nk").agg(F.min("yr").alias("y0"))
    return f.agg(F.count("*").alias("n"), F.min("y0").alias("earliest"), F.median("y0").alias("middle"), F.max("y0").alias("latest"))


@query("A55_people_coverage", """SELECT count(*) AS n, count(*) FILTER (WHERE c >= 0.5) AS n_covered, round(avg(c), 6) AS mean_coverage FROM (SELECT nk, avg(CASE WHEN acct > 0 THEN 1.0 ELSE 0.0 END) AS c FROM sites GROUP BY 1)""", ("sites",))
def people_coverage(spark, sf):
    c = V.sites(spark, sf).groupBy("nk").agg(F.avg((F.col("acct") > 0).cast("double")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("c") >= 0.5).alias("n_covered"), F.round(F.avg("c"), 6).alias("mean_coverage"))


@query("A57_null_rate_by_decade", """SELECT CAST(year(month)//10*10 AS BIGINT) AS decade, count(*) AS n, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM panel GROUP BY 1""", ("panel",))
def null_rate_by_decade(spark, sf):
    p = V.panel(spark, sf).withColumn("kept", F.when(F.col("n") > 1, F.col("value")))
    return p.groupBy((F.floor(F.year("month") / 10) * 10).cast("bigint").alias("decade")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("kept").isNull().cast("double")), 6).alias("null_rate"))


@query("A58_many_distinct_counts", """SELECT count(*) AS n, count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b, count(DISTINCT (l_suppkey, l_returnflag)) AS c, count(DISTINCT (l_returnflag, l_linestatus)) AS d,
 count(DISTINCT l_shipdate) AS e, count(DISTINCT (l_suppkey, l_linestatus, l_returnflag)) AS f FROM lineitem""")
def many_distinct_counts(spark, sf):
    def tup(*c):
        return F.count_distinct(F.struct(*c))
    return V.table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("a"), F.count_distinct("l_partkey").alias("b"), tup("l_suppkey", "l_returnflag").alias("c"),
        tup("l_returnflag", "l_linestatus").alias("d"), F.count_distinct("l_shipdate").alias("e"), tup("l_suppkey", "l_linestatus", "l_returnflag").alias("f"))


@query("A59_having_distinct", """SELECT p_brand AS brand, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def having_distinct(spark, sf):
    return V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_distinct("p_type").alias("n_types")).where("n_types > 1")


@query("A60_distinct_per_year", "SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, count(DISTINCT (l_suppkey, l_returnflag)) AS n FROM lineitem GROUP BY 1")
def distinct_per_year(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("yr")).agg(F.count_distinct(F.struct("l_suppkey", "l_returnflag")).alias("n"))


@query("A61_filtered_aggregate", "SELECT count(*) AS n_groups, count(*) FILTER (WHERE lo <> hi) AS n_varied FROM (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY 1)")
def filtered_aggregate(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    return g.agg(F.count("*").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_varied"))


def band_medians(spark, sf, minimum):
    s = V.strend(spark, sf).withColumn("band", F.floor(F.col("lat") / 10).cast("bigint"))
    counts = s.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    mid = O.quantiles(s, "ols_slope", (0.5,), ("median",), by=["band"])
    return counts.join(mid, "band").select("band", "n", r6("median").alias("median"))


@query("A62_band_medians", "SELECT CAST(floor(lat/10) AS BIGINT) AS band, count(*) AS n, round(median(ols_slope), 6)+0.0 AS median FROM strend GROUP BY 1 HAVING count(*) >= 5", ("strend",))
def a62(spark, sf):
    return band_medians(spark, sf, 5)


@query("A63_mean_latitude", "SELECT u.unit, round(avg(lat), 6)+0.0 AS latitude FROM sites s JOIN units u ON u.nk = s.nk GROUP BY 1", ("sites", "units"))
def mean_latitude(spark, sf):
    per = V.sites(spark, sf).groupBy("nk").agg(r6(F.avg("lat")).alias("latitude"))
    return per.join(V.units(spark, sf), "nk").select("unit", "latitude")


@query("A65_square_concentration", """WITH s AS (SELECT site, ols_slope*ols_slope AS q FROM trend), c AS (SELECT q, row_number() OVER (ORDER BY q DESC, site) AS rk, sum(q) OVER (ORDER BY q DESC, site ROWS UNBOUNDED PRECEDING) AS cum, sum(q) OVER () AS tot FROM s)
 SELECT round(max(CASE WHEN rk = 5 THEN cum/tot END), 6) AS top_5, round(max(CASE WHEN rk = 10 THEN cum/tot END), 6) AS top_10, round(max(CASE WHEN rk = 20 THEN cum/tot END), 6) AS top_20, min(CASE WHEN cum/tot >= 0.5 THEN rk END) AS n_to_half FROM c""", ("trend",))
def square_concentration(spark, sf):
    q = V.trend(spark, sf).select((-F.col("ols_slope") * F.col("ols_slope")).alias("neg"))
    pos = O.value_positions(q, "neg", {"s": -F.col("neg")})
    # Inside a run of equal values, the k-th row adds the value itself k times.
    each = -F.col("neg")
    def share(k):
        inside = (F.col("n_lt") < k) & (F.col("n_lt") + F.col("n_eq") >= k)
        return F.round(F.max(F.when(inside, (F.col("cum_s") - F.col("s") + (F.lit(k) - F.col("n_lt")) * each) / F.col("all_s"))), 6)
    half = F.when(F.col("cum_s") >= 0.5 * F.col("all_s"),
                  F.col("n_lt") + F.greatest(F.ceil((0.5 * F.col("all_s") - (F.col("cum_s") - F.col("s"))) / each), F.lit(1)))
    return pos.agg(share(5).alias("top_5"), share(10).alias("top_10"), share(20).alias("top_20"), F.min(half).cast("bigint").alias("n_to_half"))


@query("A66_set_overlap", """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
 SELECT (SELECT count(*) FROM a JOIN b USING (l_partkey)) AS n_both, round((SELECT count(*) FROM a JOIN b USING (l_partkey))*1.0/(SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard""")
def set_overlap(spark, sf):
    # Memberships are counted per label instead of collecting both sets.
    lines = V.table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')")
    member = lines.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    both = F.count_if(F.col("a") & F.col("b"))
    return member.agg(both.alias("n_both"), F.round(both / F.nullif(F.count("*"), F.lit(0)), 6).alias("jaccard"))


# -- windows over units and series ---------------------------------------------

@query("W5_centred_rolling", """WITH g AS (SELECT month, avg(value) AS v FROM panel GROUP BY 1)
 SELECT strftime(month, '%Y-%m-%d') AS month, round(CASE WHEN count(*) OVER w = 12 THEN avg(v) OVER w END, 6) AS rolling FROM g WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""", ("panel",))
def centred_rolling(spark, sf):
    g = V.panel(spark, sf).groupBy("month").agg(F.avg("value").alias("v"))
    w = Window.orderBy("month").rowsBetween(-6, 5)  # one row per calendar month: bounded by the calendar
    return g.select(F.date_format("month", "yyyy-MM-dd").alias("month"), F.round(F.when(F.count("*").over(w) == 12, F.avg("v").over(w)), 6).alias("rolling"))


@query("W9_latest_row", "SELECT c_custkey AS k, o_orderkey AS last_order FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_row(spark, sf):
    return (B.latest_per_key(V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), ["k"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
            .select("k", F.col("o_orderkey").alias("last_order")))


@query("W17_tail_level", """SELECT site, CASE WHEN r <= 15 THEN 'top 15' WHEN r <= 30 THEN 'top 30' ELSE 'rest' END AS level FROM (SELECT site, rank() OVER (ORDER BY ols_slope DESC) AS r FROM trend)""", ("trend",))
def tail_level(spark, sf):
    ranked = O.with_rank(V.trend(spark, sf), "ols_slope", "r", descending=True)
    return ranked.select("site", F.when(F.col("r") <= 15, "top 15").when(F.col("r") <= 30, "top 30").otherwise("rest").alias("level"))


@query("W18_fixed_bins", "SELECT CAST(CASE WHEN lat < -30 THEN 0 WHEN lat < 0 THEN 1 WHEN lat < 30 THEN 2 WHEN lat < 60 THEN 3 ELSE 4 END AS BIGINT) AS bin, count(*) AS n FROM sites GROUP BY 1", ("sites",))
def fixed_bins(spark, sf):
    b = F.when(F.col("lat") < -30, 0).when(F.col("lat") < 0, 1).when(F.col("lat") < 30, 2).when(F.col("lat") < 60, 3).otherwise(4)
    return V.sites(spark, sf).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query("W16_cumulative_share", """WITH s AS (SELECT nk, warming*warming AS q FROM natrend), c AS (SELECT nk, sum(q) OVER (ORDER BY q DESC, nk ROWS UNBOUNDED PRECEDING)/sum(q) OVER () AS share FROM s)
 SELECT nk, round(share, 6) AS share, share >= 0.5 AS past_half FROM c""", ("natrend",))
def cumulative_share(spark, sf):
    n = V.unit_bound(spark, sf)
    q = cut_lineage(V.natrend(spark, sf).select("nk", (-F.col("warming") * F.col("warming")).alias("neg")))
    pos = O.value_positions(q, "neg", {"s": -F.col("neg")}, max_rows=n)
    return q.join(pos, "neg").select("nk", F.round(F.col("cum_s") / F.col("all_s"), 6).alias("share"), (F.col("cum_s") / F.col("all_s") >= 0.5).alias("past_half"))


# -- sorts and top-k -----------------------------------------------------------

@query("T2_top_per_group", """SELECT zone, unit, rk FROM (SELECT u.zone, u.unit, row_number() OVER (PARTITION BY u.zone ORDER BY abs(t.trend) DESC, u.unit) AS rk FROM units u JOIN natrend t ON t.nk = u.nk) WHERE rk <= 3""", ("units", "natrend"))
def top_per_group(spark, sf):
    w = Window.partitionBy("zone").orderBy(F.abs("trend").desc(), "unit")
    return (V.units(spark, sf).join(V.natrend(spark, sf), "nk").withColumn("rk", F.row_number().over(w).cast("bigint"))
            .where("rk <= 3").select("zone", "unit", "rk"))


@query("T3_total_order", "SELECT site, nk, row_number() OVER (ORDER BY nk, site) AS pos FROM sites", ("sites",))
def total_order(spark, sf):
    return O.row_ids(V.sites(spark, sf), ["nk", "site"], "pos").select("site", "nk", (F.col("pos") + 1).cast("bigint").alias("pos"))


@query("T4_order_limit", "SELECT site, round(ols_slope, 6)+0.0 AS slope FROM trend ORDER BY ols_slope DESC, site LIMIT 10", ("trend",))
def order_limit(spark, sf):
    return V.trend(spark, sf).orderBy(F.desc("ols_slope"), "site").limit(10).select("site", r6("ols_slope").alias("slope"))


@query("T5_lowest_coverage", "SELECT site, n_obs FROM cover ORDER BY coverage, site LIMIT 10", ("cover",))
def lowest_coverage(spark, sf):
    return P.coverage(V.panel(spark, sf, V.WINDOW), ["site"], V.WINDOW, V.MIN_COVERAGE).orderBy("coverage", "site").limit(10).select("site", "n_obs")


@query("T6_winner", "SELECT arg_min(event_type, (m, event_type)) AS winner, round(min(m), 6) AS rmse FROM (SELECT event_type, sqrt(avg(value*value)) AS m FROM events GROUP BY 1)")
def winner(spark, sf):
    m = V.table(spark, sf, "events").groupBy("event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("m"))
    return m.agg(F.min_by("event_type", F.struct("m", "event_type")).alias("winner"), F.round(F.min("m"), 6).alias("rmse"))


@query("T7_worst_region", """SELECT arg_max(zone, (m, zone)) AS worst, round(max(m), 6) AS rmse FROM (SELECT u.zone, sqrt(avg(t.ols_slope*t.ols_slope)) AS m FROM strend t JOIN units u ON u.nk = t.nk GROUP BY 1 HAVING count(*) >= 10)""", ("strend", "units"))
def worst_region(spark, sf):
    m = (V.strend(spark, sf).join(V.units(spark, sf), "nk").groupBy("zone").agg(F.sqrt(F.avg(F.col("ols_slope") * F.col("ols_slope"))).alias("m"), F.count("*").alias("n")).where("n >= 10"))
    return m.agg(F.max_by("zone", F.struct("m", "zone")).alias("worst"), F.round(F.max("m"), 6).alias("rmse"))


@query("T8_top_contributors", "SELECT site, round(ols_slope*ols_slope, 6) AS sq FROM trend ORDER BY ols_slope*ols_slope DESC, site LIMIT 20", ("trend",))
def top_contributors(spark, sf):
    return V.trend(spark, sf).select("site", (F.col("ols_slope") * F.col("ols_slope")).alias("q")).orderBy(F.desc("q"), "site").limit(20).select("site", F.round("q", 6).alias("sq"))


# -- set operations and reshaping ----------------------------------------------

@query("R1_union_all", "SELECT kind, count(*) AS n, round(sum(v), 2)+0.0 AS total FROM (SELECT 'customer' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1")
def union_all(spark, sf):
    a = V.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v"))
    b = V.table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("v"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), r6(F.sum("v"), 2).alias("total"))


@query("R2_set_difference", "SELECT 'only customers' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def set_difference(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey")
    o = V.table(spark, sf, "orders").select("o_custkey")
    def size(df, name):
        return df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return size(c.subtract(o), "only customers").unionByName(size(c.intersect(o), "both"))


@query("R3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def _by_year(spark, sf):
    """The panel's counts by site and year, wide, and the years it holds."""
    yearly = cut_lineage(V.panel(spark, sf).groupBy("site", F.year("month").alias("yr")).agg(F.sum("n").alias("n")))
    years = years_of(yearly, "yr")
    return yearly.groupBy("site").pivot("yr", years).agg(F.sum("n")), years


@query("R4_long_to_wide", "SELECT site, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN year(month) = {y} THEN n END), 0) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM panel GROUP BY site", ("panel",))
def long_to_wide(spark, sf):
    wide, years = _by_year(spark, sf)
    return wide.select("site", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years])


@query("R5_wide_to_long", "SELECT site, CAST(year(month) AS BIGINT) AS yr, sum(n)::BIGINT AS n FROM panel GROUP BY 1, 2", ("panel",))
def wide_to_long(spark, sf):
    wide, years = _by_year(spark, sf)
    return wide.unpivot(["site"], [str(y) for y in years], "yr", "n").where("n is not null").select("site", F.col("yr").cast("bigint").alias("yr"), "n")


@query("R8_two_pass_by_key", """SELECT a.nk, a.r_a, b.r_b FROM (SELECT nk, rank() OVER (ORDER BY warming DESC) AS r_a FROM natrend) a JOIN (SELECT nk, rank() OVER (ORDER BY resp DESC) AS r_b FROM resp) b ON a.nk = b.nk""", ("natrend", "resp"))
def two_pass_by_key(spark, sf):
    n = V.unit_bound(spark, sf)
    a = O.with_rank(V.natrend(spark, sf), "warming", "r_a", descending=True, max_rows=n).select("nk", "r_a")
    return a.join(O.with_rank(V.resp(spark, sf), "resp", "r_b", descending=True, max_rows=n).select("nk", "r_b"), "nk")


@query("R13_dedup_by_key", "SELECT o_custkey AS k, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def dedup_by_key(spark, sf):
    return B.first_per_key(V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), ["k"], ["o_orderkey"], ["o_orderkey"]).select("k", F.col("o_orderkey").alias("first_order"))


@query("R15_dummy_coding", "SELECT c_custkey AS k, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d_{s.lower()}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def dummy_coding(spark, sf):
    c = V.table(spark, sf, "customer")
    dummies = L.dummy_columns(c, "c_mktsegment", L.feature_levels(c, "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("k"), *[v.alias(f"d_{n.split('=')[1].lower()}") for n, v in dummies.items()])
