"""Zone reductions, grid neighbours, coverage states and diagnostics over units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.functions.distributions import chi2_one_p, f_p
from tesserine.operators import inequality as I
from tesserine.operators import ordering as O
from tesserine.operators import tables as B
from tesserine.operators import zonal as Z
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.session import cut_lineage

r6 = C.r6
RK = C.EARTH_RADIUS_KM
AREA = f"{RK}*{RK}*radians(10)*(sin(radians(clat+5)) - sin(radians(clat-5)))"


@query("A8_zone_mean", """SELECT m.nk, round(sum(CASE WHEN f.n_months >= 45 THEN w*slope END)/sum(CASE WHEN f.n_months >= 45 THEN w END), 6)+0.0 AS mean, round(count(CASE WHEN f.n_months >= 45 THEN 1 END)*1.0/count(*), 6) AS coverage
 FROM zonal f JOIN mask m ON m.ilat = f.ilat AND m.ilon = f.ilon WHERE m.nk IS NOT NULL GROUP BY 1 HAVING count(CASE WHEN f.n_months >= 45 THEN 1 END) > 0""", ("zonal", "mask"))
def zone_mean(spark, sf):
    z = V.zonal(spark, sf).where("nk is not null").withColumn("v", F.when(F.col("n_months") >= 45, F.col("slope")))
    return z.groupBy("nk").agg(r6(Z.area_weighted(F.col("v"), F.col("clat"))).alias("mean"), F.round(F.count("v") / F.count("*"), 6).alias("coverage"), F.count("v").alias("_n")).where("_n > 0").drop("_n")


@query("A9_global_mean", "SELECT count(*) AS n, round(sum(w*mean_value)/sum(w), 6)+0.0 AS mean FROM zonal WHERE nk IS NOT NULL", ("zonal",))
def global_mean(spark, sf):
    return V.zonal(spark, sf).where("nk is not null").agg(F.count("*").alias("n"), r6(Z.area_weighted(F.col("mean_value"), F.col("clat"))).alias("mean"))


@query("A10_latitude_weights", "SELECT ilat, round(sum(greatest(cos(radians(clat)), 0))/(SELECT sum(greatest(cos(radians(clat)), 0)) FROM mask), 6) AS weight FROM mask GROUP BY 1", ("mask",))
def latitude_weights(spark, sf):
    m = cut_lineage(V.mask(spark, sf)).withColumn("w", F.greatest(F.cos(F.radians("clat")), F.lit(0.0)))
    return m.groupBy("ilat").agg(F.sum("w").alias("w")).select("ilat", F.round(F.col("w") / m.agg(F.sum("w")).scalar(), 6).alias("weight"))


WQ = """wq AS (SELECT nk, mean_value, w, sum(w) OVER (PARTITION BY nk ORDER BY mean_value ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY nk) AS tw FROM zonal WHERE nk IS NOT NULL)"""


@query("A34_weighted_quantile", f"WITH {WQ} SELECT nk, round(min(CASE WHEN cw >= 0.1*tw THEN mean_value END), 6) AS p10, round(min(CASE WHEN cw >= 0.9*tw THEN mean_value END), 6) AS p90 FROM wq GROUP BY 1", ("zonal",))
def weighted_quantile(spark, sf):
    z = V.zonal(spark, sf).where("nk is not null")
    return O.weighted_quantiles(z, "mean_value", "w", (0.1, 0.9), ("p10", "p90"), by=["nk"]).select("nk", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("A35_zone_spread", f"WITH {WQ}, m AS (SELECT nk, sum(w*mean_value)/sum(w) AS mu, count(*) AS n, min(mean_value) AS lo, max(mean_value) AS hi FROM wq GROUP BY 1) SELECT m.nk, any_value(n) AS n_cells, round(any_value(mu), 6) AS mean, round(sqrt(sum(w*(mean_value-mu)*(mean_value-mu))/sum(w)), 6) AS sd, "
       "round(min(CASE WHEN cw >= 0.1*tw THEN mean_value END), 6) AS p10, round(min(CASE WHEN cw >= 0.9*tw THEN mean_value END), 6) AS p90, round(any_value(hi-lo), 6) AS range FROM wq JOIN m ON m.nk = wq.nk GROUP BY 1", ("zonal",))
def zone_spread(spark, sf):
    z = cut_lineage(V.zonal(spark, sf).where("nk is not null"))
    mean = z.groupBy("nk").agg((F.sum(F.col("w") * F.col("mean_value")) / F.sum("w")).alias("mu"))
    d = F.col("mean_value") - F.col("mu")
    spread = z.join(mean, "nk").groupBy("nk").agg(
        F.count("*").alias("n_cells"), F.round(F.max("mu"), 6).alias("mean"), F.round(F.sqrt(F.sum(F.col("w") * d * d) / F.sum("w")), 6).alias("sd"),
        F.round(F.max("mean_value") - F.min("mean_value"), 6).alias("range"))
    q = O.weighted_quantiles(z, "mean_value", "w", (0.1, 0.9), ("p10", "p90"), by=["nk"])
    return spread.join(q.select("nk", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90")), "nk")


@query("A36_variance_split", """WITH z AS (SELECT * FROM zonal WHERE nk IS NOT NULL), g AS (SELECT sum(w*mean_value)/sum(w) AS mu, sum(w) AS tw FROM z), c AS (SELECT nk, sum(w*mean_value)/sum(w) AS m FROM z GROUP BY 1)
 SELECT count(*) AS n_cells, round(sum(w*(mean_value-mu)*(mean_value-mu))/any_value(tw), 6) AS total, round(sum(w*(m-mu)*(m-mu))/any_value(tw), 6) AS between, round(sum(w*(mean_value-m)*(mean_value-m))/any_value(tw), 6) AS within FROM z JOIN c ON c.nk = z.nk, g""", ("zonal",))
def variance_split(spark, sf):
    z = cut_lineage(V.zonal(spark, sf).where("nk is not null"))
    mean = z.groupBy("nk").agg((F.sum(F.col("w") * F.col("mean_value")) / F.sum("w")).alias("m"))
    mu = z.agg((F.sum(F.col("w") * F.col("mean_value")) / F.sum("w"))).scalar()
    def part(a, b):
        return F.round(F.sum(F.col("w") * (a - b) * (a - b)) / F.sum("w"), 6)
    v, m = F.col("mean_value"), F.col("m")
    return z.join(mean, "nk").agg(F.count("*").alias("n_cells"), part(v, mu).alias("total"), part(m, mu).alias("between"), part(v, m).alias("within"))


GEO = f"""l AS (SELECT ilat, ilon, clat, clon, nk, {AREA} AS a FROM mask WHERE nk IS NOT NULL),
 s AS (SELECT l.ilat, l.ilon, count(*) AS sides FROM l JOIN l AS o ON (o.ilat = l.ilat AND (o.ilon = (l.ilon+1)%36 OR o.ilon = (l.ilon+35)%36)) OR (o.ilon = l.ilon AND abs(o.ilat-l.ilat) = 1) GROUP BY 1, 2),
 g AS (SELECT l.*, CASE WHEN coalesce(s.sides, 0) < 4 THEN 1.0 ELSE 0.0 END AS coast, cos(radians(clat))*cos(radians(clon)) AS x, cos(radians(clat))*sin(radians(clon)) AS y, sin(radians(clat)) AS z FROM l LEFT JOIN s ON s.ilat = l.ilat AND s.ilon = l.ilon)"""


@query("A37_zone_geometry", f"""WITH {GEO} SELECT nk, count(*) AS n_cells, round(sum(a), 2) AS area_km2, round(degrees(atan2(sum(a*y), sum(a*x))), 5)+0.0 AS centroid_lon, round(degrees(asin(sum(a*z)/sqrt(sum(a*x)**2+sum(a*y)**2+sum(a*z)**2))), 5)+0.0 AS centroid_lat,
 min(clat) AS lat_min, max(clat) AS lat_max, round(sqrt(greatest(sum(a*clat*clat)/sum(a) - (sum(a*clat)/sum(a))**2, 0)), 4) AS lat_sd, round(sum(a*coast)/sum(a), 6) AS coastal_share FROM g GROUP BY 1""", ("mask",))
def zone_geometry(spark, sf):
    g = Z.zone_geometry(cut_lineage(V.mask(spark, sf)), "nk", 10.0, 18, 36)
    return g.select("nk", "n_cells", F.round("area_km2", 2).alias("area_km2"), r6("centroid_lon", 5).alias("centroid_lon"), r6("centroid_lat", 5).alias("centroid_lat"),
                    "lat_min", "lat_max", F.round("lat_sd", 4).alias("lat_sd"), F.round("coastal_share", 6).alias("coastal_share"))


@query("A38_elevation_stats", f"""SELECT nk, round(sum(({AREA})*mean_value)/sum({AREA}), 6) AS mean, round(quantile_cont(mean_value, 0.1), 6) AS p10, round(quantile_cont(mean_value, 0.9), 6) AS p90, round(sum(CASE WHEN mean_value < 25 THEN {AREA} ELSE 0 END)/sum({AREA}), 6) AS below_share FROM zonal WHERE nk IS NOT NULL GROUP BY 1""", ("zonal",))
def elevation_stats(spark, sf):
    a = C.band_cell_area_km2(F.col("clat") - 5, F.col("clat") + 5, 10.0)
    z = cut_lineage(V.zonal(spark, sf).where("nk is not null").withColumn("a", a))
    q = O.quantiles(z, "mean_value", (0.1, 0.9), ("p10", "p90"), by=["nk"])
    s = z.groupBy("nk").agg(F.round(F.sum(F.col("a") * F.col("mean_value")) / F.sum("a"), 6).alias("mean"),
                            F.round(F.sum(F.when(F.col("mean_value") < 25, F.col("a")).otherwise(0.0)) / F.sum("a"), 6).alias("below_share"))
    return s.join(q.select("nk", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90")), "nk")


CLASS = "CASE WHEN mean_value < 24.5 THEN 'A' WHEN mean_value < 25.5 THEN 'B' WHEN mean_value < 26.5 THEN 'C' END"


def classed(spark, sf):
    v = F.col("mean_value")
    cls = F.when(v < 24.5, "A").when(v < 25.5, "B").when(v < 26.5, "C")
    return V.zonal(spark, sf).where("nk is not null").withColumns({"cls": cls, "a": C.band_cell_area_km2(F.col("clat") - 5, F.col("clat") + 5, 10.0)})


@query("A39_class_shares", f"""WITH k AS (SELECT nk, {CLASS} AS cls, {AREA} AS a FROM zonal WHERE nk IS NOT NULL), s AS (SELECT nk, cls, sum(a) AS a FROM k WHERE cls IS NOT NULL GROUP BY 1, 2)
 SELECT k.nk, round(coalesce(sum(CASE WHEN k.cls = 'A' THEN k.a END), 0)/sum(k.a), 6) AS share_a, round(coalesce(sum(CASE WHEN k.cls = 'B' THEN k.a END), 0)/sum(k.a), 6) AS share_b, round(coalesce(sum(CASE WHEN k.cls = 'C' THEN k.a END), 0)/sum(k.a), 6) AS share_c,
 (SELECT arg_max(cls, a) FROM s WHERE s.nk = k.nk) AS dominant FROM k GROUP BY 1""", ("zonal",))
def class_shares(spark, sf):
    k = classed(spark, sf)
    per = k.groupBy("nk").pivot("cls", ["A", "B", "C"]).agg(F.sum("a"))
    total = k.groupBy("nk").agg(F.sum("a").alias("t"))
    a, b, c = (F.coalesce(F.col(x), F.lit(0.0)) for x in "ABC")
    top = F.greatest(a, b, c)
    return per.join(total, "nk").select("nk", *[F.round(v / F.col("t"), 6).alias(f"share_{n}") for v, n in ((a, "a"), (b, "b"), (c, "c"))],
                                        F.when(a == top, "A").when(b == top, "B").otherwise("C").alias("dominant"))


@query("A40_dominance_slack", f"""WITH k AS (SELECT nk, {CLASS} AS cls, {AREA} AS a FROM zonal WHERE nk IS NOT NULL), s AS (SELECT nk, cls, sum(a) AS a, row_number() OVER (PARTITION BY nk ORDER BY sum(a) DESC, cls) AS rk FROM k WHERE cls IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT nk, coalesce(sum(CASE WHEN cls IS NULL THEN a END), 0) AS slack FROM k GROUP BY 1)
 SELECT u.nk, CASE WHEN max(CASE WHEN rk = 1 THEN a END) - coalesce(max(CASE WHEN rk = 2 THEN a END), 0) > any_value(slack) THEN max(CASE WHEN rk = 1 THEN cls END) ELSE 'undetermined' END AS dominant FROM u JOIN s ON s.nk = u.nk GROUP BY 1""", ("zonal",))
def dominance_slack(spark, sf):
    k = classed(spark, sf)
    s = k.groupBy("nk", "cls").agg(F.sum("a").alias("a"))
    known = s.where("cls is not null")
    # At most one row per class reaches each zone's pair of leaders.
    ranked = known.groupBy("nk").agg(F.reverse(F.array_sort(F.collect_list(F.struct("a", "cls")))).alias("o"))
    slack = s.groupBy("nk").agg(F.coalesce(F.sum(F.when(F.col("cls").isNull(), F.col("a"))), F.lit(0.0)).alias("slack"))
    first, second = F.col("o")[0], F.try_element_at("o", F.lit(2))
    lead = first["a"] - F.coalesce(second["a"], F.lit(0.0))
    return slack.join(ranked, "nk").select("nk", F.when(lead > F.col("slack"), first["cls"]).otherwise("undetermined").alias("dominant"))


@query("A41_area_integrals", f"SELECT nk, count(*) AS n, round(sum({AREA}), 2) AS area, round(sum(({AREA})*mean_value), 1) AS integral FROM zonal WHERE nk IS NOT NULL GROUP BY 1", ("zonal",))
def area_integrals(spark, sf):
    z = classed(spark, sf)
    return z.groupBy("nk").agg(F.count("*").alias("n"), F.round(F.sum("a"), 2).alias("area"), F.round(F.sum(F.col("a") * F.col("mean_value")), 1).alias("integral"))


@query("A42_coarse_zone_cells", f"SELECT nk, ilat//2 AS clat_i, ilon//2 AS clon_i, count(*) AS n, round(sum({AREA}), 2) AS area FROM mask WHERE nk IS NOT NULL GROUP BY 1, 2, 3", ("mask",))
def coarse_zone_cells(spark, sf):
    a = C.band_cell_area_km2(F.col("clat") - 5, F.col("clat") + 5, 10.0)
    return V.mask(spark, sf).where("nk is not null").groupBy("nk", F.floor(F.col("ilat") / 2).alias("clat_i"), F.floor(F.col("ilon") / 2).alias("clon_i")).agg(
        F.count("*").alias("n"), F.round(F.sum(a), 2).alias("area"))


@query("A43_cell_climatology_ratio", """SELECT ilat, ilon, count(*) AS n_valid, CASE WHEN count(*) >= 30 THEN round(log10((sum(value)/30)/(sum(n)/30.0)), 6)+0.0 END AS log_ratio FROM cells WHERE month BETWEEN DATE '1996-01-01' AND DATE '1998-12-01' GROUP BY 1, 2""", ("cells",))
def cell_climatology_ratio(spark, sf):
    c = V.cells(spark, sf, V.BASELINE)
    return c.groupBy("ilat", "ilon").agg(F.count("*").alias("n_valid"), F.when(F.count("*") >= 30, r6(F.log10((F.sum("value") / 30) / (F.sum("n") / 30.0)))).alias("log_ratio"))


@query("A44_support_audit", "SELECT ilat, ilon, round(avg(CASE WHEN n > 1 THEN value END), 6) AS supported_mean, count(*) FILTER (WHERE n > 1) AS n_supported, bool_and(n > 0) AS all_present FROM cells GROUP BY 1, 2", ("cells",))
def support_audit(spark, sf):
    return V.cells(spark, sf).groupBy("ilat", "ilon").agg(F.round(F.avg(F.when(F.col("n") > 1, F.col("value"))), 6).alias("supported_mean"),
                                                           F.count_if(F.col("n") > 1).alias("n_supported"), F.bool_and(F.col("n") > 0).alias("all_present"))


@query("A45_partition_quality", f"""SELECT nk, count(*) AS n_cells, round(sum({AREA}), 2) AS area_all, round(sum(CASE WHEN n_months >= 60 THEN {AREA} ELSE 0 END)/sum({AREA}), 6) AS share_dense, round(sum(CASE WHEN n_months < 50 THEN {AREA} ELSE 0 END)/sum({AREA}), 6) AS share_sparse, min(n_months) AS min_months, max(n_months) AS max_months FROM zonal WHERE nk IS NOT NULL GROUP BY 1""", ("zonal",))
def partition_quality(spark, sf):
    z = classed(spark, sf)
    def share(cond):
        return F.round(F.sum(F.when(cond, F.col("a")).otherwise(0.0)) / F.sum("a"), 6)
    return z.groupBy("nk").agg(F.count("*").alias("n_cells"), F.round(F.sum("a"), 2).alias("area_all"), share(F.col("n_months") >= 60).alias("share_dense"),
                               share(F.col("n_months") < 50).alias("share_sparse"), F.min("n_months").alias("min_months"), F.max("n_months").alias("max_months"))


#: Support classes of a cell by its months, and the distance its value would travel: one text for both engines.
_NATIVE, _FILLED, _OPEN = "n_months >= 60", "n_months >= 50 AND n_months < 60", "n_months < 50"
_AWAY = "((60 - n_months)*111.195)"


def partition_measures(a: str) -> dict[str, str]:
    """Aggregates of an area partition over cells with area `a`, n_months, slope and mean_value."""
    def area(cond: str) -> str:
        return f"sum(CASE WHEN {cond} THEN {a} ELSE 0.0 END)"

    def count(cond: str) -> str:
        return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"

    def mean(value: str, cond: str) -> str:
        return f"sum(CASE WHEN {cond} THEN {a}*{value} ELSE 0.0 END)/nullif({area(cond)}, 0.0)"

    covered, border = "n_months >= 50", f"({_FILLED}) AND ilat % 2 = 1"
    areas = {"total": f"sum({a})", "native": area(_NATIVE), "filled": area(_FILLED), "open": area(_OPEN), "cross_border": area(border)}
    out = {f"{k}_area": v for k, v in areas.items()} | {f"{k}_fraction": f"{areas[k]}/sum({a})" for k in ("native", "filled", "open")}
    out |= {"coverage": f"{area(covered)}/sum({a})", "n_native": count(_NATIVE), "n_filled": count(_FILLED), "n_open": count(_OPEN), "n_cross_border": count(border)}
    out |= {"mean_distance": f"avg(CASE WHEN {_FILLED} THEN {_AWAY} END)", "area_mean_distance": mean(_AWAY, _FILLED), "max_distance": f"max(CASE WHEN {_FILLED} THEN {_AWAY} END)"}
    out |= {"native_value": mean("slope", _NATIVE), "covered_value": mean("slope", covered), "shift": f"{mean('slope', covered)} - {mean('slope', _NATIVE)}"}
    return out | {"native_level": mean("mean_value", _NATIVE), "native_months": mean("n_months", _NATIVE), "full_share": f"{area('n_months >= 70')}/nullif({area(_NATIVE)}, 0.0)"}


_MEASURES = ", ".join(f"round(({e})::DOUBLE, 6)+0.0 AS {n}" for n, e in partition_measures(f"({AREA})").items())


@query("A45_partition_measures", f"SELECT nk, {_MEASURES} FROM zonal WHERE nk IS NOT NULL GROUP BY 1", ("zonal",))
def partition_audit(spark, sf):
    z = classed(spark, sf)
    return z.groupBy("nk").agg(*[(F.round(F.expr(e).cast("double"), 6) + F.lit(0.0)).alias(n) for n, e in partition_measures("a").items()])


# -- diagnostics ---------------------------------------------------------------

ANOVA = """z AS (SELECT u.zone, t.ols_slope AS e FROM strend t JOIN units u ON u.nk = t.nk), g AS (SELECT zone, count(*) AS n, avg(e) AS m FROM z GROUP BY 1), a AS (SELECT avg(e) AS mu, count(*) AS n FROM z),
 s AS (SELECT sum(g.n*(g.m-a.mu)*(g.m-a.mu)) AS ssb, count(*) AS k FROM g, a), w AS (SELECT sum((e-g.m)*(e-g.m)) AS ssw FROM z JOIN g ON g.zone = z.zone)"""


def _anova(spark, sf):
    z = cut_lineage(V.strend(spark, sf).join(V.units(spark, sf), "nk").select("zone", F.col("ols_slope").alias("e")))
    g = z.groupBy("zone").agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.var_pop("e").alias("v"))
    mu = z.agg(F.avg("e")).scalar()
    k, n = F.count("*"), F.sum("n")
    ssb, ssw = F.sum(F.col("n") * (F.col("m") - mu) * (F.col("m") - mu)), F.sum(F.col("n") * F.col("v"))
    return g.agg(n.alias("n"), k.alias("n_groups"), ((ssb / (k - 1)) / (ssw / (n - k))).alias("f"), (ssb / (ssb + ssw)).alias("eta2"))


@query("A46_one_way_anova", f"WITH {ANOVA} SELECT a.n, s.k AS n_groups, round((ssb/(k-1))/(ssw/(n-k)), 6) AS f, round(ssb/(ssb+ssw), 6) AS eta2 FROM a, s, w", ("strend", "units"))
def one_way_anova(spark, sf):
    return _anova(spark, sf).select("n", "n_groups", F.round("f", 6).alias("f"), F.round("eta2", 6).alias("eta2"))


@query("A46_anova_p")
def anova_p(spark, sf):
    a = _anova(spark, sf)
    return a.select(r6("f").alias("f"), r6(f_p("f", (F.col("n_groups") - 1).cast("double"), (F.col("n") - F.col("n_groups")).cast("double"))).alias("p"))


@query("A47_latitude_structure", "SELECT CAST(CASE WHEN abs(lat) < 10 THEN 0 WHEN abs(lat) < 20 THEN 1 WHEN abs(lat) < 30 THEN 2 WHEN abs(lat) < 40 THEN 3 WHEN abs(lat) < 50 THEN 4 WHEN abs(lat) < 70 THEN 5 ELSE 6 END AS BIGINT) AS bin, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere, count(*) AS n, round(avg(ols_slope), 6)+0.0 AS mean FROM strend GROUP BY 1, 2", ("strend",))
def latitude_structure(spark, sf):
    a = F.abs("lat")
    b = F.when(a < 10, 0).when(a < 20, 1).when(a < 30, 2).when(a < 40, 3).when(a < 50, 4).when(a < 70, 5).otherwise(6)
    return V.strend(spark, sf).groupBy(b.cast("bigint").alias("bin"), C.hemisphere("lat").alias("hemisphere")).agg(F.count("*").alias("n"), r6(F.avg("ols_slope")).alias("mean"))


LEVELS = (1, 5, 10, 25, 50, 75, 90, 95, 99)
LEVELS_SQL = ", ".join(f"round(quantile_cont(ols_slope, {p / 100}), 6)+0.0 AS p{p}" for p in LEVELS)


@query("A48_distribution", f"""WITH m AS (SELECT avg(ols_slope) AS mu, stddev_pop(ols_slope) AS sd FROM trend),
 s AS (SELECT count(*) AS k, avg(pow((ols_slope-mu)/sd, 3)) AS g, avg(pow((ols_slope-mu)/sd, 4)) - 3 AS h FROM trend, m)
 SELECT count(*) AS n, round(any_value(exp(-k/12.0*(g*g + h*h/4))), 6)+0.0 AS jarque_bera_p, round(any_value(mu), 6)+0.0 AS mean, round(stddev_samp(ols_slope), 6) AS sd, round(sqrt(avg(ols_slope*ols_slope)), 6) AS rmse, round(avg(abs(ols_slope)), 6) AS mae,
 round(any_value(g), 5)+0.0 AS skew, round(any_value(h), 5)+0.0 AS kurtosis, {LEVELS_SQL} FROM trend, m, s""", ("trend",))
def distribution(spark, sf):
    t = cut_lineage(V.trend(spark, sf))
    e = F.col("ols_slope")
    names = [f"p{p}" for p in LEVELS]
    q = O.quantiles(t, "ols_slope", [p / 100 for p in LEVELS], names).withColumn("_k", F.lit(1))
    # Chi-square with two degrees of freedom has the tail exp(-x / 2).
    bera = F.count("*") / 6.0 * (F.skewness(e) * F.skewness(e) + F.kurtosis(e) * F.kurtosis(e) / 4)
    m = t.agg(F.count("*").alias("n"), r6(F.avg(e)).alias("mean"), F.round(F.stddev_samp(e), 6).alias("sd"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
              F.round(F.avg(F.abs(e)), 6).alias("mae"), r6(F.skewness(e), 5).alias("skew"), r6(F.kurtosis(e), 5).alias("kurtosis"), r6(F.exp(-bera / 2)).alias("jarque_bera_p")).withColumn("_k", F.lit(1))
    return m.join(q, "_k").drop("_k").withColumns({c: r6(c) for c in names})


SPREAD = ("abs_lat", "acct", "slope", "n_obs")
SPREAD_SQL = " UNION ALL ".join(f"SELECT '{n}' AS measure, abs(ols_slope - b) AS y, {x}::DOUBLE AS x FROM strend, k" for n, x in zip(
    SPREAD, ("abs(lat)", "acct", "ols_slope", "n_obs"), strict=True))


@query("A49_rank_spread", f"""WITH k AS (SELECT avg(ols_slope) AS b FROM strend), l AS ({SPREAD_SQL}),
 r AS (SELECT measure, rank() OVER (PARTITION BY measure ORDER BY y) + (count(*) OVER (PARTITION BY measure, y) - 1)/2.0 AS ry,
  rank() OVER (PARTITION BY measure ORDER BY x) + (count(*) OVER (PARTITION BY measure, x) - 1)/2.0 AS rx FROM l)
 SELECT measure, count(*) AS n, round(corr(rx, ry), 6)+0.0 AS rho FROM r GROUP BY 1""", ("strend",))
def rank_spread(spark, sf):
    """Rank correlation of the absolute residual with four columns, all in one long table."""
    t = cut_lineage(V.strend(spark, sf))
    middle = t.agg(F.avg("ols_slope")).scalar()
    columns = zip(SPREAD, (F.abs("lat"), F.col("acct"), F.col("ols_slope"), F.col("n_obs").cast("double")), strict=True)
    rows = t.select(F.abs(F.col("ols_slope") - middle).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("x")) for n, c in columns])).alias("m"))
    return I.spearman(rows.select("y", "m.*"), "x", "y", by=["measure"]).select("measure", "n", r6("rho").alias("rho"))


@query("A49_heteroscedasticity", "SELECT count(*) AS n, round(regr_r2(ols_slope*ols_slope, abs(lat))*count(*), 6) AS lm FROM strend", ("strend",))
def heteroscedasticity(spark, sf):
    return V.strend(spark, sf).agg(F.count("*").alias("n"), F.round(F.regr_r2(F.col("ols_slope") * F.col("ols_slope"), F.abs("lat")) * F.count("*"), 6).alias("lm"))


def one_degree_p_sql(x: str) -> str:
    """Tail of chi-square with one degree of freedom at `x`, by the power series of the error function (x below about 30)."""
    z = f"sqrt({x}/2)"
    return f"1 - 2/sqrt(pi())*list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)*pow({z}, 2*k + 1)/(gamma(k + 1)*(2*k + 1))))"


@query("A49_heteroscedasticity_p", f"WITH m AS (SELECT regr_r2(ols_slope*ols_slope, abs(lat))*count(*) AS lm FROM strend) SELECT round(lm, 6)+0.0 AS lm, round({one_degree_p_sql('lm')}, 6)+0.0 AS p FROM m", ("strend",))
def heteroscedasticity_p(spark, sf):
    return V.strend(spark, sf).agg((F.regr_r2(F.col("ols_slope") * F.col("ols_slope"), F.abs("lat")) * F.count("*")).alias("lm")).select(r6("lm").alias("lm"), r6(chi2_one_p("lm")).alias("p"))


@query("A50_region_errors", "SELECT u.zone, count(*) AS n, round(sqrt(avg(ols_slope*ols_slope)), 6) AS rmse, round(avg(abs(ols_slope)), 6) AS mae, round(avg(ols_slope), 6)+0.0 AS bias FROM strend t JOIN units u ON u.nk = t.nk GROUP BY 1", ("strend", "units"))
def region_errors(spark, sf):
    e = F.col("ols_slope")
    return V.strend(spark, sf).join(V.units(spark, sf), "nk").groupBy("zone").agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), r6(F.avg(e)).alias("bias")).orderBy(F.desc("rmse"))


PATTERN = """d AS (SELECT u.zone, t.trend AS b, z.e FROM natrend t JOIN units u ON u.nk = t.nk JOIN (SELECT nk, sum(w*slope)/sum(w) AS e FROM zonal WHERE nk IS NOT NULL GROUP BY 1) z ON z.nk = t.nk),
 r AS (SELECT zone, count(*) AS n, avg(b) AS bm, avg(e) AS em, median(b) AS bmed, stddev_samp(b) AS bsd, sum(b) AS bsum, avg(CASE WHEN b*e > 0 THEN 1.0 ELSE 0.0 END) AS agree FROM d GROUP BY 1)"""


def products_by_region(spark, sf):
    area = V.zonal(spark, sf).where("nk is not null").groupBy("nk").agg((F.sum(F.col("w") * F.col("slope")) / F.sum("w")).alias("e"))
    d = V.natrend(spark, sf).select("nk", F.col("trend").alias("b")).join(V.units(spark, sf), "nk").join(area, "nk")
    return d.groupBy("zone").agg(F.count("*").alias("n"), F.avg("b").alias("bm"), F.avg("e").alias("em"), F.median("b").alias("bmed"), F.stddev_samp("b").alias("bsd"),
                                 F.sum("b").alias("bsum"), F.avg((F.col("b") * F.col("e") > 0).cast("double")).alias("agree"))


@query("A51_region_products", f"WITH {PATTERN} SELECT zone, n, round(bm, 6)+0.0 AS b_mean, round(em, 6)+0.0 AS e_mean, round(bmed, 6)+0.0 AS b_median, round(bsd, 6) AS b_sd, round(bsum, 6)+0.0 AS b_sum, round(agree, 6) AS agreement FROM r", ("natrend", "units", "zonal"))
def region_products(spark, sf):
    r = products_by_region(spark, sf)
    return r.select("zone", "n", r6("bm").alias("b_mean"), r6("em").alias("e_mean"), r6("bmed").alias("b_median"), F.round("bsd", 6).alias("b_sd"), r6("bsum").alias("b_sum"), F.round("agree", 6).alias("agreement"))


CLASSIFY = """CASE WHEN n < 3 THEN 'unresolved' WHEN abs(bm) >= 0.5 AND abs(em) >= 0.5 AND bm*em < 0 THEN 'product-sensitive' WHEN abs(bm) >= 0.5 AND abs(em) >= 0.5 AND agree >= 0.75 THEN 'product-robust'
 WHEN (abs(bm) >= 0.5) <> (abs(em) >= 0.5) THEN 'product-sensitive' ELSE 'unresolved' END"""


@query("P42_pattern_classes", f"WITH {PATTERN} SELECT zone, {CLASSIFY} AS classification FROM r", ("natrend", "units", "zonal"))
def pattern_classes(spark, sf):
    b, e = F.abs("bm") >= 0.5, F.abs("em") >= 0.5
    cls = (F.when(F.col("n") < 3, "unresolved").when(b & e & (F.col("bm") * F.col("em") < 0), "product-sensitive")
           .when(b & e & (F.col("agree") >= 0.75), "product-robust").when(b != e, "product-sensitive").otherwise("unresolved"))
    return products_by_region(spark, sf).select("zone", cls.alias("classification"))


@query("A52_grouped_scores", "SELECT count(*) AS n_groups, round(avg(m), 6) AS mae, round(sqrt(avg(q)), 6) AS rmse FROM (SELECT lat, lon, avg(abs(ols_slope)) AS m, avg(ols_slope*ols_slope) AS q FROM strend GROUP BY 1, 2)", ("strend",))
def grouped_scores(spark, sf):
    e = F.col("ols_slope")
    g = V.strend(spark, sf).groupBy("lat", "lon").agg(F.avg(F.abs(e)).alias("m"), F.avg(e * e).alias("q"))
    return g.agg(F.count("*").alias("n_groups"), F.round(F.avg("m"), 6).alias("mae"), F.round(F.sqrt(F.avg("q")), 6).alias("rmse"))


@query("A56_area_coverage", "SELECT count(*) AS n, count(*) FILTER (WHERE c >= 0.8) AS n_covered, round(avg(c), 6) AS mean_coverage FROM (SELECT nk, avg(CASE WHEN n_months >= 55 THEN 1.0 ELSE 0.0 END) AS c FROM zonal WHERE nk IS NOT NULL GROUP BY 1)", ("zonal",))
def area_coverage(spark, sf):
    c = V.zonal(spark, sf).where("nk is not null").groupBy("nk").agg(F.avg((F.col("n_months") >= 55).cast("double")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("c") >= 0.8).alias("n_covered"), F.round(F.avg("c"), 6).alias("mean_coverage"))


# -- points and cells ------------------------------------------------------------

SITE_CELL = """sc AS (SELECT site, nk, CAST(least(greatest(round((lat+85)/10), 0), 17) AS BIGINT) AS ilat, CAST(least(greatest(round((lon+175)/10), 0), 35) AS BIGINT) AS ilon FROM sites)"""


def site_cells(spark, sf):
    return V.sites(spark, sf).select("site", F.col("nk").alias("home"), C.axis_index("lat", -85.0, 10.0, 18).alias("ilat"), C.axis_index("lon", -175.0, 10.0, 36).alias("ilon"))


@query("J10_nearest_cell", f"WITH {SITE_CELL} SELECT sc.site, sc.ilat, sc.ilon, round(f.mean_value, 6) AS value FROM sc LEFT JOIN cellfit f ON f.ilat = sc.ilat AND f.ilon = sc.ilon", ("sites", "cellfit"))
def nearest_cell(spark, sf):
    return site_cells(spark, sf).join(V.cellfit(spark, sf), ["ilat", "ilon"], "left").select("site", "ilat", "ilon", F.round("mean_value", 6).alias("value"))


@query("S21_pointwise_raster", f"WITH {SITE_CELL} SELECT sc.site, count(f.value) AS n_bands, round(avg(f.value), 6) AS mean_value FROM sc LEFT JOIN cells f ON f.ilat = sc.ilat AND f.ilon = sc.ilon GROUP BY 1", ("sites", "cells"))
def pointwise_raster(spark, sf):
    # Only the sampled cells are read past the join: the field is filtered by the points' cells first.
    wanted = site_cells(spark, sf)
    field = V.cells(spark, sf).join(wanted.select("ilat", "ilon").distinct(), ["ilat", "ilon"], "left_semi")
    per_cell = field.groupBy("ilat", "ilon").agg(F.count("value").alias("n_bands"), F.round(F.avg("value"), 6).alias("mean_value"))
    return wanted.join(per_cell, ["ilat", "ilon"], "left").select("site", F.coalesce("n_bands", F.lit(0)).alias("n_bands"), "mean_value")


@query("S19_sampled_series", f"WITH {SITE_CELL} SELECT sc.site, strftime(f.month, '%Y') AS yr, count(*) AS n, round(avg(f.value), 6) AS value FROM sc JOIN cells f ON f.ilat = sc.ilat AND f.ilon = sc.ilon GROUP BY 1, 2", ("sites", "cells"))
def sampled_series(spark, sf):
    return site_cells(spark, sf).join(V.cells(spark, sf), ["ilat", "ilon"]).groupBy("site", F.date_format("month", "yyyy").alias("yr")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query("S20_grid_axes", "SELECT 'lat' AS axis, count(DISTINCT clat) AS n, min(clat) AS first, max(clat) AS last FROM mask UNION ALL SELECT 'lon', count(DISTINCT clon), min(clon), max(clon) FROM mask", ("mask",))
def grid_axes(spark, sf):
    m = cut_lineage(V.mask(spark, sf))
    def ax(c, name):
        return m.agg(F.lit(name).alias("axis"), F.count_distinct(c).alias("n"), F.min(c).alias("first"), F.max(c).alias("last"))
    return ax("clat", "lat").unionByName(ax("clon", "lon"))


@query("J15_point_zone_code", f"WITH {SITE_CELL} SELECT sc.site, upper(substr(u.unit, 1, 3)) AS code FROM sc LEFT JOIN mask m ON m.ilat = sc.ilat AND m.ilon = sc.ilon LEFT JOIN units u ON u.nk = m.nk", ("sites", "mask", "units"))
def point_zone_code(spark, sf):
    codes = V.units(spark, sf).select("nk", F.upper(F.substring("unit", 1, 3)).alias("code"))
    return site_cells(spark, sf).join(V.mask(spark, sf), ["ilat", "ilon"], "left").join(codes, "nk", "left").select("site", "code")


@query("J25_zone_adjacency", """WITH l AS (SELECT ilat, ilon, nk FROM mask WHERE nk IS NOT NULL), p AS (SELECT a.nk AS x, b.nk AS y, (a.ilat = b.ilat OR a.ilon = b.ilon) AS e FROM l a JOIN l b ON (b.ilat = a.ilat AND b.ilon = (a.ilon+1)%36) OR (b.ilat = a.ilat+1 AND (b.ilon = a.ilon OR b.ilon = (a.ilon+1)%36 OR b.ilon = (a.ilon+35)%36)) WHERE a.nk <> b.nk)
 SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) FILTER (WHERE e) AS shared_edges, count(*) FILTER (WHERE NOT e) AS shared_corners FROM p GROUP BY 1, 2""", ("mask",))
def zone_adjacency(spark, sf):
    return Z.adjacency(cut_lineage(V.mask(spark, sf)), "nk", 36)


DONOR = """nd AS (SELECT ilat, ilon FROM zonal WHERE n_months < 55), dn AS (SELECT ilat, ilon, mean_value AS value FROM zonal WHERE n_months >= 55),
 pr AS (SELECT n.ilat, n.ilon, d.ilat AS r, d.ilon AS c, d.value, round(sqrt((d.ilat-n.ilat)**2 + (dj.dj*cos(radians((n.ilat+d.ilat)/2.0*10-85)))**2), 9) AS dist
  FROM nd n JOIN (SELECT unnest([-1,0,1]) AS di) di ON true JOIN (SELECT unnest([-1,0,1]) AS dj) dj ON true JOIN dn d ON d.ilat = n.ilat+di.di AND d.ilon = (n.ilon+dj.dj+36)%36 WHERE NOT (di.di = 0 AND dj.dj = 0)),
 bs AS (SELECT ilat, ilon, r, c, value FROM (SELECT *, row_number() OVER (PARTITION BY ilat, ilon ORDER BY dist, r, c) AS rn FROM pr) WHERE rn = 1)"""


def donors(spark, sf):
    z = cut_lineage(V.zonal(spark, sf))
    return z, Z.ring_donors(z.where("n_months < 55").select("ilat", "ilon"), z.where("n_months >= 55").select("ilat", "ilon", F.col("mean_value").alias("value")), 36, 10.0)


@query("J28_ring_donors", f"WITH {DONOR} SELECT nd.ilat, nd.ilon, CAST(coalesce(bs.r, -1) AS BIGINT) AS donor_row, CAST(coalesce(bs.c, -1) AS BIGINT) AS donor_col, round(bs.value, 6) AS donor_value FROM nd LEFT JOIN bs ON bs.ilat = nd.ilat AND bs.ilon = nd.ilon", ("zonal",))
def ring_donors(spark, sf):
    return donors(spark, sf)[1].select("ilat", "ilon", F.coalesce("donor_row", F.lit(-1)).alias("donor_row"), F.coalesce("donor_col", F.lit(-1)).alias("donor_col"), F.round("donor_value", 6).alias("donor_value"))


@query("J29_resolved_support", f"WITH {DONOR} SELECT status, count(*) AS n, round(avg(v), 6) AS mean_value FROM (SELECT CASE WHEN z.n_months >= 55 THEN 'own' WHEN bs.value IS NOT NULL THEN 'donor' ELSE 'unresolved' END AS status, CASE WHEN z.n_months >= 55 THEN z.mean_value ELSE bs.value END AS v FROM zonal z LEFT JOIN bs ON bs.ilat = z.ilat AND bs.ilon = z.ilon) GROUP BY 1", ("zonal",))
def resolved_support(spark, sf):
    z, d = donors(spark, sf)
    own = F.col("n_months") >= 55
    both = z.join(d.select("ilat", "ilon", "donor_value"), ["ilat", "ilon"], "left")
    return both.groupBy(F.when(own, "own").when(F.col("donor_value").isNotNull(), "donor").otherwise("unresolved").alias("status")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(own, F.col("mean_value")).otherwise(F.col("donor_value"))), 6).alias("mean_value"))


@query("J30_same_zone_ring_mean", """WITH z AS (SELECT ilat, ilon, coalesce(nk % 3, 9) AS g, mean_value AS v FROM zonal) SELECT a.ilat, a.ilon, count(*) AS n_ring, round(avg(b.v), 6) AS ring_mean FROM z a JOIN z b ON a.g = b.g AND abs(b.ilat-a.ilat) <= 1 AND least((b.ilon-a.ilon+36)%36, (a.ilon-b.ilon+36)%36) <= 1 AND NOT (a.ilat = b.ilat AND a.ilon = b.ilon) GROUP BY 1, 2""", ("zonal",))
def same_zone_ring_mean(spark, sf):
    z = cut_lineage(V.zonal(spark, sf).withColumn("g", F.coalesce(F.col("nk") % 3, F.lit(9))))
    return Z.same_zone_ring_mean(z, "g", "mean_value", 36).select("ilat", "ilon", "n_ring", F.round("ring_mean", 6).alias("ring_mean"))


@query("R6_grid_to_long", "SELECT clat AS lat, clon AS lon, round(mean_value, 4) AS value FROM zonal", ("zonal",))
def grid_to_long(spark, sf):
    return V.zonal(spark, sf).select(F.col("clat").alias("lat"), F.col("clon").alias("lon"), F.round("mean_value", 4).alias("value"))


@query("R7_grid_axes_join", "SELECT count(*) AS n_grid, (SELECT count(*) FROM mask) AS n_filled, -85.0::DOUBLE AS lat_first, 175.0::DOUBLE AS lon_last FROM range(648)", ("mask",))
def grid_axes_join(spark, sf):
    g = Z.grid(spark, -85.0, -175.0, 10.0, 18, 36)
    m = V.mask(spark, sf).select("ilat", "ilon", F.lit(1).alias("hit"))
    return g.join(m, ["ilat", "ilon"], "left").agg(F.count("*").alias("n_grid"), F.count("hit").alias("n_filled"), F.min("lat").alias("lat_first"), F.max("lon").alias("lon_last"))


@query("Q15_coverage_gates", "SELECT count(*) FILTER (WHERE n_months < 20) AS n_below, min(n_months) >= 20 AS passes_floor, round(avg(CASE WHEN n_months >= 50 THEN 1.0 ELSE 0.0 END), 6) AS share_above, count(*) AS n FROM zonal WHERE nk IS NOT NULL", ("zonal",))
def coverage_gates(spark, sf):
    m = F.col("n_months")
    return V.zonal(spark, sf).where("nk is not null").agg(F.count_if(m < 20).alias("n_below"), (F.min(m) >= 20).alias("passes_floor"), F.round(F.avg((m >= 50).cast("double")), 6).alias("share_above"), F.count("*").alias("n"))
