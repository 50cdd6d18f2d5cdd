"""Inequality indices, rank coupling, strata and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.functions.distributions import spearman_p
from tesserine.operators import coupling as K
from tesserine.operators import inequality as I
from tesserine.operators import ordering as O
from tesserine.operators import tables as B
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.plans.relational_plans import tiers
from tesserine.session import cut_lineage

r6 = C.r6


def site_magnitudes(spark, sf):
    """Positive magnitudes that grow with the data: absolute site trend, with balance weights."""
    return cut_lineage(V.strend(spark, sf).select("site", "nk", F.abs("ols_slope").alias("m"), F.greatest("acct", F.lit(1.0)).alias("w")).where("m > 0"))


MAG = "mag AS (SELECT site, nk, abs(ols_slope) AS m, greatest(acct, 1.0) AS w FROM strend WHERE ols_slope <> 0)"


@query("A27_weighted_dispersion", f"""WITH {MAG}, u AS (SELECT sum(w*m)/sum(w) AS mu FROM mag) SELECT count(*) AS n, round(any_value(mu), 6) AS mean, round(sum(w*(m-mu)*(m-mu))/sum(w), 6) AS variance,
 round(sqrt(sum(w*(m-mu)*(m-mu))/sum(w))/any_value(mu), 6) AS cv FROM mag, u""", ("strend",))
def weighted_dispersion(spark, sf):
    d = I.dispersion(site_magnitudes(spark, sf), "m", F.col("w"))
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "cv")])


@query("A28_coefficient_of_variation", f"WITH {MAG} SELECT round(stddev_pop(m)/avg(m), 6) AS cv FROM mag", ("strend",))
def coefficient_of_variation(spark, sf):
    return I.dispersion(site_magnitudes(spark, sf), "m").select(F.round("cv", 6).alias("cv"))


@query("A29_gini", f"WITH {MAG} SELECT round(sum(a.w*b.w*abs(a.m-b.m))/(2*(SELECT sum(w) FROM mag)*(SELECT sum(w*m) FROM mag)), 6) AS gini FROM mag a, mag b", ("strend",))
def gini(spark, sf):
    return I.gini(site_magnitudes(spark, sf), "m", F.col("w")).select(F.round("gini", 6).alias("gini"))


@query("A30_theil", f"WITH {MAG}, u AS (SELECT sum(w*m)/sum(w) AS mu, sum(w) AS sw FROM mag) SELECT round(sum(w/sw*(m/mu)*ln(m/mu)), 6) AS theil FROM mag, u", ("strend",))
def theil(spark, sf):
    return I.theil(site_magnitudes(spark, sf), "m", F.col("w")).select(F.round("theil", 6).alias("theil"))


ZMAG = MAG + ", zm AS (SELECT u.zone, m.m, m.w FROM mag m JOIN units u ON u.nk = m.nk)"
THEIL_SQL = f"""WITH {ZMAG}, g AS (SELECT zone, sum(m) AS x, count(*) AS c, avg(m) AS mu FROM zm GROUP BY 1), t AS (SELECT sum(x) AS x, sum(x)/sum(c) AS mu FROM g),
 w AS (SELECT zm.zone, sum(m/g.x*ln(m/g.mu)) AS tg FROM zm JOIN g ON g.zone = zm.zone GROUP BY 1)"""


@query("A31_theil_decomposition", THEIL_SQL + """ SELECT g.zone, round(g.x/t.x, 6) AS share, round(g.x/t.x*w.tg, 6)+0.0 AS within, round(g.x/t.x*ln(g.mu/t.mu), 6)+0.0 AS between
 FROM g, t, w WHERE w.zone = g.zone""", ("strend", "units"))
def theil_decomposition(spark, sf):
    d = I.theil_by_group(site_magnitudes(spark, sf).join(V.units(spark, sf), "nk"), "m", "zone")
    return d.select("zone", F.round("share", 6).alias("share"), r6("within").alias("within"), r6("between").alias("between"))


def _bundle(df, group=None, max_rows=None):
    d = I.dispersion(df, "m").withColumn("_k", F.lit(1))
    g = I.gini(df, "m", max_rows=max_rows).withColumn("_k", F.lit(1))
    t = I.theil(df, "m").withColumn("_k", F.lit(1))
    out = d.join(g, "_k").join(t, "_k")
    cols = ["mean", "variance", "cv", "gini", "theil"]
    if group:
        parts = I.theil_by_group(df, "m", group).agg(F.sum("within").alias("theil_within"), F.sum("between").alias("theil_between")).withColumn("_k", F.lit(1))
        out, cols = out.join(parts, "_k"), cols + ["theil_within", "theil_between"]
    return out.select("n", *[r6(c).alias(c) for c in cols])


@query("A32_index_bundle", THEIL_SQL + """, b AS (SELECT count(*) AS n, avg(m) AS mean, var_pop(m) AS variance, stddev_pop(m)/avg(m) AS cv FROM zm),
 gg AS (SELECT sum(abs(a.m-c.m))/(2.0*(SELECT count(*) FROM zm)*(SELECT sum(m) FROM zm)) AS gini FROM zm a, zm c), th AS (SELECT sum(m/(SELECT x FROM t)*ln(m/(SELECT mu FROM t))) AS theil FROM zm),
 p AS (SELECT sum(g.x/t.x*w.tg) AS wi, sum(g.x/t.x*ln(g.mu/t.mu)) AS be FROM g, t, w WHERE w.zone = g.zone)
 SELECT n, round(mean, 6)+0.0 AS mean, round(variance, 6)+0.0 AS variance, round(cv, 6)+0.0 AS cv, round(gini, 6)+0.0 AS gini, round(theil, 6)+0.0 AS theil, round(wi, 6)+0.0 AS theil_within, round(be, 6)+0.0 AS theil_between FROM b, gg, th, p""", ("strend", "units"))
def index_bundle(spark, sf):
    return _bundle(site_magnitudes(spark, sf).join(V.units(spark, sf), "nk"), "zone")


@query("A33_unit_inequality", """WITH z AS (SELECT warming AS m FROM natrend) SELECT (SELECT count(*) FROM z) AS n, round((SELECT avg(m) FROM z), 6)+0.0 AS mean, round((SELECT var_pop(m) FROM z), 6)+0.0 AS variance,
 round((SELECT stddev_pop(m)/avg(m) FROM z), 6)+0.0 AS cv, round((SELECT sum(abs(a.m-b.m)) FROM z a, z b)/(2.0*(SELECT count(*)*sum(m) FROM z)), 6)+0.0 AS gini,
 round((SELECT sum(m/(SELECT sum(m) FROM z)*ln(m/(SELECT avg(m) FROM z))) FROM z), 6)+0.0 AS theil""", ("natrend",))
def unit_inequality(spark, sf):
    # The bundle reads the unit table three times; the facts behind it are scanned once.
    return _bundle(cut_lineage(V.natrend(spark, sf).select(F.col("warming").alias("m"))), max_rows=V.unit_bound(spark, sf))


@query("W3_lorenz_points", f"""WITH {MAG} SELECT round(u, 6)+0.0 AS unit_share, round(v, 6)+0.0 AS value_share FROM (SELECT sum(w) OVER o/sum(w) OVER () AS u, sum(w*m) OVER o/sum(w*m) OVER () AS v FROM mag WINDOW o AS (ORDER BY m, site ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT 0.0, 0.0)""", ("strend",))
def lorenz(spark, sf):
    return I.lorenz_points(site_magnitudes(spark, sf), "m", F.col("w")).select(r6("unit_share").alias("unit_share"), r6("value_share").alias("value_share"))


PROJ = "pr AS (SELECT t.nk, t.warming, t.warming_people, t.warming_area, r.resp, r.resp_cons, r.resp_win FROM natrend t JOIN resp r ON r.nk = t.nk)"
PROJ_VIEWS = ("natrend", "resp")


def projections(spark, sf):
    # The comparison reads this unit table several times; the facts behind it are scanned once.
    return cut_lineage(V.natrend(spark, sf).join(V.resp(spark, sf), "nk").select(
        "nk", "warming", "warming_people", "warming_area", "resp", "resp_cons", "resp_win"))


def coefficient_sql(x: str, y: str, src: str = "pr") -> str:
    return (f"(SELECT abs(1 - 2*sum(({x}/rx)*(2*cy - {y})/ry/2)) FROM (SELECT {x}, {y}, sum({y}) OVER (ORDER BY {x}, nk ROWS UNBOUNDED PRECEDING) AS cy, "
            f"sum({x}) OVER () AS rx, sum({y}) OVER () AS ry FROM {src}))")


def rho_sql(x: str, y: str, src: str = "pr") -> str:
    return (f"(SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2.0 AS a, "
            f"rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1)/2.0 AS b FROM {src}))")


@query("W1_descending_rank", "SELECT site, rank() OVER (ORDER BY n_obs DESC) AS rk FROM trend", ("trend",))
def descending_rank(spark, sf):
    return O.with_rank(V.trend(spark, sf), "n_obs", "rk", descending=True).select("site", "rk")


@query("W2_zscore", "SELECT site, round((ols_slope - (SELECT avg(ols_slope) FROM trend))/(SELECT stddev_pop(ols_slope) FROM trend), 6)+0.0 AS z FROM trend", ("trend",))
def zscore(spark, sf):
    t = cut_lineage(V.trend(spark, sf))
    m = t.agg(F.struct(F.avg("ols_slope").alias("m"), F.stddev_pop("ols_slope").alias("s")).alias("m")).scalar()
    return t.select("site", r6((F.col("ols_slope") - m["m"]) / m["s"]).alias("z"))


@query("W4_concentration_coefficient", f"WITH {PROJ} SELECT round({coefficient_sql('resp', 'warming')}, 6) AS coefficient", PROJ_VIEWS)
def concentration_coefficient(spark, sf):
    return I.concentration_coefficient(projections(spark, sf), "resp", "warming", V.unit_bound(spark, sf)).select(F.round("coefficient", 6).alias("coefficient"))


@query("W14_average_rank", "SELECT site, rank() OVER (ORDER BY n_obs) + (count(*) OVER (PARTITION BY n_obs) - 1)/2.0 AS rk FROM trend", ("trend",))
def average_rank(spark, sf):
    return O.with_rank(V.trend(spark, sf), "n_obs", "rk", "average").select("site", F.col("rk").cast("double").alias("rk"))


@query("W15_false_discovery", """WITH p AS (SELECT site, exp(-abs(ols_slope)) AS p FROM trend), k AS (SELECT site, p, p*count(*) OVER ()/row_number() OVER (ORDER BY p) AS c FROM p)
 SELECT site, round(least(min(c) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS q FROM k""", ("trend",))
def false_discovery(spark, sf):
    p = V.trend(spark, sf).select("site", F.exp(-F.abs("ols_slope")).alias("p"))
    return K.bh_adjust(p, "p", "q").select("site", F.round("q", 6).alias("q"))


def coupling_sql(x: str, y: str) -> str:
    return f"""SELECT nk, round({x}, 4) AS x, round({y}, 6) AS y, rank() OVER (ORDER BY {x} DESC) AS responsibility_rank, rank() OVER (ORDER BY {y} DESC) AS impact_rank,
 rank() OVER (ORDER BY {y} DESC) - rank() OVER (ORDER BY {x} DESC) AS rank_gap, round(({y} - avg({y}) OVER ())/stddev_pop({y}) OVER () - ({x} - avg({x}) OVER ())/stddev_pop({x}) OVER (), 6)+0.0 AS z_gap FROM pr"""


def _table(spark, sf, x, y):
    t = K.coupling_table(projections(spark, sf), x, y, V.unit_bound(spark, sf))
    return t.select("nk", F.round(x, 4).alias("x"), F.round(y, 6).alias("y"), "responsibility_rank", "impact_rank", "rank_gap", r6("z_gap").alias("z_gap"))


def summary_sql(x: str, y: str) -> str:
    return f"""SELECT count(*) AS n, count(*) FILTER (WHERE ({y} - my)/sy - ({x} - mx)/sx > 0) AS n_high_impact, round({rho_sql(x, y)}, 6)+0.0 AS rho, round({coefficient_sql(x, y)}, 6)+0.0 AS coefficient
 FROM pr, (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx, avg({y}) AS my, stddev_pop({y}) AS sy FROM pr)"""


def _summary(spark, sf, x, y):
    s = K.coupling_summary(projections(spark, sf), x, y, V.unit_bound(spark, sf))
    return s.select("n", "n_high_impact", r6("rho").alias("rho"), r6("coefficient").alias("coefficient"))


LENSES = {"C1_coupling": ("resp", "warming"), "C2_consumption_lens": ("resp_cons", "warming"), "C2_production_shift": ("resp_win", "resp_cons"),
          "C3_people_lens": ("resp", "warming_people"), "C3_station_to_people": ("warming", "warming_people"),
          "C4_area_lens": ("resp", "warming_area"), "C4_station_to_area": ("warming", "warming_area")}


def _register_lenses():
    for name, (x, y) in LENSES.items():
        query(f"{name}_table", f"WITH {PROJ} {coupling_sql(x, y)}", PROJ_VIEWS)(lambda spark, sf, x=x, y=y: _table(spark, sf, x, y))
        query(f"{name}_summary", f"WITH {PROJ} {summary_sql(x, y)}", PROJ_VIEWS)(lambda spark, sf, x=x, y=y: _summary(spark, sf, x, y))


_register_lenses()


@query("T1_gap_leaders", f"""WITH {PROJ}, g AS (SELECT u.unit AS label, (warming - avg(warming) OVER ())/stddev_pop(warming) OVER () - (resp - avg(resp) OVER ())/stddev_pop(resp) OVER () AS z FROM pr JOIN units u ON u.nk = pr.nk)
 (SELECT label, round(z, 6)+0.0 AS z_gap, 'suffers most, causes least' AS side FROM g ORDER BY z DESC, label DESC LIMIT 10) UNION ALL (SELECT label, round(z, 6)+0.0, 'causes most, suffers least' FROM g ORDER BY z, label LIMIT 10)""", PROJ_VIEWS + ("units",))
def gap_leaders(spark, sf):
    named = projections(spark, sf).join(V.units(spark, sf), "nk")
    return K.gap_leaders(named, "unit", "resp", "warming").withColumn("z_gap", r6("z_gap"))


@query("C5_closed_columns", f"WITH {PROJ} SELECT nk, round(resp, 4) AS responsibility_index, round(warming, 6) AS impact_index FROM pr", PROJ_VIEWS)
def closed_columns(spark, sf):
    frame = projections(spark, sf).select("nk", F.round("resp", 4).alias("responsibility_index"), F.round("warming", 6).alias("impact_index"))
    return K.require_columns(frame, {"nk", "responsibility_index", "impact_index"})


@query("C6_log_responsibility_models", f"""WITH {PROJ}, d AS (SELECT pr.nk, u.zone, warming AS y, log10(resp) AS x FROM pr JOIN units u ON u.nk = pr.nk), m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM d),
 f AS (SELECT regr_slope(y - zy, x - zx) AS fe FROM (SELECT y, x, avg(y) OVER (PARTITION BY zone) AS zy, avg(x) OVER (PARTITION BY zone) AS zx FROM d))
 SELECT round({rho_sql('resp', 'warming')}, 6)+0.0 AS rho, round(any_value(b), 6)+0.0 AS slope, round(sqrt(any_value(n)/(any_value(n)-2.0)*sum((x-mx)*(x-mx)*(y-a-b*x)*(y-a-b*x)))/sum((x-mx)*(x-mx)), 6) AS se_hc1, round(any_value(fe), 6)+0.0 AS within_zone_slope FROM d, m, f""", PROJ_VIEWS + ("units",))
def log_models(spark, sf):
    p = projections(spark, sf).join(V.units(spark, sf), "nk").where("resp > 0")
    d = p.select("zone", F.col("warming").alias("y"), F.log10("resp").alias("x"))
    m = d.agg(F.struct(F.avg("x").alias("mx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n")).alias("m")).scalar()
    e = F.col("y") - m["a"] - m["b"] * F.col("x")
    dx = F.col("x") - m["mx"]
    se = F.sqrt(m["n"] / (m["n"] - 2.0) * F.sum(dx * dx * e * e)) / F.sum(dx * dx)
    means = d.groupBy("zone").agg(F.avg("x").alias("zx"), F.avg("y").alias("zy"))
    within = d.join(means, "zone").agg(F.regr_slope(F.col("y") - F.col("zy"), F.col("x") - F.col("zx")).alias("fe"))
    rho = I.spearman(p, "resp", "warming", max_rows=V.unit_bound(spark, sf)).select("rho")
    return d.agg(r6(F.first(rho.scalar())).alias("rho"), r6(F.first(m["b"])).alias("slope"), F.round(se, 6).alias("se_hc1"), r6(F.first(within.scalar())).alias("within_zone_slope"))


@query("C7_spearman_min_n", f"WITH s AS (SELECT ols_slope AS a, acct AS b FROM strend WHERE acct > 0) SELECT count(*) AS n, round({rho_sql('a', 'b', 's')}, 6)+0.0 AS rho FROM s", ("strend",))
def spearman_min_n(spark, sf):
    s = V.strend(spark, sf).select(F.col("ols_slope").alias("a"), F.when(F.col("acct") > 0, F.col("acct")).alias("b"))
    return I.spearman(s, "a", "b").select("n", r6("rho").alias("rho"))


@query("C7_spearman_asymptotic")
def spearman_asymptotic(spark, sf):
    s = V.strend(spark, sf).select(F.col("ols_slope").alias("a"), F.col("acct").alias("b"))
    return I.spearman(s, "a", "b").select("n", r6("rho").alias("rho"), r6(spearman_p("rho", F.col("n").cast("double"))).alias("p"))


def cross_products(spark, sf):
    """Unit warming of both products on their own and on common support."""
    area = V.zonal(spark, sf).where("nk is not null").groupBy("nk").agg(
        (F.sum(F.col("w") * F.abs("slope")) / F.sum("w")).alias("second"), F.count("*").alias("n_cells")).where("n_cells >= 22").drop("n_cells")
    return cut_lineage(projections(spark, sf).join(area, "nk", "left"))


XP = PROJ + ", xa AS (SELECT nk, sum(w*abs(slope))/sum(w) AS second FROM zonal WHERE nk IS NOT NULL GROUP BY 1 HAVING count(*) >= 22), xp AS (SELECT pr.*, xa.second FROM pr LEFT JOIN xa ON xa.nk = pr.nk), xc AS (SELECT * FROM xp WHERE second IS NOT NULL)"


@query("C8_cross_product_metrics", f"""WITH {XP} SELECT (SELECT count(*) FROM xp) AS n_first, (SELECT count(*) FROM xc) AS n_common, round({rho_sql('resp', 'warming', 'xp')}, 6)+0.0 AS rho_first,
 round({rho_sql('resp', 'warming', 'xc')}, 6)+0.0 AS rho_first_common, round({rho_sql('resp', 'second', 'xc')}, 6)+0.0 AS rho_second, round({rho_sql('warming', 'second', 'xc')}, 6)+0.0 AS rho_products""", PROJ_VIEWS + ("zonal",))
def cross_product_metrics(spark, sf):
    n = V.unit_bound(spark, sf)
    both = cross_products(spark, sf)
    common = both.where("second is not null")
    def rho(df, a, b):
        return r6(F.first(I.spearman(df, a, b, max_rows=n).select("rho").scalar()))
    return both.agg(F.count("*").alias("n_first"), F.count("second").alias("n_common"), rho(both, "resp", "warming").alias("rho_first"),
                    rho(common, "resp", "warming").alias("rho_first_common"), rho(common, "resp", "second").alias("rho_second"), rho(common, "warming", "second").alias("rho_products"))


#: Lens, its column, support, and the table expression that holds the support.
LENSES = (("station", "warming", "own", "xp"), ("people", "warming_people", "own", "xp"), ("second product", "second", "own", "xc"),
          ("station", "warming", "common", "xc"), ("people", "warming_people", "common", "xc"))
LENS_SQL = " UNION ALL ".join(
    f"SELECT '{lens}' AS lens, '{support}' AS support, (SELECT count({y}) FROM {src}) AS n, round({rho_sql('resp', y, src)}, 6)+0.0 AS rho, "
    f"round({coefficient_sql('resp', y, src)}, 6)+0.0 AS coefficient" for lens, y, support, src in LENSES)


@query("C8_lens_metrics", f"WITH {XP} {LENS_SQL}", PROJ_VIEWS + ("zonal",))
def lens_metrics(spark, sf):
    """Rank correlation and concentration coefficient of every lens, on its own units and on those of both products."""
    n, both, out = V.unit_bound(spark, sf), cross_products(spark, sf), None
    for lens, y, support, src in LENSES:
        df = both if src == "xp" else both.where("second is not null")
        row = I.spearman(df, "resp", y, max_rows=n).select(F.lit(lens).alias("lens"), F.lit(support).alias("support"), "n", r6("rho").alias("rho"), F.lit(1).alias("_k"))
        row = row.join(I.concentration_coefficient(df, "resp", y, n).select(r6("coefficient").alias("coefficient"), F.lit(1).alias("_k")), "_k").drop("_k")
        out = row if out is None else out.unionByName(row)
    return out


# -- strata --------------------------------------------------------------------

TIERS = """q AS (SELECT quantile_cont(wealth, 0.25) AS a, quantile_cont(wealth, 0.5) AS b, quantile_cont(wealth, 0.75) AS c FROM wealth),
 st AS (SELECT w.nk, CASE WHEN wealth <= a THEN 0 WHEN wealth <= b THEN 1 WHEN wealth <= c THEN 2 ELSE 3 END AS tier, t.warming, t.warming_area, r.resp, s.vuln, w.n_customers FROM wealth w, q, natrend t, resp r, score s WHERE t.nk = w.nk AND r.nk = w.nk AND s.nk = w.nk)"""
STRATA_VIEWS = ("wealth", "natrend", "resp", "score")


def strata(spark, sf):
    return cut_lineage(
        tiers(spark, sf).join(V.natrend(spark, sf), "nk").join(V.resp(spark, sf), "nk").join(V.score(spark, sf).select("nk", "vuln"), "nk")
        .select("nk", "tier", "warming", "warming_area", "resp", "vuln", "n_customers"))


def gradient_sql(v: str, o: str, name: str, draws: int = 999, src: str = "st") -> str:
    """Observed rank correlation and its permutation p as named table expressions."""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0"
    return f"""{name}_r AS (SELECT nk, {rank(v)} AS rv, {rank(o)} AS ro, row_number() OVER (ORDER BY nk) AS i FROM {src}),
 {name}_o AS (SELECT corr(rv, ro) AS rho, count(*) AS n FROM {name}_r),
 {name}_p AS (SELECT d.draw, a.nk, a.rv, row_number() OVER (PARTITION BY d.draw ORDER BY md5('0|' || d.draw || '|' || a.nk)) AS i FROM {name}_r a, (SELECT unnest(range(1, {draws + 1})) AS draw) d),
 {name}_s AS (SELECT p.draw, corr(p.rv, r.ro) AS rho FROM {name}_p p JOIN {name}_r r ON r.i = p.i GROUP BY 1),
 {name} AS (SELECT any_value(o.n) AS n, any_value(o.rho) AS rho, (count(*) FILTER (WHERE abs(s.rho) >= abs(o.rho) - 1e-12) + 1)/{draws + 1.0} AS p FROM {name}_s s, {name}_o o)"""


@query("C9_ordinal_gradient", f"WITH {TIERS}, {gradient_sql('warming', 'tier', 'g')} SELECT n, round(rho, 6)+0.0 AS rho, round(p, 6) AS p_permutation FROM g", STRATA_VIEWS)
def ordinal_gradient(spark, sf):
    g = K.spearman_gradient(strata(spark, sf), "nk", "warming", "tier", max_rows=V.unit_bound(spark, sf))
    return g.select("n", r6("rho").alias("rho"), F.round("p_permutation", 6).alias("p_permutation"))


@query("C10_strata_table", f"WITH {TIERS} SELECT u.unit, CAST(tier AS BIGINT) AS tier, round(warming, 6) AS warming, round(resp, 4) AS resp FROM st JOIN units u ON u.nk = st.nk", STRATA_VIEWS + ("units",))
def strata_table(spark, sf):
    return strata(spark, sf).join(V.units(spark, sf), "nk").select("unit", "tier", F.round("warming", 6).alias("warming"), F.round("resp", 4).alias("resp")).orderBy("unit")


@query("C11_stratification", f"""WITH {TIERS} SELECT lens, CAST(tier AS BIGINT) AS tier, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(sum(v*n_customers)/sum(n_customers), 6) AS weighted
 FROM (SELECT tier, n_customers, 'area' AS lens, warming_area AS v FROM st UNION ALL SELECT tier, n_customers, 'responsibility', resp/1e6 FROM st UNION ALL SELECT tier, n_customers, 'station', warming FROM st) GROUP BY 1, 2""", STRATA_VIEWS)
def stratification(spark, sf):
    long = (strata(spark, sf).select("tier", "n_customers", F.col("warming").alias("station"), F.col("warming_area").alias("area"), (F.col("resp") / 1e6).alias("responsibility"))
            .unpivot(["tier", "n_customers"], ["station", "area", "responsibility"], "lens", "v"))
    return long.groupBy("lens", "tier").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"),
                                            F.round(B.weighted_mean(F.col("v"), F.col("n_customers").cast("double")), 6).alias("weighted"))


@query("C12_score_gradients", f"""WITH {TIERS}, {gradient_sql('resp', 'vuln', 'a')}, {gradient_sql('warming', 'vuln', 'b')}, {gradient_sql('warming_area', 'vuln', 'c')}
 SELECT 'responsibility' AS lens, n, round(rho, 6)+0.0 AS rho, round(p, 6) AS p FROM a UNION ALL SELECT 'station', n, round(rho, 6)+0.0, round(p, 6) FROM b UNION ALL SELECT 'area', n, round(rho, 6)+0.0, round(p, 6) FROM c""", STRATA_VIEWS)
def score_gradients(spark, sf):
    s, n = strata(spark, sf), V.unit_bound(spark, sf)
    out = None
    for lens, col in (("responsibility", "resp"), ("station", "warming"), ("area", "warming_area")):
        g = K.spearman_gradient(s, "nk", col, "vuln", max_rows=n).select(F.lit(lens).alias("lens"), "n", r6("rho").alias("rho"), F.round("p_permutation", 6).alias("p"))
        out = g if out is None else out.unionByName(g)
    return out


VERDICT_COLS = "round(a.rho, 6)+0.0 AS r_rho, round(a.p, 6) AS r_p, round(b.rho, 6)+0.0 AS a_rho, round(b.p, 6) AS a_p, '' AS reasons"


def _verdict(spark, sf, ordinal, direction):
    s, n = strata(spark, sf), V.unit_bound(spark, sf)
    v = K.gradient_verdict(K.spearman_gradient(s, "nk", "resp", ordinal, max_rows=n), K.spearman_gradient(s, "nk", "warming_area", ordinal, max_rows=n), direction)
    return v.select(*[r6(c).alias(c) for c in ("r_rho", "r_p", "a_rho", "a_p")], "holds", "status", "reasons")


RISES = "a.rho > 0 AND a.p < 0.05 AND abs(b.rho) < abs(a.rho) AND b.p >= 0.05"
FALLS = "a.rho < 0 AND a.p < 0.05 AND (b.rho >= 0 OR b.p >= 0.05)"


@query("C13_tier_verdict", f"WITH {TIERS}, {gradient_sql('resp', 'tier', 'a')}, {gradient_sql('warming_area', 'tier', 'b')} SELECT {VERDICT_COLS}, {RISES} AS holds, CASE WHEN {RISES} THEN 'supported' ELSE 'not_supported' END AS status FROM a, b", STRATA_VIEWS)
def tier_verdict(spark, sf):
    return _verdict(spark, sf, "tier", 1)


@query("C14_direct_verdict", f"WITH {TIERS}, {gradient_sql('resp', 'vuln', 'a')}, {gradient_sql('warming_area', 'vuln', 'b')} SELECT {VERDICT_COLS}, {FALLS} AS holds, CASE WHEN {FALLS} THEN 'supported' ELSE 'not_supported' END AS status FROM a, b", STRATA_VIEWS)
def direct_verdict(spark, sf):
    return _verdict(spark, sf, "vuln", -1)


@query("C15_missing_evidence", "SELECT 'insufficient_evidence' AS status, 'responsibility.rho; responsibility.p_permutation; responsibility: constant_input' AS reasons, false AS holds, count(*) AS n FROM natrend", ("natrend",))
def missing_evidence(spark, sf):
    n = V.unit_bound(spark, sf)
    flat = strata(spark, sf).withColumn("flat", F.lit(1.0))
    v = K.gradient_verdict(K.spearman_gradient(flat, "nk", "flat", "tier", max_rows=n), K.spearman_gradient(flat, "nk", "warming", "tier", max_rows=n), 1)
    return v.select("status", "reasons", "holds").withColumn("n", V.natrend(spark, sf).agg(F.count("*")).scalar())


@query("C16_definition_comparison", f"WITH {PROJ} SELECT 'area' AS definition, count(*) AS n, round({rho_sql('warming_area', 'resp')}, 6)+0.0 AS rho FROM pr UNION ALL SELECT 'people', count(*), round({rho_sql('warming_people', 'resp')}, 6)+0.0 FROM pr UNION ALL SELECT 'station', count(*), round({rho_sql('warming', 'resp')}, 6)+0.0 FROM pr", PROJ_VIEWS)
def definition_comparison(spark, sf):
    long = (projections(spark, sf).select("resp", F.col("warming").alias("station"), F.col("warming_people").alias("people"), F.col("warming_area").alias("area"))
            .unpivot(["resp"], ["station", "people", "area"], "definition", "v"))
    return I.spearman(long, "v", "resp", by=["definition"], max_rows=V.unit_bound(spark, sf)).select("definition", "n", r6("rho").alias("rho"))


@query("C17_both_correlations", f"WITH {PROJ} SELECT count(*) AS n, round(corr(warming, resp), 6)+0.0 AS pearson, round({rho_sql('warming', 'resp')}, 6)+0.0 AS spearman FROM pr", PROJ_VIEWS)
def both_correlations(spark, sf):
    p = projections(spark, sf)
    rho = I.spearman(p, "warming", "resp", max_rows=V.unit_bound(spark, sf)).select("rho").scalar()
    return p.agg(F.count("*").alias("n"), r6(B.pair_corr(F.col("warming"), F.col("resp"))).alias("pearson"), r6(F.first(rho)).alias("spearman"))


DESCRIPTORS = ("lat", "lon", "elev", "population", "resp", "vuln", "wealth")
TARGETS = ("trend", "warming")


@query("C18_descriptor_scan", " UNION ALL ".join(f"SELECT '{d}' AS descriptor, '{t}' AS target, round(corr({d}, {t}), 6)+0.0 AS pearson, round({rho_sql(d, t, 'country')}, 6)+0.0 AS spearman FROM country" for d in DESCRIPTORS for t in TARGETS), ("country",))
def descriptor_scan(spark, sf):
    n = V.unit_bound(spark, sf) * len(DESCRIPTORS) * len(TARGETS)
    c = cut_lineage(V.country(spark, sf)).select(*TARGETS, *[F.col(d).cast("double").alias(d) for d in DESCRIPTORS])
    long = c.unpivot(list(TARGETS), list(DESCRIPTORS), "descriptor", "d").unpivot(["descriptor", "d"], list(TARGETS), "target", "t")
    by = ["descriptor", "target"]
    pearson = long.groupBy(*by).agg(r6(B.pair_corr(F.col("d"), F.col("t"))).alias("pearson"))
    return pearson.join(I.spearman(long, "d", "t", by=by, max_rows=n).select(*by, r6("rho").alias("spearman")), by)


@query("C19_product_disagreement", f"""WITH {XP} SELECT count(*) AS n, round(corr(warming, second), 6)+0.0 AS pearson, round(regr_r2(second, warming), 6) AS r2, round(max(abs(warming - second)), 6) AS largest_gap, arg_max(nk, abs(warming - second)) AS at_unit FROM xc""", PROJ_VIEWS + ("zonal",))
def product_disagreement(spark, sf):
    c = cross_products(spark, sf).where("second is not null")
    gap = F.abs(F.col("warming") - F.col("second"))
    return c.agg(F.count("*").alias("n"), r6(B.pair_corr(F.col("warming"), F.col("second"))).alias("pearson"), F.round(F.regr_r2("second", "warming"), 6).alias("r2"),
                 F.round(F.max(gap), 6).alias("largest_gap"), F.max_by("nk", gap).alias("at_unit"))


@query("C20_residual_agreement", """WITH a AS (SELECT nk, warming - (regr_intercept(warming, abs(lat)) OVER () + regr_slope(warming, abs(lat)) OVER ()*abs(lat)) AS e FROM natrend), b AS (SELECT nk, warming_area - (regr_intercept(warming_area, abs(lat)) OVER () + regr_slope(warming_area, abs(lat)) OVER ()*abs(lat)) AS e FROM natrend)
 SELECT count(*) AS n, round(corr(a.e, b.e), 6)+0.0 AS r FROM a JOIN b ON a.nk = b.nk""", ("natrend",))
def residual_agreement(spark, sf):
    t = cut_lineage(V.natrend(spark, sf)).withColumn("a", F.abs("lat"))
    f = t.agg(F.struct(*[fn(y, "a").alias(f"{k}_{y}") for y in ("warming", "warming_area") for k, fn in (("b", F.regr_slope), ("c", F.regr_intercept))]).alias("f")).scalar()
    def e(y):
        return F.col(y) - f[f"c_{y}"] - f[f"b_{y}"] * F.col("a")
    return t.agg(F.count("*").alias("n"), r6(B.pair_corr(e("warming"), e("warming_area"))).alias("r"))


# -- lens resolution -----------------------------------------------------------

@query("R9_projection_resolve", f"WITH {PROJ} SELECT u.unit AS country, round(resp, 4) AS responsibility_index, round(warming, 6) AS impact_index FROM pr JOIN units u ON u.nk = pr.nk", PROJ_VIEWS + ("units",))
def projection_resolve(spark, sf):
    p = projections(spark, sf).join(V.units(spark, sf), "nk")
    return K.require_columns(p.select(F.col("unit").alias("country"), F.round("resp", 4).alias("responsibility_index"), F.round("warming", 6).alias("impact_index")), {"country", "responsibility_index", "impact_index"})


def _lens(name, cols, drop_rule):
    sql_cols = ", ".join(f"round(CASE WHEN {drop_rule} THEN NULL ELSE {c} END, 4) AS {a}" for c, a in cols)
    first = cols[0][0]
    @query(name, f"WITH {PROJ} SELECT * FROM (SELECT nk, {sql_cols} FROM pr) WHERE {' AND '.join(a + ' IS NOT NULL' for _, a in cols)}", PROJ_VIEWS)
    def lens(spark, sf):
        missing = F.expr(drop_rule)
        p = projections(spark, sf).select("nk", *[F.round(F.when(~missing, F.col(c)), 4).alias(a) for c, a in cols])
        return p.dropna(how="any", subset=[a for _, a in cols])
    return lens


_lens("R10_consumption_lens", (("resp_cons", "consumption_index"), ("resp_win", "production_matched_index")), "resp_cons < resp_win")
_lens("R11_people_lens", (("warming_people", "people_index"), ("resp", "responsibility_index")), "warming_people < warming")
_lens("R12_area_lens", (("warming_area", "area_index"), ("resp", "responsibility_index")), "warming_area < warming")


@query("R14_national_definitions", f"WITH {XP} SELECT xp.nk, round(warming, 6) AS station, round(warming_people, 6) AS people, round(warming_area, 6) AS area, round(second, 6) AS second_product FROM xp", PROJ_VIEWS + ("zonal",))
def national_definitions(spark, sf):
    return cross_products(spark, sf).select("nk", F.round("warming", 6).alias("station"), F.round("warming_people", 6).alias("people"), F.round("warming_area", 6).alias("area"), F.round("second", 6).alias("second_product"))
