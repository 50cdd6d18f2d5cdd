"""Linear models, variance decomposition, cross-validation, spatial regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import folds as FO
from tesserine.operators import linear as L
from tesserine.operators import spatial as S
from tesserine.operators import spatial_regression as SR
from tesserine.operators import tables as B
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.plans.spatial_plans import DS
from tesserine.session import cut_lineage

r6 = C.r6

GROUPS = {"geography": ["abs_lat", "elev"], "socioeconomic": ["wealth", "vuln"], "population": ["log_pop"], "responsibility": ["log_resp"]}
ALL = [c for cols in GROUPS.values() for c in cols]


def design(spark, sf):
    """Unit design: outcome and numeric predictors, logs of positive magnitudes."""
    c = V.country(spark, sf).where("resp > 0 and population > 0 and cum_production > 0")
    return cut_lineage(c.select(
        "nk", "unit", "zone", "warming", "warming_area", F.abs("lat").alias("abs_lat"), "elev", "wealth", "vuln",
        F.log10("population").alias("log_pop"), F.log10("resp").alias("log_resp"), F.log10("cum_production").alias("log_cum"), "lat", "lon"))


def site_design(spark, sf):
    """Site-level design whose size grows with the data."""
    return cut_lineage(V.strend(spark, sf).join(V.units(spark, sf), "nk").select(
        "site", "nk", "zone", F.col("ols_slope").alias("y"), F.abs("lat").alias("x"), (F.col("acct") / 1000.0).alias("a")))


SITE = "sd AS (SELECT t.site, t.nk, u.zone, t.ols_slope AS y, abs(t.lat) AS x, t.acct/1000.0 AS a FROM strend t JOIN units u ON u.nk = t.nk)"
SITE_VIEWS = ("strend", "units")
ONE = SITE + ", m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_intercept(y, x) AS c, var_pop(x)*count(*) AS sxx, regr_r2(y, x) AS r2 FROM sd), er AS (SELECT sd.*, y - m.c - m.b*x AS e, x - m.mx AS dx FROM sd, m)"


@query("M1_robust_terms", f"WITH {ONE} SELECT round(any_value(m.b), 6)+0.0 AS coef, round(sqrt(any_value(m.n)/(any_value(m.n)-2.0)*sum(dx*dx*e*e))/any_value(m.sxx), 6) AS se, round(any_value(m.r2), 6) AS r2 FROM er, m", SITE_VIEWS)
def robust_terms(spark, sf):
    return L.robust_terms(site_design(spark, sf), ["x"], "y").where("term = 'x'").select(r6("coef").alias("coef"), r6("se").alias("se"), r6("r2").alias("r2"))


@query("M1_country_models")
def country_models(spark, sf):
    d = design(spark, sf)
    out = None
    for name, cols in {"latitude": ["abs_lat"], "responsibility": ["log_resp"], "both": ["abs_lat", "log_resp"], "elevation": ["abs_lat", "elev"],
                       "wealth": ["abs_lat", "wealth"], "full": ALL}.items():
        t = L.robust_terms(d, cols, "warming").withColumn("model", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out.select("model", "term", *[r6(c).alias(c) for c in ("coef", "se", "p", "ci_low", "ci_high", "r2")])


@query("M2_cluster_errors", f"WITH {ONE}, s AS (SELECT nk, sum(dx*e) AS s FROM er GROUP BY 1), g AS (SELECT count(*) AS k, sum(s*s) AS ss FROM s) SELECT round(m.b, 6)+0.0 AS coef, round(sqrt(g.k/(g.k-1.0)*(m.n-1.0)/(m.n-2.0)*g.ss)/m.sxx, 6) AS se FROM m, g", SITE_VIEWS)
def cluster_errors(spark, sf):
    return L.robust_terms(site_design(spark, sf), ["x"], "y", cluster="nk").where("term = 'x'").select(r6("coef").alias("coef"), r6("se").alias("se"))


TWO = SITE + """, r AS (SELECT corr(y, x) AS yx, corr(y, a) AS ya, corr(x, a) AS xa FROM sd), q AS (SELECT yx*yx AS r1, ya*ya AS r2, (yx*yx + ya*ya - 2*yx*ya*xa)/(1 - xa*xa) AS r12, xa FROM r)"""


@query("M3_specification_comparison", f"WITH {TWO} SELECT 'latitude' AS spec, round(r1, 6) AS r2 FROM q UNION ALL SELECT 'balance', round(r2, 6) FROM q UNION ALL SELECT 'both', round(r12, 6) FROM q", SITE_VIEWS)
def specification_comparison(spark, sf):
    d = site_design(spark, sf)
    out = None
    for name, cols in {"latitude": ["x"], "balance": ["a"], "both": ["x", "a"]}.items():
        row = L.fit(d, cols, "y").select(F.lit(name).alias("spec"), r6("r2").alias("r2"))
        out = row if out is None else out.unionByName(row)
    return out


@query("M4_partial_r2", f"WITH {TWO} SELECT 'latitude' AS term, round((r12-r2)/(1-r2), 6)+0.0 AS partial_r2 FROM q UNION ALL SELECT 'balance', round((r12-r1)/(1-r1), 6)+0.0 FROM q", SITE_VIEWS)
def partial_r2(spark, sf):
    return L.partial_r2(site_design(spark, sf), {"latitude": ["x"], "balance": ["a"]}, "y").select("term", r6("partial_r2").alias("partial_r2"))


DESIGN = "dg AS (SELECT nk, unit, zone, warming, warming_area, abs(lat) AS abs_lat, elev, wealth, vuln, log10(population) AS log_pop, log10(resp) AS log_resp, log10(cum_production) AS log_cum, lat, lon FROM country)"


@query("M5_model_table", f"WITH {DESIGN} SELECT unit, round(warming, 6) AS warming, round(abs_lat, 6) AS abs_lat, round(log_resp, 6) AS log_resp FROM dg", ("country",))
def model_table(spark, sf):
    return design(spark, sf).select("unit", F.round("warming", 6).alias("warming"), F.round("abs_lat", 6).alias("abs_lat"), F.round("log_resp", 6).alias("log_resp"))


@query("M6_term_table")
def term_table(spark, sf):
    t = L.robust_terms(site_design(spark, sf), ["x", "a"], "y")
    return t.select("term", *[r6(c).alias(c) for c in ("coef", "se", "z", "p", "ci_low", "ci_high")])


@query("M7_block_r2", f"WITH {TWO} SELECT round(r12, 6) AS r2 FROM q", SITE_VIEWS)
def block_r2(spark, sf):
    return L.fit(site_design(spark, sf), ["x", "a"], "y").select(r6("r2").alias("r2"))


@query("M7_rank_deficient_r2", f"WITH {TWO} SELECT round(r12, 6) AS r2 FROM q", SITE_VIEWS)
def rank_deficient_r2(spark, sf):
    d = site_design(spark, sf).withColumn("dup", 2.0 * F.col("x") - 3.0 * F.col("a") + 1.0)
    return L.fit(d, ["x", "a", "dup"], "y").select(r6("r2").alias("r2"))


SHARES2 = "SELECT '{a}' AS \"group\", round((r1 + r12 - r2)/2, 6)+0.0 AS share FROM q UNION ALL SELECT '{b}', round((r2 + r12 - r1)/2, 6)+0.0 FROM q UNION ALL SELECT 'residual', round(1 - r12, 6)+0.0 FROM q"


@query("M8_group_shares", f"WITH {TWO} " + SHARES2.format(a="geography", b="economy"), SITE_VIEWS)
def group_shares(spark, sf):
    return L.group_shares(site_design(spark, sf), {"geography": ["x"], "economy": ["a"]}, "y").select("group", r6("share").alias("share"))


@query("M10_country_design", f"WITH {DESIGN} SELECT unit, zone, round(warming, 6) AS warming, round(log_pop, 6) AS log_pop, round(wealth, 4) AS wealth FROM dg", ("country",))
def country_design(spark, sf):
    return design(spark, sf).select("unit", "zone", F.round("warming", 6).alias("warming"), F.round("log_pop", 6).alias("log_pop"), F.round("wealth", 4).alias("wealth"))


def _samples(spark, sf):
    """The area outcome on the units with enough cells, the station outcome on the same units, and on all units."""
    d = design(spark, sf)
    enough = V.zonal(spark, sf).where("nk is not null").groupBy("nk").agg(F.count("*").alias("c")).where("c >= 22").select("nk")
    primary = cut_lineage(d.join(enough, "nk", "left_semi"))
    return {"area": (primary, "warming_area"), "station, same units": (primary, "warming"), "station, all units": (d, "warming")}


def _decomposed(spark, sf, groups):
    out = None
    for name, (frame, y) in _samples(spark, sf).items():  # three samples
        s = L.group_shares(frame, groups, y).withColumn("sample", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("sample", "group", r6("share").alias("share"))


@query("M11_decompositions")
def decompositions(spark, sf):
    return _decomposed(spark, sf, GROUPS)


SAMPLES = DESIGN + """, pr AS (SELECT * FROM dg WHERE nk IN (SELECT nk FROM zonal WHERE nk IS NOT NULL GROUP BY 1 HAVING count(*) >= 22)),
 l AS (SELECT 'area' AS sample, warming_area AS y, abs_lat AS x, wealth AS a FROM pr UNION ALL SELECT 'station, same units', warming, abs_lat, wealth FROM pr
  UNION ALL SELECT 'station, all units', warming, abs_lat, wealth FROM dg),
 c AS (SELECT sample, corr(y, x) AS yx, corr(y, a) AS ya, corr(x, a) AS xa FROM l GROUP BY 1),
 q AS (SELECT sample, yx*yx AS r1, ya*ya AS r2, (yx*yx + ya*ya - 2*yx*ya*xa)/(1 - xa*xa) AS r12 FROM c)"""


@query("M11_reduced_decompositions", f"""WITH {SAMPLES} SELECT sample, 'geography' AS "group", round((r1 + r12 - r2)/2, 6)+0.0 AS share FROM q
 UNION ALL SELECT sample, 'socioeconomic', round((r2 + r12 - r1)/2, 6)+0.0 FROM q UNION ALL SELECT sample, 'residual', round(1 - r12, 6)+0.0 FROM q""", ("country", "zonal"))
def reduced_decompositions(spark, sf):
    return _decomposed(spark, sf, {"geography": ["abs_lat"], "socioeconomic": ["wealth"]})


@query("M12_model_residuals", f"WITH {ONE} SELECT site, round(e, 6)+0.0 AS residual FROM er", SITE_VIEWS)
def model_residuals(spark, sf):
    d = site_design(spark, sf)
    beta = L.fit(d, ["x"], "y").select("beta").scalar()
    return d.select("site", r6(F.col("y") - L.predicted(beta, ["x"])).alias("residual"))


@query("M13_influence", f"""WITH {ONE}, h AS (SELECT er.*, 1.0/m.n + dx*dx/m.sxx AS h, m.n FROM er, m), s AS (SELECT sum(e*e) AS rss FROM er)
 SELECT site, round(h, 6) AS leverage, round(e/sqrt((s.rss - e*e/(1-h))/(n-3)*(1-h)), 5)+0.0 AS studentized, round(e*e/(2*s.rss/(n-2))*h/((1-h)*(1-h)), 6) AS cooks_d FROM h, s""", SITE_VIEWS)
def influence(spark, sf):
    return L.influence(site_design(spark, sf).select("site", "x", "y"), ["x"], "y").select(
        "site", r6("leverage").alias("leverage"), r6("studentized", 5).alias("studentized"), r6("cooks_d").alias("cooks_d"))


@query("M14_log_identity", f"WITH {DESIGN}, i AS (SELECT log_resp - log_cum + log_pop AS v FROM dg) SELECT round(avg(v), 6) AS identity_mean, max(abs(v - (SELECT avg(v) FROM i))) < 1e-9 AS exact FROM i", ("country",))
def log_identity(spark, sf):
    d = design(spark, sf).select((F.col("log_resp") - F.col("log_cum") + F.col("log_pop")).alias("v"))
    mean = d.agg(F.avg("v")).scalar()
    return d.agg(r6(F.avg("v")).alias("identity_mean"), (F.max(F.abs(F.col("v") - mean)) < 1e-9).alias("exact"))


@query("M14_collinearity")
def collinearity(spark, sf):
    r = L.redundancy(design(spark, sf), ["log_resp", "log_cum", "abs_lat"], "log_pop")
    return r.select("rank", "rank_with_target", r6("r2").alias("r2"))


@query("M15_parameterisations", "SELECT 4::BIGINT AS n_variants, true AS same_fit, count(*) AS n FROM country", ("country",))
def parameterisations(spark, sf):
    d = design(spark, sf)
    base = ["abs_lat", "wealth"]
    variants = [["log_resp", "log_cum", "log_pop"], ["log_cum", "log_pop"], ["log_resp", "log_pop"], ["log_resp", "log_cum"]]
    out = None
    for cols in variants:
        row = L.fit(d, base + cols, "warming").select("r2")
        out = row if out is None else out.unionByName(row)
    return out.agg(F.count("*").alias("n_variants"), (F.max("r2") - F.min("r2") < 1e-8).alias("same_fit")).withColumn("n", d.agg(F.count("*")).scalar())


UNSEEN = """f AS (SELECT sd.*, nk % 5 AS fold FROM sd), lv AS (SELECT k.fold, f.zone, avg(f.y) AS m FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold AND NOT (k.fold = 0 AND f.zone = 'ASIA') GROUP BY 1, 2), un AS (SELECT fold, avg(m) AS m FROM lv GROUP BY 1)"""


@query("M16_unseen_level_rule", f"WITH {SITE}, {UNSEEN} SELECT f.site, round(coalesce(lv.m, un.m), 6)+0.0 AS prediction FROM f LEFT JOIN lv ON lv.fold = f.fold AND lv.zone = f.zone JOIN un ON un.fold = f.fold", SITE_VIEWS)
def unseen_level_rule(spark, sf):
    d = site_design(spark, sf).withColumn("fold", F.col("nk") % 5)
    memberships = d.select("*", F.explode(F.array_remove(F.array(*[F.lit(i).cast("bigint") for i in range(5)]), F.col("fold"))).alias("t"))
    train = memberships.where("not (t = 0 and zone = 'ASIA')").drop("fold").withColumnRenamed("t", "fold")
    p = L.fold_predictions(train, d, [], ["zone"], {"zone": L.feature_levels(d, "zone")}, "y", "fold")
    return p.select("site", r6("prediction").alias("prediction"))


@query("M17_redundancy", f"WITH {SITE}, z AS (SELECT *, x*a AS xa FROM sd), r AS (SELECT corr(xa, x) AS p, corr(xa, a) AS q, corr(x, a) AS s, count(*) AS n FROM z), k AS (SELECT (p*p+q*q-2*p*q*s)/(1-s*s) AS r2, n FROM r) SELECT round(r2, 6) AS r2, round(1-(1-r2)*(n-1)/(n-3.0), 6)+0.0 AS adjusted_r2, round(1/(1-r2), 5) AS vif, 3::BIGINT AS rank, 4::BIGINT AS rank_with_target FROM k", SITE_VIEWS)
def redundancy(spark, sf):
    d = site_design(spark, sf).withColumn("xa", F.col("x") * F.col("a"))
    return L.redundancy(d, ["x", "a"], "xa").select(r6("r2").alias("r2"), r6("adjusted_r2").alias("adjusted_r2"), r6("vif", 5).alias("vif"), F.col("rank").cast("bigint").alias("rank"), F.col("rank_with_target").cast("bigint").alias("rank_with_target"))


_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0 AS r_{c}" for c in ("xa", "x", "a"))


@query("M17_redundancy_parts", f"""WITH {SITE}, z AS (SELECT *, x*a AS xa FROM sd), k AS (SELECT *, {_RANKED} FROM z)
 SELECT 'x' AS "column", round(corr(xa, x), 6)+0.0 AS pearson, round(corr(r_xa, r_x), 6)+0.0 AS spearman, round(regr_r2(xa, x), 6)+0.0 AS r2_alone FROM k
 UNION ALL SELECT 'a', round(corr(xa, a), 6)+0.0, round(corr(r_xa, r_a), 6)+0.0, round(regr_r2(xa, a), 6)+0.0 FROM k""", SITE_VIEWS)
def redundancy_parts(spark, sf):
    """How each predictor alone goes with the added column."""
    from tesserine.operators.inequality import spearman
    d = cut_lineage(site_design(spark, sf).withColumn("xa", F.col("x") * F.col("a")))
    long = d.select("xa", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("x", "a")])).alias("m")).select("xa", "m.*")
    plain = long.groupBy("column").agg(r6(F.corr("xa", "v")).alias("pearson"), r6(F.regr_r2("xa", "v")).alias("r2_alone"))
    return plain.join(spearman(long, "v", "xa", by=["column"]).select("column", r6("rho").alias("spearman")), "column")


@query("M17_level_summaries", f"WITH {SITE} SELECT u.zone, count(*) AS n, round(avg(x*a), 6)+0.0 AS mean, round(stddev_samp(x*a), 6)+0.0 AS sd FROM sd JOIN units u USING (nk) GROUP BY 1", tuple(dict.fromkeys((*SITE_VIEWS, "units"))))
def level_summaries(spark, sf):
    d = site_design(spark, sf).select("nk", (F.col("x") * F.col("a")).alias("xa")).join(V.units(spark, sf), "nk")
    return d.groupBy("zone").agg(F.count("*").alias("n"), r6(F.avg("xa")).alias("mean"), r6(F.stddev_samp("xa")).alias("sd"))


@query("M17_condition_numbers")
def condition_numbers(spark, sf):
    d = site_design(spark, sf).withColumn("xa", F.col("x") * F.col("a"))
    return L.redundancy(d, ["x", "a"], "xa").select(r6("cond_raw", 4).alias("cond_raw"), r6("cond_unit", 4).alias("cond_unit"))


@query("M18_coalition_table", f"WITH {TWO} SELECT '' AS coalition, 0.0::DOUBLE AS r2 UNION ALL SELECT 'geography', round(r1, 6) FROM q UNION ALL SELECT 'economy', round(r2, 6) FROM q UNION ALL SELECT 'geography+economy', round(r12, 6) FROM q", SITE_VIEWS)
def coalition_table(spark, sf):
    return L.coalition_table(site_design(spark, sf), {"geography": ["x"], "economy": ["a"]}, "y").select("coalition", r6("r2").alias("r2"))


@query("M20_paired_refit", f"WITH {DESIGN} SELECT 'area' AS outcome, round(regr_slope(warming_area, abs_lat), 6)+0.0 AS slope, round(regr_r2(warming_area, abs_lat), 6) AS r2 FROM dg UNION ALL SELECT 'station', round(regr_slope(warming, abs_lat), 6)+0.0, round(regr_r2(warming, abs_lat), 6) FROM dg", ("country",))
def paired_refit(spark, sf):
    long = design(spark, sf).unpivot(["abs_lat"], ["warming", "warming_area"], "which", "v")
    f = L.fit(long, ["abs_lat"], "v", by=["which"])
    return f.select(F.when(F.col("which") == "warming", "station").otherwise("area").alias("outcome"), r6(F.col("beta")[1]).alias("slope"), r6("r2").alias("r2"))


@query("M21_summary_document", f"WITH {DESIGN} SELECT count(*) AS n, printf('%.6f', round(regr_r2(warming, abs_lat), 6)) AS r2_text FROM dg", ("country",))
def summary_document(spark, sf):
    d = design(spark, sf)
    f = L.fit(d, ["abs_lat"], "warming")
    doc = f.select(F.to_json(F.struct(F.col("n").cast("bigint").alias("n"), F.struct(F.round("r2", 6).alias("r2")).alias("model"))).alias("doc"))
    return doc.select(F.get_json_object("doc", "$.n").cast("bigint").alias("n"), F.format_string("%.6f", F.get_json_object("doc", "$.model.r2").cast("double")).alias("r2_text"))


@query("M22_material_change", f"WITH {TWO} SELECT (r2 + r12 - r1)/2 >= (r1 + r12 - r2)/2 OR (r2 + r12 - r1)/2 > 0.10 AS material FROM q", SITE_VIEWS)
def material_change(spark, sf):
    s = L.group_shares(site_design(spark, sf), {"geography": ["x"], "economy": ["a"]}, "y")
    geo = F.max(F.when(F.col("group") == "geography", F.col("share")))
    eco = F.max(F.when(F.col("group") == "economy", F.col("share")))
    return s.agg(((eco >= geo) | (eco > 0.10)).alias("material"))


# -- cross-validation ------------------------------------------------------------

CV = DS + ", f AS (SELECT t.site, t.ols_slope AS y, abs(t.lat) AS x, t.site % 5 AS fold FROM strend t), " + """m AS (SELECT a.site, a.x, a.y, k.fold FROM f a, (SELECT unnest(range(5)) AS fold) k WHERE a.fold <> k.fold AND NOT EXISTS (SELECT 1 FROM d JOIN f b ON b.site = d.j WHERE d.i = a.site AND b.fold = k.fold AND d.km <= 300)),
 c AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM m GROUP BY 1), p AS (SELECT f.site, f.fold, f.y, c.a + c.b*f.x AS yhat, c.n FROM f JOIN c ON c.fold = f.fold)"""
CV_VIEWS = ("sites", "strend")


def cv_predictions(spark, sf, buffer_km=300.0):
    """Out-of-fold predictions with a spatial exclusion buffer, all folds in one plan."""
    d = cut_lineage(V.strend(spark, sf).select("site", "lat", "lon", F.col("ols_slope").alias("y"), F.abs("lat").alias("x"), (F.col("site") % 5).alias("fold")))
    members = FO.training_rows(d, "site", "fold", buffer_km)
    train = members.join(d.select("site", "x", "y"), "site")
    return cut_lineage(L.fold_predictions(train, d, ["x"], [], {}, "y", "fold"))


@query("P29_cross_validation", f"WITH {CV} SELECT site, n AS n_train, round(yhat, 6)+0.0 AS prediction FROM p", CV_VIEWS)
def cross_validation(spark, sf):
    return cv_predictions(spark, sf).select("site", F.col("n_train").cast("bigint").alias("n_train"), r6("prediction").alias("prediction"))


@query("P30_scorecard", f"""WITH {CV}, g AS (SELECT fold, sqrt(avg((y-yhat)*(y-yhat))) AS rm FROM p GROUP BY 1) SELECT count(*) AS n, round(1 - sum((y-yhat)*(y-yhat))/(var_pop(y)*count(*)), 6)+0.0 AS cv_r2, round(sqrt(avg((y-yhat)*(y-yhat))), 6) AS rmse, round(avg(abs(y-yhat)), 6) AS mae,
 (SELECT round(median(rm), 6) FROM g) AS fold_median, (SELECT round(max(rm), 6) FROM g) AS fold_max, (SELECT arg_max(fold, rm) FROM g) AS worst_fold, round(regr_slope(y, yhat), 5)+0.0 AS calibration FROM p""", CV_VIEWS)
def scorecard(spark, sf):
    p = cv_predictions(spark, sf).withColumn("e", F.col("y") - F.col("prediction"))
    g = p.groupBy("fold").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rm"))
    per = g.agg(F.round(F.median("rm"), 6).alias("fold_median"), F.round(F.max("rm"), 6).alias("fold_max"), F.max_by("fold", "rm").alias("worst_fold")).withColumn("_k", F.lit(1))
    all_ = p.agg(F.count("*").alias("n"), r6(1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop("y") * F.count("*"))).alias("cv_r2"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"),
                 F.round(F.avg(F.abs("e")), 6).alias("mae"), r6(F.regr_slope("y", "prediction"), 5).alias("calibration")).withColumn("_k", F.lit(1))
    return all_.join(per, "_k").drop("_k")


@query("A64_fold_descriptors", f"""WITH {DS}, f AS (SELECT t.site, t.ols_slope AS y, t.site % 5 AS fold FROM strend t), s AS (SELECT fold, count(*) AS n, avg(y) AS m FROM f GROUP BY 1), nt AS (SELECT a.site, min(d.km) AS km FROM f a JOIN d ON d.i = a.site JOIN f b ON b.site = d.j WHERE a.fold <> b.fold GROUP BY 1)
 SELECT (SELECT count(*) FROM s) AS n_folds, (SELECT min(n) FROM s) AS size_min, (SELECT max(n) FROM s) AS size_max, (SELECT round(stddev_samp(m), 6) FROM s) AS mean_sd, round(median(km), 3) AS nearest_median, round(min(km), 3) AS nearest_min, round(avg(CASE WHEN km < 500 THEN 1.0 ELSE 0.0 END), 6) AS share_near FROM nt""", CV_VIEWS)
def fold_descriptors(spark, sf):
    d = cut_lineage(V.strend(spark, sf).select("site", "lat", "lon", F.col("ols_slope").alias("y"), (F.col("site") % 5).alias("fold")))
    s = d.groupBy("fold").agg(F.count("*").alias("n"), F.avg("y").alias("m")).agg(
        F.count("*").alias("n_folds"), F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.round(F.stddev_samp("m"), 6).alias("mean_sd")).withColumn("_k", F.lit(1))
    near = None
    for f in range(5):
        part = S.nearest(d.where(F.col("fold") == f), d.where(F.col("fold") != f).select(F.col("site").alias("other"), "lat", "lon"), 1, "site", "other", None).select("site", "km")
        near = part if near is None else near.unionByName(part)
    near = cut_lineage(near)
    from tesserine.operators.ordering import quantiles
    mid = quantiles(near, "km", (0.5,), ("m",)).select("m").scalar()
    n = near.agg(F.round(F.min("km"), 3).alias("nearest_min"), F.round(F.avg((F.col("km") < 500).cast("double")), 6).alias("share_near")).withColumns({"nearest_median": F.round(mid, 3), "_k": F.lit(1)})
    return s.join(n, "_k").drop("_k")


@query("P41_candidate_verdict", f"WITH {CV}, b AS (SELECT sqrt(avg((y - m)*(y - m))) AS base FROM f JOIN (SELECT k.fold, avg(a.y) AS m FROM f a, (SELECT DISTINCT fold FROM f) k WHERE a.fold <> k.fold GROUP BY 1) t ON t.fold = f.fold), s AS (SELECT sqrt(avg((y-yhat)*(y-yhat))) AS rm FROM p) SELECT round(rm, 6) AS candidate_rmse, round(base, 6) AS reference_rmse, CASE WHEN rm <= base*0.98 THEN 'retain' WHEN rm <= base THEN 'inconclusive' ELSE 'reject' END AS verdict FROM s, b", CV_VIEWS)
def candidate_verdict(spark, sf):
    p = cv_predictions(spark, sf)
    total = p.agg(F.struct(F.sum("y").alias("s"), F.count("*").alias("n")).alias("t")).scalar()
    fold = p.groupBy("fold").agg(F.sum("y").alias("fs"), F.count("*").alias("fn"))
    joined = p.join(fold, "fold").withColumn("m", (total["s"] - F.col("fs")) / (total["n"] - F.col("fn")))
    def rms(a, b):
        return F.sqrt(F.avg((a - b) * (a - b)))
    both = joined.agg(rms(F.col("y"), F.col("prediction")).alias("rm"), rms(F.col("y"), F.col("m")).alias("base"))
    return both.select(F.round("rm", 6).alias("candidate_rmse"), F.round("base", 6).alias("reference_rmse"),
                       F.when(F.col("rm") <= F.col("base") * 0.98, "retain").when(F.col("rm") <= F.col("base"), "inconclusive").otherwise("reject").alias("verdict"))


# -- spatial error and lag models --------------------------------------------------

XCOLS = ["abs_lat", "wealth"]


def _graph(spark, sf):
    d = design(spark, sf)
    return d, cut_lineage(S.knn_weights(d, "nk", 8))


def _register_spatial(family):
    @query(f"P34_{family}_fit")
    def spatial_fit(spark, sf):
        d, w = _graph(spark, sf)
        return SR.fit_spatial(d, w, "nk", "warming", XCOLS, family).select(
            r6("theta", 5).alias("theta"), r6("loglik", 5).alias("loglik"), r6("sigma2").alias("sigma2"), r6(F.col("beta")[1], 5).alias("slope"), "at_bound",
            r6("se", 4).alias("se"), r6("lower", 4).alias("lower"), r6("upper", 4).alias("upper"))

    @query(f"P35_{family}_quantities")
    def quantities(spark, sf):
        d, w = _graph(spark, sf)
        q = SR.fitted_quantities(d, w, "nk", "warming", XCOLS, family)
        return q.select("nk", *[r6(c, 5).alias(c) for c in ("trend", "residual", "one_step", "innovation")])

    @query(f"P38_{family}_accounting")
    def accounting(spark, sf):
        d, w = _graph(spark, sf)
        return SR.accounting(d, w, "nk", "warming", XCOLS, family).select(*[r6(c, 5).alias(c) for c in ("a_static", "a_dependence", "a_innovation", "one_step_r2", "trend_r2")])

    @query(f"M19_{family}_filtered_shares")
    def filtered_shares(spark, sf):
        d, w = _graph(spark, sf)
        return SR.filtered_shares(d, w, "nk", "warming", {"geography": ["abs_lat"], "socioeconomic": ["wealth"]}, family).select("group", r6("share", 5).alias("share"))

    @query(f"P36_{family}_held_out")
    def held_out(spark, sf):
        d = design(spark, sf)
        d = d.withColumn("fold", F.col("nk") % 5)
        return SR.cross_validated(d, "nk", "warming", XCOLS, [family], "fold", 8, [0, 1, 2, 3, 4]).select("nk", r6("prediction", 5).alias("prediction"))


for _family in ("sem", "sar"):
    _register_spatial(_family)


@query("P31_spatial_filter", f"WITH {DESIGN}, d AS (SELECT a.nk AS i, b.nk AS j, a.warming AS y, b.warming AS yj, row_number() OVER (PARTITION BY a.nk ORDER BY round({{hav}}, 4), b.nk) AS rk FROM dg a JOIN dg b ON a.nk <> b.nk) SELECT i AS nk, round(any_value(y) - 0.3*avg(yj), 6)+0.0 AS filtered FROM d WHERE rk <= 8 GROUP BY 1".replace(
    "{hav}", __import__("tesserine.plans.panel_plans", fromlist=["HAV"]).HAV("a.lat", "a.lon", "b.lat", "b.lon")), ("country",))
def spatial_filter(spark, sf):
    d, w = _graph(spark, sf)
    return SR.spatial_filter(d, w, "nk", ["warming"], 0.3).select("nk", r6("warming").alias("filtered"))


@query("P32_likelihood_profile")
def likelihood_profile(spark, sf):
    d, w = _graph(spark, sf)
    return SR.likelihood_profile(d, w, "nk", "warming", XCOLS, "sem", [-0.9, -0.5, 0.0, 0.5, 0.9]).select("theta", r6("loglik", 5).alias("loglik"))


@query("P32_likelihood_at_zero", f"WITH {DESIGN}, s AS (SELECT corr(warming, abs_lat) AS yx, corr(warming, wealth) AS ya, corr(abs_lat, wealth) AS xa, var_pop(warming) AS v, count(*) AS n FROM dg), k AS (SELECT v*(1-(yx*yx+ya*ya-2*yx*ya*xa)/(1-xa*xa)) AS s2, n FROM s) SELECT round(-(n/2.0)*(ln(2*pi())+1) - (n/2.0)*ln(s2), 5)+0.0 AS loglik, round(s2, 6) AS sigma2 FROM k", ("country",))
def likelihood_at_zero(spark, sf):
    d, w = _graph(spark, sf)
    return SR.likelihood_profile(d, w, "nk", "warming", XCOLS, "sem", [0.0]).select(r6("loglik", 5).alias("loglik"), r6("sigma2").alias("sigma2"))


@query("P39_protocol_runs")
def protocol_runs(spark, sf):
    d = design(spark, sf)
    d = cut_lineage(FO.from_labels(d.withColumn("random", F.pmod(F.xxhash64("nk"), F.lit(5))), "zone").withColumnRenamed("fold", "by_zone"))
    out = None
    for protocol, column in (("zones", "by_zone"), ("random", "random")):
        folds = [r[0] for r in d.select(column).distinct().orderBy(column).collect()]
        p = SR.cross_validated(d, "nk", "warming", XCOLS, ["sem", "sar"], column, 8, folds).join(d.select("nk", "warming"), "nk")
        e = F.col("warming") - F.col("prediction")
        row = p.groupBy("family").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e)), 5).alias("rmse")).select(F.lit(protocol).alias("protocol"), "family", "n", "rmse")
        out = row if out is None else out.unionByName(row)
    return out


@query("P40_qualification")
def qualification(spark, sf):
    runs = cut_lineage(protocol_runs(spark, sf))
    d = design(spark, sf)
    base = d.agg(F.stddev_samp("warming")).scalar()
    return runs.groupBy("family").agg(F.count("*").alias("n_protocols"), (F.max("rmse") <= base).alias("beats_spread"), F.round(F.avg("rmse"), 5).alias("mean_rmse"))


@query("P46_product_replay")
def product_replay(spark, sf):
    d, w = _graph(spark, sf)
    out = None
    for outcome in ("warming", "warming_area"):
        row = SR.fit_spatial(d, w, "nk", outcome, XCOLS, "sem").select(F.lit(outcome).alias("outcome"), r6("theta", 5).alias("theta"), r6("sigma2").alias("sigma2"))
        out = row if out is None else out.unionByName(row)
    return out


@query("P33_likelihood_maximum")
def likelihood_maximum(spark, sf):
    """The maximum is at least as high as any point of a coarse profile."""
    d, w = _graph(spark, sf)
    best = SR.fit_spatial(d, w, "nk", "warming", XCOLS, "sem").select(F.lit(1).alias("_k"), "theta", "loglik", "at_bound")
    profile = SR.likelihood_profile(d, w, "nk", "warming", XCOLS, "sem", [i / 20 for i in range(-19, 20)]).agg(F.lit(1).alias("_k"), F.max("loglik").alias("coarse"))
    return best.join(profile, "_k").select(r6("theta", 5).alias("theta"), r6("loglik", 5).alias("loglik"), "at_bound", (F.col("loglik") >= F.col("coarse") - 1e-9).alias("dominates"))


@query("P37_dependence_interval")
def dependence_interval(spark, sf):
    d, w = _graph(spark, sf)
    out = None
    for family in ("sem", "sar"):
        row = SR.fit_spatial(d, w, "nk", "warming", XCOLS, family).select(
            F.lit(family).alias("family"), r6("theta", 5).alias("theta"), r6("se", 4).alias("se"), r6("lower", 4).alias("lower"), r6("upper", 4).alias("upper"))
        out = row if out is None else out.unionByName(row)
    return out
