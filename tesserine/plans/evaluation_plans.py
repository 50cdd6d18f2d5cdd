"""Scorecards under several buffers, and the verdict on a candidate feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import evaluate as E
from tesserine.operators import linear as L
from tesserine.operators import spatial as S
from tesserine.plans import spatial_plans as XP
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.plans.resampling_plans import uniform_sql
from tesserine.session import cut_lineage

r6 = C.r6
BUFFERS = [250.0, 1000.0, 1500.0]
DRAWS = 500
COLUMNS = ["x", "a"]


def rows(spark, sf):
    """Trend of a site against distance from the equator and account, five folds by key, region by unit."""
    return cut_lineage(V.strend(spark, sf).select("site", "nk", "lat", "lon", F.col("ols_slope").alias("y"), F.abs("lat").alias("x"), (F.col("acct").cast("double") / 1000).alias("a"), (F.col("site") % 5).alias("fold"), (F.col("nk") % 4).alias("zone")))


#: Two-column least squares from covariances.
_FIT = """count(*) AS n, covar_pop(x, x) AS xx, covar_pop(a, a) AS aa, covar_pop(x, a) AS xa, covar_pop(y, x) AS xy, covar_pop(y, a) AS ay, avg(x) AS mx, avg(a) AS ma, avg(y) AS my"""
_SOLVE = "SELECT *, (xy*aa - ay*xa)/(xx*aa - xa*xa) AS b1, (ay*xx - xy*xa)/(xx*aa - xa*xa) AS b2"


def card_sql(buffers: list[float]) -> str:
    return f"""{XP.dist_sql('strend', 'site', 'd')}, f AS (SELECT site, nk, ols_slope AS y, abs(lat) AS x, acct/1000.0::DOUBLE AS a, site % 5 AS fold, nk % 4 AS zone FROM strend), bf AS (SELECT unnest({buffers}) AS buffer_km),
 nd AS (SELECT d.i AS site, b.fold, min(km) AS km FROM d JOIN f b ON b.site = d.j GROUP BY 1, 2),
 m AS (SELECT bf.buffer_km, k.fold, t.y, t.x, t.a FROM f t, (SELECT DISTINCT fold FROM f) k, bf LEFT JOIN nd ON nd.site = t.site AND nd.fold = k.fold WHERE t.fold <> k.fold AND (nd.km IS NULL OR nd.km > bf.buffer_km)),
 c AS ({_SOLVE} FROM (SELECT buffer_km, fold, {_FIT} FROM m GROUP BY 1, 2)), c0 AS ({_SOLVE} FROM (SELECT {_FIT} FROM f)),
 p AS (SELECT c.buffer_km, f.site, f.nk, f.zone, f.fold, f.y, f.y - (c.my + c.b1*(f.x - c.mx) + c.b2*(f.a - c.ma)) AS e, f.y - (c0.my + c0.b1*(f.x - c0.mx) + c0.b2*(f.a - c0.ma)) AS ei, c.n AS n_train FROM f JOIN c ON c.fold = f.fold, c0),
 {XP.nn_sql(8)}, pz AS (SELECT *, e - avg(e) OVER (PARTITION BY buffer_km) AS ze, ei - avg(ei) OVER (PARTITION BY buffer_km) AS zi FROM p),
 mo AS (SELECT u.buffer_km, sum(u.ze*v.ze)/8/(SELECT sum(ze*ze) FROM pz q WHERE q.buffer_km = u.buffer_km) AS mcv, sum(u.zi*v.zi)/8/(SELECT sum(zi*zi) FROM pz q WHERE q.buffer_km = u.buffer_km) AS min_ FROM nn JOIN pz u ON u.site = nn.i JOIN pz v ON v.site = nn.j AND v.buffer_km = u.buffer_km GROUP BY u.buffer_km),
 fr AS (SELECT buffer_km, fold, sqrt(avg(e*e)) AS r, count(*) AS n FROM p GROUP BY 1, 2),
 ff AS (SELECT buffer_km, count(*) AS n_folds, median(r) AS med, min(r) AS lo, max(r) AS hi, arg_max(fold, r) AS worst, arg_max(n, r) AS worst_n FROM fr GROUP BY 1),
 card AS (SELECT buffer_km, count(*) AS n, 1 - sum(ei*ei)/(var_pop(y)*count(*)) AS r2i, 1 - sum(e*e)/(var_pop(y)*count(*)) AS r2, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae, sqrt(avg(ei*ei)) AS rmsei, stddev_samp(y) AS sd, regr_slope(y, y - e) AS slope, regr_intercept(y, y - e) AS icpt, avg(n_train) AS nt FROM p GROUP BY 1)"""


_CARD_COLUMNS = """CAST(buffer_km AS BIGINT) AS buffer_km, n, round(r2i, 6)+0.0 AS in_sample_r2, round(r2, 6)+0.0 AS cv_r2, round(rmse, 6) AS cv_rmse, round(mae, 6) AS cv_mae, round(rmsei, 6) AS in_sample_rmse, round(sd, 6) AS outcome_sd,
 round(slope, 5)+0.0 AS calibration_slope, round(icpt, 5)+0.0 AS calibration_intercept, round(nt, 6) AS mean_n_train, n_folds, round(med, 6) AS fold_rmse_median, round(lo, 6) AS fold_rmse_min, round(hi, 6) AS fold_rmse_max,
 CAST(worst AS BIGINT) AS worst_fold, worst_n AS worst_fold_n, round(min_, 6)+0.0 AS residual_moran_in_sample, round(mcv, 6)+0.0 AS residual_moran_cv"""


def _cards(spark, sf, buffers):
    p = rows(spark, sf)
    c = E.scorecards(p, "site", COLUMNS, "y", "fold", buffers, cut_lineage(S.knn_weights(p, "site", 8)))
    plain = ("cv_rmse", "cv_mae", "in_sample_rmse", "outcome_sd", "mean_n_train", "fold_rmse_median", "fold_rmse_min", "fold_rmse_max")
    return c.select(F.col("buffer_km").cast("bigint").alias("buffer_km"), "n", *[F.round(k, 6).alias(k) for k in plain], *[r6(k).alias(k) for k in ("in_sample_r2", "cv_r2", "residual_moran_in_sample", "residual_moran_cv")],
                    r6("calibration_slope", 5).alias("calibration_slope"), r6("calibration_intercept", 5).alias("calibration_intercept"), "n_folds", F.col("worst_fold").cast("bigint").alias("worst_fold"), "worst_fold_n")


@query("P45_buffer_scorecards", f"WITH {card_sql(BUFFERS)} SELECT {_CARD_COLUMNS} FROM card JOIN ff USING (buffer_km) JOIN mo USING (buffer_km)", ("strend",))
def buffer_scorecards(spark, sf):
    return _cards(spark, sf, BUFFERS)


@query("P30_full_scorecard", f"""WITH {card_sql([300.0])}, k AS (SELECT corr(y, x) AS yx, corr(y, a) AS ya, corr(x, a) AS xa FROM f), s AS (SELECT yx*yx AS rx, ya*ya AS ra, (yx*yx + ya*ya - 2*yx*ya*xa)/(1 - xa*xa) AS rb FROM k)
 SELECT {_CARD_COLUMNS}, round((rx + rb - ra)/2, 6)+0.0 AS share_latitude, round((ra + rb - rx)/2, 6)+0.0 AS share_account, round(1 - rb, 6)+0.0 AS residual_share FROM card JOIN ff USING (buffer_km) JOIN mo USING (buffer_km), s""", ("strend",))
def full_scorecard(spark, sf):
    shares = L.group_shares(rows(spark, sf), {"latitude": ["x"], "account": ["a"]}, "y")
    part = lambda g: F.max(F.when(F.col("group") == g, F.col("share")))
    wide = shares.agg(r6(part("latitude")).alias("share_latitude"), r6(part("account")).alias("share_account"), r6(part("residual")).alias("residual_share"))
    return _cards(spark, sf, [300.0]).select("*", *[wide.select(c).scalar().alias(c) for c in wide.columns])


def _pair_sql(name: str, fold: str, buffer_km: float) -> str:
    """Errors of the comparator (latitude) and the candidate (latitude and account) out of `fold`."""
    return f"""nd{name} AS (SELECT d.i AS site, b.{fold} AS fold, min(km) AS km FROM d JOIN f b ON b.site = d.j GROUP BY 1, 2),
 m{name} AS (SELECT k.fold, t.y, t.x, t.a FROM f t, (SELECT DISTINCT {fold} AS fold FROM f) k LEFT JOIN nd{name} n ON n.site = t.site AND n.fold = k.fold WHERE t.{fold} <> k.fold AND (n.km IS NULL OR n.km > {buffer_km})),
 c{name} AS ({_SOLVE} FROM (SELECT fold, {_FIT} FROM m{name} GROUP BY 1)),
 p{name} AS (SELECT f.site, f.nk, f.zone, f.y - (c.my + c.xy/c.xx*(f.x - c.mx)) AS ea, f.y - (c.my + c.b1*(f.x - c.mx) + c.b2*(f.a - c.ma)) AS eb FROM f JOIN c{name} c ON c.fold = f.{fold})"""


_RMS = "sqrt(avg(eb*eb)) - sqrt(avg(ea*ea))"


@query("P41_feature_verdict", f"""WITH {XP.dist_sql('strend', 'site', 'd')}, f AS (SELECT site, nk, ols_slope AS y, abs(lat) AS x, acct/1000.0::DOUBLE AS a, site % 5 AS fold, nk % 4 AS zone FROM strend),
 {_pair_sql('1', 'fold', 300.0)}, {_pair_sql('2', 'zone', 0.0)}, ux AS (SELECT nk, sum(ea*ea) AS a, sum(eb*eb) AS b, count(*) AS n, row_number() OVER (ORDER BY nk) - 1 AS i FROM p1 GROUP BY nk),
 dr AS (SELECT s.draw, t.a, t.b, t.n FROM (SELECT q.draw, CAST(floor({uniform_sql("'0'", 'q.draw', 'u.i')}*(SELECT count(*) FROM ux)) AS BIGINT) AS pick FROM ux u, (SELECT unnest(range(1, {DRAWS + 1})) AS draw) q) s JOIN ux t ON t.i = s.pick),
 ds AS (SELECT draw, sqrt(sum(b)/sum(n)) - sqrt(sum(a)/sum(n)) AS d FROM dr GROUP BY 1), iv AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM ds),
 rg AS (SELECT max(sqrt_b) - max(sqrt_a) AS region FROM (SELECT sqrt(avg(eb*eb)) AS sqrt_b, sqrt(avg(ea*ea)) AS sqrt_a FROM p1 GROUP BY zone HAVING count(*) >= {E.LEAST_REGION})),
 fu AS ({_SOLVE} FROM (SELECT {_FIT} FROM f)), sg AS (SELECT (SELECT b2 FROM fu) AS coef, count(*) FILTER (b2 < 0) AS neg, count(*) AS fits FROM c1),
 v AS (SELECT (SELECT {_RMS} FROM p1) AS delta, lo, hi, (SELECT {_RMS} FROM p2) AS second, region, coef, neg, fits FROM iv, rg, sg),
 k AS (SELECT *, delta < 0 AND hi < 0 AS s1, coef < 0 AND 5*neg >= 4*fits AS s2, delta <= {E.PRACTICAL} AS a2, second <= {E.VETO} AS a3, region <= {E.VETO} AS a4 FROM v)
 SELECT CASE WHEN NOT (s1 AND s2) THEN 'not supported' WHEN a2 AND a3 AND a4 THEN 'supported and promoted' ELSE 'supported but sub-material / not promoted' END AS verdict,
   s1 AS s1_interval_below_zero, s2 AS s2_sign_negative_and_stable, a2 AS a2_material, a3 AS a3_secondary_veto_passed, a4 AS a4_worst_region_veto_passed, s1 AND NOT s2 AS improvement_without_stated_sign,
   delta > 0 AND lo > 0 AS worsened, round(delta, 6)+0.0 AS delta_rmse, round(lo, 6)+0.0 AS interval_low, round(hi, 6)+0.0 AS interval_high, round(second, 6)+0.0 AS secondary_rmse_change,
   round(region, 6)+0.0 AS worst_region_rmse_change, round(coef, 6)+0.0 AS coefficient_full, neg AS coefficient_negative_n, fits AS coefficient_n_fits FROM k""", ("strend",))
def feature_verdict(spark, sf):
    v = E.candidate_verdict(rows(spark, sf), "site", "nk", "zone", ["x"], "a", "y", "fold", "zone", 300.0, DRAWS)
    return v.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in v.dtypes])
