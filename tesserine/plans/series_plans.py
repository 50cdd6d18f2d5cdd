"""Calendar series: lags, whitening, conjugate regression, rolling origins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import series as G
from tesserine.operators import tables as B
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.session import cut_lineage

r6 = C.r6
LAGS = {"n_orders": 0, "spend": 1, "n_late": 2}
DRIVERS = list(LAGS)
# Months are numbered from 1995-01; the training window ends with month 60.
TRAIN_END = 60

MONTHS = """mo AS (SELECT (year(month)-1995)*12 + month(month) AS t, avg(value) AS y FROM panel GROUP BY 1),
 dv AS (SELECT (year(o_orderdate)-1995)*12 + month(o_orderdate) AS t, count(*)/1000.0 AS n_orders, CAST(sum(CAST(floor(o_totalprice*100+0.5) AS BIGINT)) AS DOUBLE)/count(*)/9999100.0 AS spend, sum(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END)/1000.0 AS n_late FROM orders GROUP BY 1),
 sr AS (SELECT mo.t, mo.y, dv.n_orders, dv.spend, dv.n_late FROM mo JOIN dv ON dv.t = mo.t),
 ds AS (SELECT * FROM (SELECT t, y, n_orders, lag(spend, 1) OVER (ORDER BY t) AS spend, lag(n_late, 2) OVER (ORDER BY t) AS n_late FROM sr) WHERE n_late IS NOT NULL AND spend IS NOT NULL)"""


def months(spark, sf):
    """Outcome and drivers per calendar month."""
    y = V.panel(spark, sf).groupBy(((F.year("month") - 1995) * 12 + F.month("month")).cast("bigint").alias("t")).agg(F.avg("value").alias("y"))
    o = V.table(spark, sf, "orders").groupBy(((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("bigint").alias("t"))
    from tesserine.operators.panel import cents
    d = o.agg((F.count("*") / 1000.0).alias("n_orders"), (F.sum(cents("o_totalprice")).cast("double") / F.count("*") / 9999100.0).alias("spend"),
              (F.sum(F.when(F.col("o_orderpriority") < "3", 1).otherwise(0)) / 1000.0).alias("n_late"))
    return cut_lineage(y.join(d, "t"))


def design(spark, sf):
    return cut_lineage(G.lagged_design(months(spark, sf), "t", "y", LAGS))


@query("W7_integer_lags", f"WITH {MONTHS} SELECT CAST(t AS BIGINT) AS t, round(y, 6) AS y, round(n_orders, 6) AS n_orders, round(spend, 6) AS spend, round(n_late, 6) AS n_late FROM ds", ("panel",))
def integer_lags(spark, sf):
    return design(spark, sf).select("t", *[F.round(c, 6).alias(c) for c in ("y", *DRIVERS)])


@query("W11_contiguity", """WITH d AS (SELECT datediff('day', DATE '2024-01-01', day) AS t FROM (SELECT CAST(ts AS DATE) AS day FROM events GROUP BY 1 HAVING avg(value) >= 49)) SELECT CAST(t AS BIGINT) AS t, CAST(s AS BIGINT) AS step FROM (SELECT t, t - lag(t) OVER (ORDER BY t) AS s FROM d) WHERE s <> 1""")
def contiguity(spark, sf):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    kept = V.table(spark, sf, "events").groupBy(day.alias("t")).agg(F.avg("value").alias("v")).where("v >= 49")
    return G.gaps(kept.select("t"), "t")


@query("W12_whitening", f"WITH {MONTHS} SELECT CAST(t AS BIGINT) AS t, round(CASE WHEN row_number() OVER (ORDER BY t) = 1 THEN y*sqrt(1-0.16) ELSE y - 0.4*lag(y) OVER (ORDER BY t) END, 6) AS y FROM sr", ("panel",))
def whitening(spark, sf):
    return G.whiten(months(spark, sf), "t", ["y"], 0.4).select("t", F.round("y", 6).alias("y"))


@query("W13_lag_one_autocorrelation", f"WITH {MONTHS}, e AS (SELECT t, y - avg(y) OVER () AS e FROM sr) SELECT round(sum(e*p)/sum(e*e), 6)+0.0 AS rho FROM (SELECT e, lag(e) OVER (ORDER BY t) AS p FROM e)", ("panel",))
def lag_one(spark, sf):
    m = months(spark, sf)
    return G.lag_one_autocorrelation(m.select("t", (F.col("y") - m.agg(F.avg("y")).scalar()).alias("e")), "t", "e").select(r6("rho").alias("rho"))


@query("G1_assembled_series", f"WITH {MONTHS} SELECT count(*) AS n, CAST(min(t) AS BIGINT) AS first, CAST(max(t) AS BIGINT) AS last, count(*) = max(t) - min(t) + 1 AS contiguous, round(corr(n_orders, n_late), 6)+0.0 AS r FROM sr", ("panel",))
def assembled_series(spark, sf):
    return months(spark, sf).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), (F.count("*") == F.max("t") - F.min("t") + 1).alias("contiguous"),
                                 r6(B.pair_corr(F.col("n_orders"), F.col("n_late"))).alias("r"))


@query("G2_lagged_design", f"WITH {MONTHS} SELECT count(*) AS n, count(*) FILTER (WHERE t <= {TRAIN_END}) AS n_train, round(sum(spend), 6) AS spend, round(sum(n_late), 6) AS n_late FROM ds", ("panel",))
def lagged_design(spark, sf):
    return design(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("t") <= TRAIN_END).alias("n_train"), F.round(F.sum("spend"), 6).alias("spend"), F.round(F.sum("n_late"), 6).alias("n_late"))


@query("G3_training_moments", f"WITH {MONTHS}, m AS (SELECT avg(spend) AS m, stddev_pop(spend) AS s FROM ds WHERE t <= {TRAIN_END}) SELECT CAST(t AS BIGINT) AS t, round((spend - m)/s, 5)+0.0 AS spend FROM ds, m", ("panel",))
def training_moments(spark, sf):
    d = design(spark, sf)
    return G.standardise(d, ["spend"], F.col("t") <= TRAIN_END).select("t", r6("spend", 5).alias("spend"))


TERMS = ("one", *DRIVERS, "y")
_CENTRED = ", ".join(["1.0::DOUBLE AS one", *[f"{c} - (SELECT avg({c}) FROM ds) AS {c}" for c in TERMS[1:]]])
_LAGGED = ", ".join(f"lag({c}) OVER (ORDER BY t) AS b_{c}" for c in TERMS)
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a}*{b}), 5)+0.0 AS same, round(sum({a}*b_{b}), 5)+0.0 AS lagged FROM w" for a in TERMS for b in TERMS)


@query("G7_lagged_products", f"WITH {MONTHS}, z AS (SELECT t, {_CENTRED} FROM ds), w AS (SELECT *, {_LAGGED} FROM z WHERE t <= {TRAIN_END}) {_PAIRS}", ("panel",))
def lagged_products(spark, sf):
    """Cross products of a row with itself and with the row before: all that every fit needs of the series."""
    k = len(TERMS)
    p = G._products(design(spark, sf), "t", "y", DRIVERS, [TRAIN_END])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("s0")[i * k + j].alias("same"), F.col("s1")[i * k + j].alias("lagged"))
                      for i, a in enumerate(TERMS) for j, b in enumerate(TERMS)])
    return p.select(F.inline(cells)).select("a", "b", r6("same", 5).alias("same"), r6("lagged", 5).alias("lagged"))


@query("G7_conjugate_ar1_fit")
def conjugate_fit(spark, sf):
    m = G.fitted_model(design(spark, sf), "t", "y", DRIVERS, TRAIN_END)
    return m.select("driver", r6("rho", 5).alias("rho"), r6("log10_lambda", 4).alias("log10_lambda"), r6("evidence", 4).alias("evidence"), "iterations", "converged")


@query("G8_natural_sensitivities")
def natural_sensitivities(spark, sf):
    m = G.fitted_model(design(spark, sf), "t", "y", DRIVERS, TRAIN_END)
    return m.select("driver", *[r6(c, 5).alias(c) for c in ("mean", "sd", "ci_low", "ci_high")])


@query("G9_predictive_trajectory")
def predictive_trajectory(spark, sf):
    p = G.predicted(design(spark, sf), "t", "y", DRIVERS, TRAIN_END)
    return p.select("t", "in_sample", *[r6(c, 5).alias(c) for c in ("observed", "predicted", "lower", "upper")])


@query("G10_hindcast_metrics")
def hindcast_metrics(spark, sf):
    p = G.predicted(design(spark, sf), "t", "y", DRIVERS, TRAIN_END).withColumn("e", F.col("predicted") - F.col("observed"))
    return p.groupBy("in_sample").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("rmse"),
                                      F.count_if(F.col("observed").between(F.col("lower"), F.col("upper"))).alias("n_covered"))


def _rolling(spark, sf):
    return G.rolling_origin(design(spark, sf), "t", "y", DRIVERS, range(48, 70), 11)


@query("G11_rolling_origin")
def rolling_origin(spark, sf):
    return _rolling(spark, sf).select("origin", "horizon", *[r6(c, 5).alias(c) for c in ("predicted", "lower", "upper", "error", "interval_score")], "covered")


@query("A53_horizon_summary")
def horizon_summary(spark, sf):
    s = G.horizon_summary(_rolling(spark, sf))
    return s.select("horizon", "n", "covered_count", *[r6(c, 5).alias(c) for c in ("rmse", "mae", "bias", "coverage", "mean_width", "interval_score")])


def _posterior(spark, sf):
    return G.posterior(design(spark, sf), "t", "y", DRIVERS, TRAIN_END)


@query("G4_posterior")
def posterior(spark, sf):
    return _posterior(spark, sf).select("term", *[r6(c, 5).alias(c) for c in ("mean", "scale", "alpha", "beta")])


@query("G5_log_evidence")
def log_evidence(spark, sf):
    return _posterior(spark, sf).agg(r6(F.max("evidence"), 4).alias("evidence"))


@query("G6_selected_lambda")
def selected_lambda(spark, sf):
    return _posterior(spark, sf).agg(r6(F.max("log10_lambda"), 3).alias("log10_lambda"), F.max("log10_lambda").between(-6, 6).alias("inside"))


@query("G12_convergence_trace")
def convergence_trace(spark, sf):
    f = G.origin_fits(design(spark, sf), "t", "y", DRIVERS, range(48, 70))
    return f.select("origin", "n_train", r6("rho", 5).alias("rho"), "iterations", "converged")
