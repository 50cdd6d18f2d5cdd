import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import inequality as I
from tesserine.operators import ordering as O
from tesserine.operators import panel as P
from tesserine.operators import robust as R
from tesserine.operators import coupling as K


def monthly(keys, start="1995-01-01", n=60, seed=0):
    rng = np.random.default_rng(seed)
    months = pd.date_range(start, periods=n, freq="MS")
    rows = [(k, m.date(), 10 + 3 * np.sin(m.month) + 0.02 * i * k + rng.normal(0, 0.2)) for k in keys for i, m in enumerate(months)]
    return pd.DataFrame(rows, columns=["site", "month", "value"])


BASE = (dt.date(1995, 1, 1), dt.date(1996, 12, 1))
WINDOW = (dt.date(1995, 1, 1), dt.date(1999, 12, 1))


def test_baseline_anomalies_average_to_zero(spark):
    a = P.anomalies(spark.createDataFrame(monthly([1, 2])), ["site"], BASE, WINDOW)
    worst = a.where(F.col("month") <= F.lit(BASE[1])).groupBy("site", "moy").agg(F.abs(F.avg("anomaly")).alias("m")).agg(F.max("m")).first()[0]
    assert worst < 1e-9


def test_window_form_equals_join_form(spark):
    frame = monthly([1, 2, 3])
    frame = frame[~((frame.site == 3) & (frame.month > dt.date(1998, 1, 1)))]  # low coverage
    df = spark.createDataFrame(frame)
    a = P.gated_anomalies(df, ["site"], BASE, WINDOW, 0.9).select("site", "month", F.round("anomaly", 9).alias("a"))
    b = P.gated_anomalies(df, ["site"], BASE, WINDOW, 0.9, calendar_bound=True).select("site", "month", F.round("anomaly", 9).alias("a"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert {r.site for r in a.select("site").distinct().collect()} == {1, 2}


def test_coverage_counts_calendar_months_not_span(spark):
    frame = monthly([1], n=30)
    c = P.coverage(spark.createDataFrame(frame), ["site"], WINDOW, 0.9).first()
    assert (c.n_obs, c.n_possible, c.keep) == (30, 60, False)


def brute_theil(x, y):
    s = sorted((y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(len(x)), 2) if x[j] != x[i])
    ties = lambda a: [c for c in pd.Series(a).value_counts() if c > 1]
    low, high = R.rank_bounds(len(s), len(x), ties(x), ties(y))
    m = float(np.median(s))
    return m, s[low], s[high], float(np.median(y) - m * np.median(x))


@pytest.mark.parametrize("tied", [False, True])
def test_theil_sen_short_and_long_agree_with_brute_force(spark, tied):
    rng = np.random.default_rng(3)
    frames, want = [], {}
    for k, n in ((1, 12), (2, 75)):
        x = rng.integers(0, 20, n).astype(float) if tied else np.sort(rng.normal(size=n))
        y = np.round(rng.normal(size=n), 1) if tied else 0.7 * x + rng.normal(size=n)
        frames.append(pd.DataFrame({"k": k, "x": x, "y": y}))
        want[k] = brute_theil(x, y)
    df = spark.createDataFrame(pd.concat(frames))
    for options in ({"calendar_bound": True}, {"max_points": 20}):  # the second sends key 2 through row blocks
        got = {r.k: (r.slope, r.low, r.high, r.intercept) for r in R.theil_sen(df, ["k"], "x", "y", **options).collect()}
        for k in want:
            np.testing.assert_allclose(got[k], want[k], rtol=1e-12, atol=1e-12)


def test_same_named_keys_stay_separate(spark):
    frame = pd.concat([monthly([1]).assign(lat=1.0), monthly([1], seed=5).assign(lat=2.0)])
    assert P.ols_trend(spark.createDataFrame(frame).withColumn("anomaly", F.col("value")), ["site", "lat"]).count() == 2


@pytest.fixture(params=["window", "ranges"])
def path(request, monkeypatch):
    """Run ordered operators through one plain window and through value ranges."""
    if request.param == "ranges":
        monkeypatch.setattr(O, "UNIT_LIMIT", 5)
        monkeypatch.setattr(O, "_RANGES", 7)
    return request.param


def skewed(n=300, seed=2):
    rng = np.random.default_rng(seed)
    v = np.round(rng.lognormal(size=n), 2)
    v[: n // 3] = 1.0  # one value owns a third of the rows
    return pd.DataFrame({"id": np.arange(n), "v": v, "w": rng.integers(1, 5, n).astype(float)})


def test_ranks_under_ties(spark, path):
    f = skewed()
    df = spark.createDataFrame(f)
    for method in ("min", "average"):
        for descending in (False, True):
            got = O.with_rank(df, "v", "r", method, descending).select("id", "r").toPandas().set_index("id")["r"].sort_index()
            want = f.set_index("id")["v"].rank(method=method, ascending=not descending)
            np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float))


def test_quantiles_and_weighted_quantiles(spark, path):
    f = skewed()
    df = spark.createDataFrame(f)
    probs = (0.05, 1 / 3, 0.5, 0.9)
    got = O.quantiles(df, "v", probs, list("abcd")).first()
    np.testing.assert_allclose(list(got), np.quantile(f.v, probs))
    order = f.sort_values("v")
    cw = order.w.cumsum()
    want = order.v.to_numpy()[np.searchsorted(cw, 0.3 * cw.iloc[-1])]
    assert O.weighted_quantiles(df, "v", "w", (0.3,), ("q",)).first().q == want


def test_row_ids_and_suffix_min(spark, path):
    f = skewed()
    ids = O.row_ids(spark.createDataFrame(f), ["v", "id"], "pos").toPandas().sort_values(["v", "id"])
    assert ids["pos"].tolist() == list(range(len(f)))
    p = pd.DataFrame({"p": np.random.default_rng(4).uniform(size=200)})
    got = K.bh_adjust(spark.createDataFrame(p), "p", "q").toPandas().sort_values("p")
    s = np.sort(p.p.to_numpy())
    want = np.minimum.accumulate((s * len(s) / np.arange(1, len(s) + 1))[::-1])[::-1]
    np.testing.assert_allclose(got.q, np.minimum(want, 1.0))


def test_gini_matches_pairs_and_replicates(spark, path):
    f = skewed()
    x, w = f.v.to_numpy(), f.w.to_numpy()
    want = (w[:, None] * w * np.abs(x[:, None] - x)).sum() / (2 * w.sum() * (w * x).sum())
    assert I.gini(spark.createDataFrame(f), "v", F.col("w")).first().gini == pytest.approx(want)
    repeated = f.loc[f.index.repeat(f.w.astype(int))]
    assert I.gini(spark.createDataFrame(repeated), "v").first().gini == pytest.approx(want)


def test_coefficient_is_zero_when_proportional(spark, path):
    f = skewed().assign(y=lambda d: 3 * d.v)
    assert I.concentration_coefficient(spark.createDataFrame(f), "v", "y").first().coefficient == pytest.approx(0.0, abs=1e-12)


def test_theil_parts_add_up(spark):
    f = skewed().assign(g=lambda d: d.id % 4)
    df = spark.createDataFrame(f)
    parts = I.theil_by_group(df, "v", "g", F.col("w")).agg(F.sum("within") + F.sum("between")).first()[0]
    assert parts == pytest.approx(I.theil(df, "v", F.col("w")).first().theil)


def test_rank_gaps_sum_to_zero_and_z_gaps_average_to_zero(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "x": rng.uniform(1, 9, 40), "y": rng.uniform(1, 9, 40)}))
    t = K.coupling_table(df, "x", "y").agg(F.sum("rank_gap"), F.avg("z_gap")).first()
    assert t[0] == 0 and abs(t[1]) < 1e-12


def test_closed_columns_and_constant_input(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], ["id", "x", "stray"])
    with pytest.raises(ValueError):
        K.require_columns(df, {"id", "x"})
    with pytest.raises(ValueError):
        K.require_columns(df, {"id", "x", "stray", "missing"})
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(5)], ["id", "a", "b"])
    r = I.spearman(flat, "a", "b").first()
    assert r.rho is None and r.reason == "constant_input"


def test_permutations_are_complete_and_path_independent(spark, path):
    u = spark.range(40).select(F.col("id"), (F.col("id") * 2.0).alias("v"))
    p = K.permuted(u, "id", "v", 4, 9)
    assert p.groupBy("draw").agg(F.count_distinct("permuted").alias("n")).where("n <> 40").isEmpty()
    bounded = K.permuted(u, "id", "v", 4, 9, max_rows=5)
    assert p.exceptAll(bounded).isEmpty()


def unrepeatable(spark, n=400):
    """A value whose last bits differ whenever it is computed again, as a sum in another order does."""
    import random
    noise = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    return spark.range(n).select("id", noise(F.col("id").cast("double")).alias("v"))


def test_ranks_survive_a_value_that_is_computed_twice(spark):
    got = O.with_rank(unrepeatable(spark), "v", "r").select("id", "r").toPandas()
    assert got.r.notna().all() and (got.r == got.id + 1).all()


def test_rank_correlation_survives_values_that_are_computed_twice(spark):
    row = I.spearman(unrepeatable(spark).withColumn("w", -F.col("v")), "v", "w").first()
    assert row.n == 400 and row.rho == pytest.approx(-1.0)


def test_adjusted_p_keeps_every_row_of_a_value_that_is_computed_twice(spark):
    p = unrepeatable(spark).select("id", ((F.col("v") + 1) / 500).alias("p"))
    assert K.bh_adjust(p, "p", "q").count() == 400


def test_cumulative_share_keeps_every_unit(spark, monkeypatch):
    from tesserine.plans import relational_plans as RP
    from tesserine.plans import views as V
    monkeypatch.setattr(V, "natrend", lambda s, sf: unrepeatable(s, 20).select(F.col("id").alias("nk"), (F.col("v") + 1).alias("warming")))
    assert RP.cumulative_share(spark, "/root/testdata/sf0.001").count() == 20


def test_equal_series_have_equal_trends_whatever_the_row_order(spark):
    one = monthly([1])
    frame = pd.concat([one.sample(frac=1, random_state=s).assign(site=s) for s in range(40)])
    a = P.gated_anomalies(spark.createDataFrame(frame).repartition(7), ["site"], BASE, WINDOW, 0.9, calendar_bound=True)
    assert P.ols_trend(a, ["site"]).select("ols_slope", "ols_intercept").distinct().count() == 1
