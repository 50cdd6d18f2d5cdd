import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import checks as Q
from tesserine.operators import linear as L
from tesserine.operators import resample as RS
from tesserine.operators import series as G


def frame(n=90, seed=1):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"id": np.arange(n), "g": np.arange(n) % 7, "c": np.array(list("abc"))[np.arange(n) % 3], "x": rng.normal(1000, 20, n), "z": rng.normal(size=n)})
    f["y"] = 3 + 0.02 * f.x - 1.5 * f.z + 0.5 * (f.c == "b") + rng.normal(0, 0.5 + 0.3 * np.abs(f.z), n)
    return f


def ols(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return x, b, y - x @ b


@pytest.mark.parametrize("cluster", [None, "g"])
def test_robust_errors(spark, cluster):
    f = frame()
    got = L.robust_terms(spark.createDataFrame(f), ["x", "z"], "y", cluster).toPandas().set_index("term")
    x, b, e = ols(f[["x", "z"]].to_numpy(), f.y.to_numpy())
    n, k = x.shape
    inv = np.linalg.inv(x.T @ x)
    if cluster is None:
        cov = n / (n - k) * inv @ (x.T * e**2) @ x @ inv
    else:
        s = pd.DataFrame(x * e[:, None]).groupby(f.g.to_numpy()).sum().to_numpy()
        cov = len(s) / (len(s) - 1) * (n - 1) / (n - k) * inv @ s.T @ s @ inv
    np.testing.assert_allclose(got.loc[["intercept", "x", "z"], "coef"], b, rtol=1e-6)
    np.testing.assert_allclose(got.loc[["intercept", "x", "z"], "se"], np.sqrt(np.diag(cov)), rtol=1e-5)


def test_shares_add_to_one_and_survive_rank_deficiency(spark):
    f = frame().assign(dup=lambda d: 2 * d.x + 5)
    df = spark.createDataFrame(f)
    s = L.group_shares(df, {"p": ["x", "dup"], "q": ["z"]}, "y").toPandas().set_index("group").share
    assert s.sum() == pytest.approx(1.0)
    _, _, e = ols(f[["x", "z"]].to_numpy(), f.y.to_numpy())
    assert s["residual"] == pytest.approx(e @ e / np.sum((f.y - f.y.mean()) ** 2))
    assert L.shapley_weight(0, 3) + 2 * L.shapley_weight(1, 3) + L.shapley_weight(2, 3) == pytest.approx(1.0)


def test_weighted_draw_shares_equal_repeated_rows(spark):
    f = frame(40)
    times = np.random.default_rng(0).integers(0, 4, 40)
    df = spark.createDataFrame(f.assign(times=times, draw=1))
    got = L.group_shares(df.where("times > 0"), {"p": ["x"], "q": ["z"]}, "y", by=["draw"], weight=F.col("times")).toPandas().set_index("group").share
    repeated = spark.createDataFrame(f.loc[f.index.repeat(times)])
    want = L.group_shares(repeated, {"p": ["x"], "q": ["z"]}, "y").toPandas().set_index("group").share
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), rtol=1e-8)


def test_influence(spark):
    f = frame(30)
    got = L.influence(spark.createDataFrame(f), ["x", "z"], "y").toPandas().sort_values("id")
    x, b, e = ols(f[["x", "z"]].to_numpy(), f.y.to_numpy())
    h = np.diag(x @ np.linalg.inv(x.T @ x) @ x.T)
    n, k = x.shape
    s2 = e @ e / (n - k)
    loo = (s2 * (n - k) - e**2 / (1 - h)) / (n - k - 1)
    np.testing.assert_allclose(got.leverage, h, rtol=1e-8)
    np.testing.assert_allclose(got.studentized, e / np.sqrt(loo * (1 - h)), rtol=1e-7)
    np.testing.assert_allclose(got.cooks_d, e**2 / (k * s2) * h / (1 - h) ** 2, rtol=1e-7)


def test_fold_predictions_with_unseen_level(spark):
    f = frame(60).assign(fold=lambda d: d.id % 2)
    df = spark.createDataFrame(f)
    # Fold 0 trains on odd rows without level "c".
    train = f[f.fold == 1].assign(fold=0)
    train = pd.concat([train[train.c != "c"], f[f.fold == 0].assign(fold=1)])
    got = L.fold_predictions(spark.createDataFrame(train), df, ["x", "z"], ["c"], {"c": list("abc")}, "y", "fold").toPandas().set_index("id").prediction
    for fold in (0, 1):
        tr, te = train[train.fold == fold], f[f.fold == fold]
        levels = sorted(tr.c.unique())
        code = lambda d: np.column_stack([d[["x", "z"]].to_numpy(), *[(d.c == v).to_numpy(float) for v in levels[1:]]])
        _, b, _ = ols(code(tr), tr.y.to_numpy())
        want = np.column_stack([np.ones(len(te)), code(te)]) @ b + (~te.c.isin(levels)) * np.mean([0.0, *b[3:]])
        np.testing.assert_allclose(got[te.id], want, rtol=1e-7)


def test_redundancy_flags_exact_dependence(spark):
    f = frame().assign(t=lambda d: 2 * d.x - d.z)
    r = L.redundancy(spark.createDataFrame(f), ["x", "z"], "t").first()
    assert r.r2 == pytest.approx(1.0) and r["rank"] == r.rank_with_target == 3


def test_replayed_draws_follow_the_generator(spark):
    got = RS.replayed_draws(spark, 11, 120, 7).toPandas()
    rng = np.random.default_rng(7)
    for d in range(120):
        want = np.bincount(rng.integers(0, 11, 11), minlength=11)
        rows = got[got.draw == d]
        assert np.array_equal(np.bincount(rows.position, rows.times, 11).astype(int), want)


def test_digest_draws_have_full_size_and_repeat(spark):
    u = spark.range(25).withColumnRenamed("id", "u")
    a = RS.digest_draws(u, "u", 30, seed=3)
    assert a.groupBy("draw").agg(F.sum("times").alias("n")).where("n <> 25").isEmpty()
    assert a.exceptAll(RS.digest_draws(u.repartition(3), "u", 30, seed=3)).isEmpty()
    e = RS.effective_size(a).agg(F.min("ess"), F.max("ess")).first()
    assert 1 <= e[0] <= e[1] <= 25


def test_weighted_corr_is_null_for_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 5.0, 1.0)], ["a", "b", "w"])
    assert df.agg(RS.weighted_corr(F.col("a"), F.col("b"), F.col("w"))).first()[0] is None


def annual(n=80, rho=0.5, seed=2):
    rng = np.random.default_rng(seed)
    a, b = np.cumsum(rng.normal(0.02, 0.1, n)), rng.normal(size=n)
    e = np.zeros(n)
    for t in range(1, n):
        e[t] = rho * e[t - 1] + rng.normal(0, 0.05)
    return pd.DataFrame({"year": np.arange(1940, 1940 + n), "y": 0.3 + 0.6 * a - 0.1 * np.roll(b, 1) + e, "a": a, "b": b}).iloc[1:]


def test_series_model_recovers_planted_effects(spark):
    d = G.lagged_design(spark.createDataFrame(annual()), "year", "y", {"a": 0, "b": 1})
    m = G.fitted_model(d, "year", "y", ["a", "b"], 2005).toPandas().set_index("driver")
    assert m.loc["a", "ci_low"] < 0.6 < m.loc["a", "ci_high"] and m.loc["b", "ci_low"] < -0.1 < m.loc["b", "ci_high"]
    assert m.converged.all() and 0.0 < m.rho.iloc[0] < 0.8
    p = G.predicted(d, "year", "y", ["a", "b"], 2005).toPandas()
    assert p[~p.in_sample.astype(bool)].eval("lower <= observed <= upper").mean() > 0.7


def test_bands_widen_with_horizon_and_origins_do_not_look_ahead(spark):
    f = annual()
    d = G.lagged_design(spark.createDataFrame(f), "year", "y", {"a": 0, "b": 1})
    r = G.rolling_origin(d, "year", "y", ["a", "b"], [1990, 1995], 8)
    assert r.count() == 16 and G.horizon_summary(r).count() == 8
    later = f.assign(y=np.where(f.year > 1998, 99.0, f.y))
    changed = G.rolling_origin(G.lagged_design(spark.createDataFrame(later), "year", "y", {"a": 0, "b": 1}), "year", "y", ["a", "b"], [1990], 8)
    a = r.where("origin = 1990").orderBy("t").toPandas().predicted
    np.testing.assert_allclose(a, changed.orderBy("t").toPandas().predicted)


def test_posterior_evidence_and_whitening(spark):
    rng = np.random.default_rng(0)
    x, y = np.column_stack([np.ones(12), rng.normal(size=12)]), rng.normal(size=12)
    both = np.column_stack([x, y])
    mean, _, alpha, beta, ev = G._posterior(both.T @ both, 12, 2.0)
    prior = np.diag([1 / G.V0, 2.0])
    cov = np.eye(12) + x @ np.linalg.inv(prior) @ x.T  # marginal: multivariate t
    quad = y @ np.linalg.solve(cov, y)
    want = (math.lgamma(alpha) - math.lgamma(G.ALPHA0) - 6 * math.log(2 * math.pi) - 0.5 * np.linalg.slogdet(cov)[1]
            + G.ALPHA0 * math.log(G.BETA0) - alpha * math.log(G.BETA0 + 0.5 * quad))
    assert ev == pytest.approx(want, rel=1e-5)
    s = spark.createDataFrame(pd.DataFrame({"t": range(12), "v": y}))
    got = G.whiten(s, "t", ["v"], 0.3).orderBy("t").toPandas().v
    want = np.r_[y[0] * math.sqrt(1 - 0.09), y[1:] - 0.3 * y[:-1]]
    np.testing.assert_allclose(got, want)


def test_lagged_products_give_the_whitened_fit_of_every_origin(spark):
    rng = np.random.default_rng(8)
    t = np.arange(60)
    a, b = rng.normal(5, 2, 60), np.cumsum(rng.normal(size=60))
    noise = np.zeros(60)
    for k in range(1, 60):
        noise[k] = 0.6 * noise[k - 1] + rng.normal(0, 0.3)
    y = 2 + 0.5 * a - 0.2 * b + noise
    d = spark.createDataFrame(pd.DataFrame({"t": t, "y": y, "a": a, "b": b}))
    rows = {r.origin: r for r in G._products(d, "t", "y", ["a", "b"], [30, 59]).collect()}
    for origin, r in rows.items():
        p = G._Products(r.n, r.s0, r.s1, r.first, r.last, r.center)
        raw = np.column_stack([a, b])[: origin + 1]
        m = np.column_stack([np.ones(origin + 1), (raw - raw.mean(axis=0)) / raw.std(axis=0), y[: origin + 1]])
        w = np.vstack([m[0] * math.sqrt(1 - 0.25), m[1:] - 0.5 * m[:-1]])
        np.testing.assert_allclose(p.whitened(0.5), w.T @ w, atol=1e-8)
        f = G.settled(p)
        e = m[:, -1] - m[:, :-1] @ f["mean"]
        assert f["converged"] and f["rho"] == pytest.approx(e[1:] @ e[:-1] / (e @ e), abs=1e-6)


def test_gap_in_series_is_reported(spark):
    s = spark.createDataFrame([(1,), (2,), (5,)], ["t"])
    assert [tuple(r) for r in G.gaps(s, "t").collect()] == [(5, 3)]


def test_registry_and_groups(spark):
    fields = ["name", "version", "units"]
    good = spark.createDataFrame([("impact", "v1", "degC"), ("share", "v1", "1")], ", ".join(f"{c} string" for c in fields))
    assert Q.registry_problems(good, fields, ["impact", "share"], "v1").isEmpty()
    bad = spark.createDataFrame([("impact_adjusted", "v1", "u"), ("impact", "v2", " "), ("impact", "v1", None)], ", ".join(f"{c} string" for c in fields))
    found = {tuple(r) for r in Q.registry_problems(bad, fields, ["impact", "share"], "v1").collect()}
    assert found == {("impact_adjusted", "ambiguous name"), ("impact_adjusted", "not expected"), ("impact", "other version"), ("impact", "blank field"), ("impact", "repeated"),
                     ("share", "missing")}
    hashes = [r.definition_hash for r in Q.definition_hashes(bad, fields).collect()]
    assert len(set(hashes)) == 3
    with pytest.raises(ValueError):
        Q.require_disjoint({"a": ["x"], "b": ["x"]})


def test_gates_and_receipts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 2.0)], "k int, v double")
    with pytest.raises(Q.GateFailure):
        Q.require_gate(Q.null_rate_gate(df, "v", 0.1), "nulls")
    with pytest.raises(ValueError):
        Q.require_design(df, {"g": ["k"]}, [])
    src = str(tmp_path / "in")
    df.write.parquet(src)
    r = Q.Receipts(spark, str(tmp_path / "run"))
    r.stage("one", [src], lambda p: df.write.parquet(p))
    assert spark.read.parquet(r.verified("one")).count() == 2
    spark.read.parquet(src).write.mode("append").parquet(str(tmp_path / "run" / "one"))
    with pytest.raises(Q.GateFailure):
        r.stage("two", [src], lambda p: df.write.parquet(p), depends=["one"])
    for name in ("../x", "/abs", ""):
        with pytest.raises(ValueError):
            Q.OutputScope("/tmp/x").path(name)
