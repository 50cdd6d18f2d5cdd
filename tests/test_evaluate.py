"""Buffered fits, scorecards and verdict rules against fits made one by one."""

import numpy as np
import pandas as pd
import pytest

from tesserine.operators import evaluate as E
from tesserine.operators import neighbours as NB
from tesserine.operators import spatial as S

GOOD = {"delta": -0.01, "interval": (-0.02, -0.001), "secondary_change": 0.0, "region_change": 0.0, "coefficient": -1.0, "negative": 5, "fits": 5}


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(6)
    n = 80
    f = pd.DataFrame({"id": np.arange(n), "lat": rng.uniform(-60, 60, n), "lon": rng.uniform(-180, 180, n), "x": rng.normal(size=n) + 50, "a": rng.normal(size=n), "fold": np.arange(n) % 4})
    f.loc[:9, ["lat", "lon"]] = 5.0, 5.0  # one place with rows of every fold
    f["y"] = 0.3 * f.x - 2 * f.a + rng.normal(size=n)
    return f, spark.createDataFrame(f)


def by_hand(f, columns, buffer):
    d = NB._km(*(f[c].to_numpy() for c in ("lat", "lon", "lat", "lon")))
    x = np.column_stack([np.ones(len(f)), f[columns].to_numpy()])
    out, used = np.empty(len(f)), np.empty(len(f))
    for k in range(4):
        test = (f.fold == k).to_numpy()
        train = ~test & ~(d[:, test] <= buffer).any(axis=1)
        out[test] = x[test] @ np.linalg.lstsq(x[train], f.y.to_numpy()[train], rcond=None)[0]
        used[test] = train.sum()
    return out, used


def test_scorecards_equal_fits_fold_by_fold(spark, field):
    f, df = field
    edges = S.knn_weights(df, "id", 5)
    got = E.scorecards(df, "id", ["x", "a"], "y", "fold", [100.0, 3000.0], edges).toPandas().set_index("buffer_km")
    w = np.zeros((len(f), len(f)))
    for e in edges.collect():
        w[e.i, e.j] = e.w
    x = np.column_stack([np.ones(len(f)), f.x, f.a])
    inner = f.y - x @ np.linalg.lstsq(x, f.y, rcond=None)[0]
    moran = lambda e: len(e) / w.sum() * ((e - e.mean()) @ w @ (e - e.mean())) / np.sum((e - e.mean()) ** 2)
    for buffer in (100.0, 3000.0):
        hat, used = by_hand(f, ["x", "a"], buffer)
        e, row = f.y.to_numpy() - hat, got.loc[buffer]
        folds = [np.sqrt(np.mean(e[f.fold == k] ** 2)) for k in range(4)]
        slope, start = np.polyfit(hat, f.y, 1)
        want = {"n": 80, "cv_rmse": np.sqrt(np.mean(e**2)), "cv_mae": np.mean(np.abs(e)), "cv_r2": 1 - np.sum(e**2) / np.sum((f.y - f.y.mean()) ** 2), "in_sample_rmse": np.sqrt(np.mean(inner**2)),
                "in_sample_r2": 1 - np.sum(inner**2) / np.sum((f.y - f.y.mean()) ** 2), "mean_n_train": used.mean(), "fold_rmse_median": np.median(folds), "fold_rmse_min": min(folds), "fold_rmse_max": max(folds),
                "worst_fold": int(np.argmax(folds)), "worst_fold_n": 20, "n_folds": 4, "calibration_slope": slope, "calibration_intercept": start, "outcome_sd": f.y.std(ddof=1),
                "residual_moran_cv": moran(e), "residual_moran_in_sample": moran(inner.to_numpy())}
        assert {k: row[k] for k in want} == pytest.approx(want, rel=1e-8)
    assert got.loc[3000.0].mean_n_train < got.loc[100.0].mean_n_train


@pytest.mark.parametrize(("change", "label"), [
    ({}, "supported and promoted"), ({"interval": (-0.02, 0.001)}, "not supported"), ({"delta": 0.01, "interval": (0.001, 0.02)}, "not supported"), ({"negative": 3}, "not supported"),
    ({"negative": 4}, "supported and promoted"), ({"coefficient": 0.5}, "not supported"), ({"delta": -0.0019}, "supported but sub-material / not promoted"),
    ({"secondary_change": 0.0011}, "supported but sub-material / not promoted"), ({"region_change": 0.0011}, "supported but sub-material / not promoted"), ({"region_change": 0.001}, "supported and promoted")])
def test_each_rule_decides(change, label):
    v = E.verdict(**(GOOD | change))
    assert v["verdict"] == label
    assert v["improvement_without_stated_sign"] == (v["s1_interval_below_zero"] and not v["s2_sign_negative_and_stable"]) and v["worsened"] == ("delta" in change and change["delta"] > 0)


@pytest.mark.parametrize("name", ["delta", "secondary_change", "region_change", "coefficient"])
def test_missing_evidence_is_refused(name):
    with pytest.raises(ValueError, match="not finite"):
        E.verdict(**(GOOD | {name: float("nan")}))


def test_verdict_on_a_field(spark, field):
    f, df = field
    f = f.assign(nk=f.id % 20, zone=f.id % 3)
    v = E.candidate_verdict(spark.createDataFrame(f), "id", "nk", "zone", ["x"], "a", "y", "fold", "zone", 100.0, 200).first()
    ea, eb = (f.y.to_numpy() - by_hand(f, c, 100.0)[0] for c in (["x"], ["x", "a"]))
    assert v.delta_rmse == pytest.approx(np.sqrt(np.mean(eb**2)) - np.sqrt(np.mean(ea**2)))
    region = [max(np.sqrt(np.mean(e[f.zone == z] ** 2)) for z in range(3)) for e in (ea, eb)]
    assert v.worst_region_rmse_change == pytest.approx(region[1] - region[0])
    assert v.coefficient_negative_n == v.coefficient_n_fits == 4 and v.verdict == "supported and promoted" and v.interval_high < 0


def test_a_buffer_that_takes_all_training_rows_leaves_no_scorecard(spark, field):
    f, df = field
    edges = S.knn_weights(df, "id", 5)
    got = E.scorecards(df, "id", ["x", "a"], "y", "fold", [100.0, 30_000.0], edges).toPandas()
    assert got.buffer_km.tolist() == [100.0] and got.n.tolist() == [len(f)]
