"""The whole stability summary against plain least squares on the drawn rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tesserine.operators import neighbours as NB
from tesserine.operators import resample as RS
from tesserine.operators import stability as ST

GROUPS = {"place": ["p", "q"], "wealth": ["w"], "size": ["s"]}
FEATURES = ["p", "q", "w", "s"]


def r2(f, cols, y):
    if not cols:
        return 0.0
    m = np.column_stack([np.ones(len(f)), f[cols].to_numpy()])
    e = f[y].to_numpy() - m @ np.linalg.lstsq(m, f[y].to_numpy(), rcond=None)[0]
    d = f[y] - f[y].mean()
    return 1 - e @ e / (d @ d) if d @ d > 1e-18 else 0.0


def shares(f, y):
    names, out = list(GROUPS), {}
    for g in names:
        rest = [o for o in names if o != g]
        out[g] = 0.0
        for size in range(len(rest) + 1):
            for combo in itertools.combinations(rest, size):
                cols = [c for o in combo for c in GROUPS[o]]
                out[g] += math.factorial(size) * math.factorial(len(names) - size - 1) / math.factorial(len(names)) * (r2(f, cols + GROUPS[g], y) - r2(f, cols, y))
    out["residual"] = 1 - r2(f, FEATURES, y)
    return out


def frame(n, seed):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame(rng.normal(size=(n, 4)), columns=FEATURES)
    f["y"] = f.p + 0.5 * f.w + rng.normal(size=n) + 300.0
    f["y2"] = f.y + 0.3 * rng.normal(size=n)
    f["id"], f["zone"] = np.arange(n), np.array(list("ABCDE"))[np.arange(n) % 5]
    f["lat"], f["lon"] = rng.uniform(-60, 60, n), rng.uniform(-180, 180, n)
    return f


@pytest.fixture(scope="module")
def case(spark):
    f = frame(40, 2)
    f.loc[3, "w"] = np.nan
    f.loc[4, "y"] = np.nan
    f.loc[5, "y2"] = np.nan
    f.loc[6, "zone"] = None
    f.loc[7, "lat"] = np.nan
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None), "p double, q double, w double, s double, y double, y2 double, id long, zone string, lat double, lon double")
    got = ST.stability_blocks(df, df.select("id", "lat", "lon"), "id", "zone", GROUPS, ["y", "y2"], draws=60, k=5, permutations=49, seed=4).toPandas()
    return f, df, got.set_index(["block", "outcome", "group", "item"])


@pytest.mark.parametrize("y", ["y", "y2"])
@pytest.mark.parametrize("kind", ["unit_draws", "block_draws"])
def test_share_statistics_equal_refits_of_drawn_rows(case, y, kind):
    f, df, got = case
    draws = RS.digest_draws(df, "id", 60, 4) if kind == "unit_draws" else RS.block_draws(df.where("zone is not null"), "id", "zone", 60, 5)
    complete = f.dropna(subset=[*FEATURES, "y", y]).set_index("id")
    rows = []
    for _, g in draws.toPandas().groupby("draw"):
        g = g[g.id.isin(complete.index)]
        rows.append(shares(complete.loc[np.repeat(g.id.to_numpy(), g.times.to_numpy())], y))
    found, point = pd.DataFrame(rows), shares(complete, y)
    lead = found[list(GROUPS)].idxmax(axis=1)
    for g in [*GROUPS, "residual"]:
        at = lambda item: got.value[kind, y, g, item]
        low, high = np.percentile(found[g], [2.5, 97.5])
        for item, want in {"point": point[g], "mean": found[g].mean(), "std": found[g].std(), "ci_low": low, "ci_high": high, "n_failed": 0}.items():
            assert at(item) == pytest.approx(want, abs=1e-8), (g, item)
        if g != "residual":
            assert at("p_largest") == pytest.approx((lead == g).mean()) and at("p_positive") == pytest.approx((found[g] > 0).mean())
    assert sum(got.value[kind, y, g, "mean"] for g in [*GROUPS, "residual"]) == pytest.approx(1.0)


def test_influence_ranks_units_by_the_share_they_move(case):
    f, _, got = case
    complete = f.dropna(subset=[*FEATURES, "y"])
    full = shares(complete, "y")
    without = {i: shares(complete[complete.id != i], "y") for i in complete.id}
    for g in GROUPS:
        want = sorted(((round(abs(full[g] - s[g]), 9), -i) for i, s in without.items()), reverse=True)[: ST.TOP]
        mine = got.loc["influence", "y", g].reset_index().sort_values("rank")
        assert mine["item"].tolist() == [str(-i) for _, i in want]
        assert all(r.value == pytest.approx(full[g] - without[int(r.item)][g], abs=1e-8) for r in mine.itertuples())
    assert set(got.loc["influence"].index.get_level_values("outcome")) == {"y"}


@pytest.mark.parametrize("y", ["y", "y2"])
def test_residual_autocorrelation_equals_a_dense_statistic(case, y):
    f, _, got = case
    g = f.dropna(subset=[*FEATURES, "y", y])
    m = np.column_stack([np.ones(len(g)), g[FEATURES].to_numpy()])
    g = g.assign(e=g[y].to_numpy() - m @ np.linalg.lstsq(m, g[y].to_numpy(), rcond=None)[0]).dropna(subset=["lat"])
    z, d = (g.e - g.e.mean()).to_numpy(), np.round(NB._km(g.lat.to_numpy(), g.lon.to_numpy(), g.lat.to_numpy(), g.lon.to_numpy()), 4)
    total = 0.0
    for i in range(len(g)):
        others = np.array([j for j in range(len(g)) if j != i])
        total += z[i] * z[others[np.lexsort((g.id.to_numpy()[others], d[i, others]))[:5]]].mean()
    at = got.loc["residual_spatial", y, ""]
    assert at.value["morans_i"] == pytest.approx(total / (z @ z), abs=1e-8)
    assert 1 / 50 <= at.value["p_value"] <= 1 and at.value["n"] == len(g) and at.value["n_permutations"] == 49 and at.value["k_neighbors"] == 5
    assert at.reason.isna().all()


def test_few_units_have_a_reason_and_an_empty_design_no_rows(spark):
    f = frame(7, 1)
    df = spark.createDataFrame(f)
    got = ST.stability_blocks(df.unionByName(df), df.select("id", "lat", "lon"), "id", "zone", {"a": ["p"], "b": ["q"]}, ["y"], draws=5, k=8, permutations=9).toPandas()
    spatial = got[got.block == "residual_spatial"].set_index("item")
    assert spatial.reason["morans_i"] == "insufficient_samples_for_requested_neighbors" and np.isnan(spatial.value["morans_i"]) and spatial.value["n"] == 7
    assert set(got[got.block == "influence"]["rank"]) == set(range(1, 8))
    none = ST.stability_blocks(df.limit(0), df.select("id", "lat", "lon"), "id", "zone", {"a": ["p"], "b": ["q"]}, ["y"], draws=5)
    assert none.count() == 0
