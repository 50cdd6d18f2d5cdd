"""Moran's I without some units against fresh matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import influence as IN
from tesserine.operators import neighbours as NB


def fresh(f, gone, k=8):
    """Statistic of the units left, computed anew."""
    g = f[~f.id.isin(gone)]
    if len(g) < 3 or g.v.nunique() == 1:
        return None
    d = np.round(NB._km(g.lat.to_numpy(), g.lon.to_numpy(), g.lat.to_numpy(), g.lon.to_numpy()), 4)
    z, need, total = g.v.to_numpy() - g.v.mean(), min(k, len(g) - 1), 0.0
    for i in range(len(g)):
        others = np.array([j for j in range(len(g)) if j != i])
        best = others[np.lexsort((g.id.to_numpy()[others], d[i, others]))[:need]]
        total += z[i] * z[best].mean()
    return total / (z @ z)


def frame(n, seed):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"id": np.arange(n), "lat": rng.uniform(-60, 60, n), "lon": rng.uniform(-180, 180, n), "v": rng.normal(size=n) + 1000.0})
    f.loc[: n // 4, ["lat", "lon"]] = 12.0, 30.0  # a place that holds a quarter of all units
    return f


@pytest.mark.parametrize(("n", "k"), [(60, 8), (11, 8), (40, 3)])
def test_left_out_units_equal_a_fresh_statistic(spark, n, k):
    f = frame(n, n)
    df = spark.createDataFrame(f)
    rng = np.random.default_rng(1)
    groups = {"one": [3], "near": f.id[: n // 4].tolist(), "some": rng.choice(n, n // 3, replace=False).tolist(), "most": f.id[2:].tolist(), "few": f.id[: n - 4].tolist(), "none of them": [9999]}
    drops = spark.createDataFrame([(s, int(i)) for s, ids in groups.items() for i in ids], "scenario string, id long")
    got = {r.scenario: r for r in IN.moran_without(df, "id", "v", drops.union(drops), k).collect()}
    assert set(got) == set(groups) - {"none of them"}
    for s, r in got.items():
        want = fresh(f, groups[s], k)
        assert r.n == n - len(groups[s])
        assert (r.moran is None and r.reason == "insufficient_samples") if want is None else r.moran == pytest.approx(want, abs=1e-9)


def test_jackknife_costs_rows_in_proportion_to_neighbours(spark):
    f = frame(50, 3)
    df = spark.createDataFrame(f)
    got = {r.scenario: r.moran for r in IN.moran_without(df, "id", "v", IN.leave_each_out(df, "id")).collect()}
    assert len(got) == 50 and all(got[i] == pytest.approx(fresh(f, [i]), abs=1e-9) for i in range(50))


def test_scenarios_of_size_and_cluster(spark):
    f = frame(12, 5)
    df = spark.createDataFrame(f)
    top = {(r.scenario, r.id) for r in IN.largest_first(df, "id", "v", [1, 3]).collect()}
    order = np.lexsort((f.id, -np.abs(f.v - f.v.mean())))
    assert top == {("drop_top_1", order[0])} | {("drop_top_3", i) for i in order[:3]}
    labels = spark.createDataFrame([(1, "HH"), (2, "LL"), (3, "ns"), (4, "HL"), (5, None)], "id long, label string")
    assert {(r.scenario, r.id) for r in IN.label_clusters(labels, "id").collect()} == {("drop_cluster_HH", 1), ("drop_cluster_LL", 2), ("drop_both_clusters", 1), ("drop_both_clusters", 2)}
    flat = df.withColumn("v", F.when(F.col("id") == 0, 1.0).otherwise(2.0))
    assert IN.moran_without(flat, "id", "v", flat.where("id = 0").select(F.lit("s").alias("scenario"), "id")).first().reason == "constant_residuals"
