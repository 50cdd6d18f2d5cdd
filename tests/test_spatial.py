import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import folds as FO
from tesserine.operators import interpolate as N
from tesserine.operators import spatial as S
from tesserine.operators import spatial_regression as SR
from tesserine.operators import zonal as Z


def km(a1, o1, a2, o2):
    p1, p2 = np.radians(a1), np.radians(a2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(o2 - o1) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def clustered(n=120, seed=0):
    """A third of the points share one coordinate; another third sits in a tight cluster."""
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(-85, 85, n), rng.uniform(-180, 180, n)
    lat[: n // 3], lon[: n // 3] = 10.0, 20.0
    m = slice(n // 3, 2 * n // 3)
    lat[m], lon[m] = 48 + rng.normal(0, 0.3, n // 3), 2 + rng.normal(0, 0.3, n // 3)
    return pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon, "v": rng.normal(size=n)})


@pytest.mark.parametrize("exclude", ["self", "coordinate", None])
@pytest.mark.parametrize("k", [1, 6])
def test_nearest_is_exact_under_copies_and_clusters(spark, exclude, k):
    f = clustered()
    df = spark.createDataFrame(f)
    points = df.select(F.col("id").alias("p"), "lat", "lon")
    got = S.nearest(df, points if exclude != "self" else df, k, "id", "p" if exclude != "self" else "id", exclude).toPandas()
    name = "neighbour" if exclude == "self" else "p"
    d = km(f.lat.to_numpy()[:, None], f.lon.to_numpy()[:, None], f.lat.to_numpy(), f.lon.to_numpy())
    for i in range(len(f)):
        ok = np.ones(len(f), bool)
        if exclude == "self":
            ok[i] = False
        elif exclude == "coordinate":
            ok = ~((f.lat == f.lat[i]) & (f.lon == f.lon[i])).to_numpy()
        cand = np.flatnonzero(ok)
        want = cand[np.lexsort((cand, np.round(d[i, cand], 4)))][:k]
        rows = got[got.id == i].sort_values("rank")
        assert rows[name].tolist() == want.tolist()


def test_nearest_with_fewer_points_than_k(spark):
    f = clustered(6)
    df = spark.createDataFrame(f)
    assert S.nearest(df, df, 50, "id", "id").groupBy("id").count().agg(F.min("count"), F.max("count")).first()[:] == (5, 5)


@pytest.mark.parametrize("radius", [50.0, 2500.0, 21000.0])
def test_pairs_and_counts_within_radius(spark, radius):
    f = clustered(90)
    df = spark.createDataFrame(f)
    d = km(f.lat.to_numpy()[:, None], f.lon.to_numpy()[:, None], f.lat.to_numpy(), f.lon.to_numpy())
    near = (d <= radius) & ~np.eye(len(f), dtype=bool)
    assert S.near_pairs(df, "id", radius).count() == near.sum()
    got = S.count_within(df, "id", radius).toPandas().sort_values("id")["n_near"].to_numpy()
    np.testing.assert_array_equal(got, near.sum(axis=1))


def test_ring_statistics_from_coordinate_sums(spark):
    f = clustered(90)
    rings = [0.0, 40.0, 3000.0, 9000.0]
    got = S.ring_statistics(spark.createDataFrame(f), "v", rings).toPandas().set_index("ring")
    d = km(f.lat.to_numpy()[:, None], f.lon.to_numpy()[:, None], f.lat.to_numpy(), f.lon.to_numpy())
    z = f.v.to_numpy() - f.v.mean()
    for r, (a, b) in enumerate(zip(rings, rings[1:])):
        w = ((d >= a) & (d < b) & ~np.eye(len(f), dtype=bool)).astype(float)
        assert got.n_pairs[r] == w.sum() / 2
        assert got.morans_i[r] == pytest.approx(len(f) / w.sum() * (z @ w @ z) / (z @ z))
        i, j = np.nonzero(np.triu(w))
        assert got.semivariance[r] == pytest.approx(0.5 * np.mean((z[i] - z[j]) ** 2))


def weights(edges, ids):
    place = {v: i for i, v in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for e in edges.collect():
        w[place[e.i], place[e.j]] += e.w
    return w


def test_autocorrelation_against_matrices(spark):
    f = clustered(60)
    df = spark.createDataFrame(f)
    edges = S.knn_weights(df, "id", 5)
    w, z = weights(edges, f.id), f.v.to_numpy() - f.v.mean()
    m = S.moran(df, edges, "id", "v", draws=39).first()
    assert m.statistic == pytest.approx(len(z) / w.sum() * (z @ w @ z) / (z @ z))
    assert 1 / 40 <= m.p_value <= 1 and m.reason is None
    c = S.geary(df, edges, "id", "v").first()
    assert c.statistic == pytest.approx((len(z) - 1) * (w * (z[:, None] - z) ** 2).sum() / (2 * w.sum() * (z @ z)))
    local = S.local_moran_p(df, edges, "id", "v", 19).toPandas().sort_values("id")
    np.testing.assert_allclose(local.local_i, z * (w @ z) / np.mean(z * z))
    assert local.p_value.between(1 / 20, 1).all()


def test_unavailable_statistics_carry_a_reason(spark):
    f = clustered(21).assign(flat=1.0)
    df = spark.createDataFrame(f)
    assert S.moran(df, S.knn_weights(df, "id", 3), "id", "flat").first().reason == "constant_residuals"
    two = spark.createDataFrame(f.head(2))
    assert S.moran(two, S.knn_weights(two, "id", 1), "id", "v").first().reason == "insufficient_samples"


def test_weight_schemes_are_row_standardised(spark):
    f = clustered(40, seed=3)
    df = spark.createDataFrame(f)
    for edges in (S.band_weights(df, "id", 200.0), S.inverse_distance_weights(df, "id", 9000.0, 2.0)):
        t = edges.groupBy("i").agg(F.sum("w").alias("s")).agg(F.min("s"), F.max("s"), F.count("*")).first()
        assert t[0] == pytest.approx(1.0) and t[1] == pytest.approx(1.0)
    assert S.band_weights(df, "id", 200.0).select("i").distinct().count() == 40  # isolates got a neighbour


def test_idw_exact_hits_average_coincident_values(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 0.0, 0.0, 4.0), (3, 5.0, 5.0, 9.0)], ["p", "lat", "lon", "v"])
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 1.0, 1.0)], ["q", "lat", "lon"])
    got = {r.q: r.idw for r in N.idw(N.neighbour_values(q, pts, 3, "q", "p", "v", None), "q", "v").collect()}
    assert got[1] == 3.0 and got[2] == 9.0
    d = km(1.0, 1.0, np.array([0.0, 0.0, 5.0]), np.array([0.0, 0.0, 5.0]))
    assert got[3] == pytest.approx(np.sum(np.array([2.0, 4.0, 9.0]) / d**2) / np.sum(1 / d**2))


def test_kriging_reproduces_known_points_and_constants(spark):
    f = clustered(60)[40:].reset_index(drop=True)
    pts = spark.createDataFrame(f.rename(columns={"id": "p"}))
    model = spark.createDataFrame([(0.0, 1.0, 4000.0)], ["nugget", "psill", "range_km"])
    q = spark.createDataFrame(f[["id", "lat", "lon"]].rename(columns={"id": "q"}))
    near = N.neighbour_values(q, pts, 6, "q", "p", "v", None)
    got = N.ordinary_kriging(near, "q", "v", model).toPandas().sort_values("q")
    np.testing.assert_allclose(got.kriging, f.v, atol=1e-6)
    flat = N.ordinary_kriging(near.withColumn("v", F.lit(7.0)), "q", "v", model).toPandas()
    np.testing.assert_allclose(flat.kriging, 7.0)


def test_variogram_recovers_a_planted_shape():
    h = np.linspace(100, 4000, 14)
    u = np.minimum(h / 2000, 1)
    nug, sill, rng = N._fit_spherical(pd.DataFrame({"h": h, "gamma": 0.2 + 0.8 * (1.5 * u - 0.5 * u**3), "n": 50.0}))
    assert nug == pytest.approx(0.2, abs=0.03) and sill == pytest.approx(0.8, abs=0.03) and rng == pytest.approx(2000, rel=0.05)


def test_points_in_polygon_and_nearest_edge(spark):
    ring = [(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(ring, ring[1:])], ["x1", "y1", "x2", "y2"])
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 25.0), (3, -1.0, 5.0), (4, 60.0, 120.0)], ["id", "lat", "lon"])
    assert {r.id: r.inside for r in S.points_in_polygon(pts, "id", edges).collect()} == {1: True, 2: False, 3: False, 4: False}
    d = {r.id: r.degrees for r in S.nearest_edge(pts, "id", edges).collect()}
    assert d[1] == pytest.approx(5.0) and d[2] == pytest.approx(5.0) and d[3] == pytest.approx(1.0)
    assert d[4] == pytest.approx(np.hypot(100.0, 50.0))


def test_nearest_arc_matches_dense_sampling(spark):
    arcs = [(0.0, 0.0, 30.0, 0.0), (30.0, 0.0, 60.0, 40.0), (-170.0, 50.0, 170.0, 50.0)]
    pts = pd.DataFrame({"id": range(5), "lat": [10.0, -20.0, 60.0, 0.0, 45.0], "lon": [10.0, 40.0, 179.0, 15.0, 20.0]})
    got = S.nearest_arc(spark.createDataFrame(pts), "id", spark.createDataFrame(arcs, ["x1", "y1", "x2", "y2"])).toPandas().set_index("id").km
    def xyz(la, lo):
        p, q = np.radians(la), np.radians(lo)
        return np.array([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])
    for r in pts.itertuples():
        best = np.inf
        for x1, y1, x2, y2 in arcs:
            a, b = xyz(y1, x1), xyz(y2, x2)
            om = np.arccos(np.clip(a @ b, -1, 1))
            t = np.linspace(0, 1, 20001)[:, None]
            line = (np.sin((1 - t) * om) * a + np.sin(t * om) * b) / np.sin(om)
            best = min(best, 6371.0088 * np.arccos(np.clip(line @ xyz(r.lat, r.lon), -1, 1)).min())
        assert got[r.id] == pytest.approx(best, abs=1.0)


def test_adjacency_wraps_and_buffers_hold(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 3, 2), (1, 1, 3)], ["ilat", "ilon", "z"])
    got = {(r.a, r.b): (r.shared_edges, r.shared_corners) for r in Z.adjacency(cells, "z", 4).collect()}
    assert got == {(1, 2): (1, 0), (1, 3): (0, 1)}
    f = clustered(60)
    df = spark.createDataFrame(f)
    kept = S.outside_buffer(df.where("id >= 30"), df.where("id < 30"), 800.0).toPandas()
    test = f[f.id < 30]
    for r in kept.itertuples():
        assert km(r.lat, r.lon, test.lat.to_numpy(), test.lon.to_numpy()).min() > 800.0


def test_folds_keep_coordinates_together_and_respect_the_buffer(spark):
    f = clustered(60)
    df = spark.createDataFrame(f)
    folds = FO.grouped_random(df, 5)
    assert folds.groupBy("lat", "lon").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    one = folds.toPandas().set_index("id").fold
    train = FO.training_rows(folds, "id", "fold", 500.0).toPandas()
    d = km(f.lat.to_numpy()[:, None], f.lon.to_numpy()[:, None], f.lat.to_numpy(), f.lon.to_numpy())
    want = {(i, k) for i, k in itertools.product(f.id, sorted(one.unique())) if one[i] != k and not (d[i][(one.sort_index() == k).to_numpy()] <= 500).any()}
    assert set(zip(train.id, train.fold)) == want
    km_folds = FO.spherical_kmeans(df, 4, restarts=2).groupBy("fold").agg(F.avg("lon").alias("m")).orderBy("fold").toPandas()
    assert km_folds.fold.tolist() == [0, 1, 2, 3] and km_folds.m.is_monotonic_increasing


def dense_fit(y, x, w, family):
    n = len(y)
    def at(t):
        m = np.eye(n) - t * w
        yt, xt = m @ y, (m @ x if family == "sem" else x)
        b = np.linalg.lstsq(xt, yt, rcond=None)[0]
        e = yt - xt @ b
        return -(n / 2) * (np.log(2 * np.pi) + 1) - (n / 2) * np.log(e @ e / n) + np.linalg.slogdet(m)[1], b, e
    grid = np.linspace(-0.99, 0.99, 3961)
    t = grid[int(np.argmax([at(v)[0] for v in grid]))]
    return t, at(t)


@pytest.mark.parametrize("family", ["sem", "sar"])
def test_spatial_regression_against_dense_likelihood(spark, family):
    rng = np.random.default_rng(5)
    n = 60
    f = pd.DataFrame({"id": np.arange(n), "lat": rng.uniform(-60, 60, n), "lon": rng.uniform(-170, 170, n), "a": rng.normal(50, 9, n), "b": rng.normal(size=n)})
    edges = S.knn_weights(spark.createDataFrame(f), "id", 6)
    w = weights(edges, f.id)
    noise = rng.normal(size=n)
    mean = 1 + 0.05 * f.a + 0.8 * f.b
    m = np.eye(n) - 0.5 * w
    f["y"] = mean + np.linalg.solve(m, noise) if family == "sem" else np.linalg.solve(m, mean + noise)
    df = spark.createDataFrame(f)
    got = SR.fit_spatial(df, edges, "id", "y", ["a", "b"], family).first()
    x = np.column_stack([np.ones(n), f.a, f.b])
    theta, (loglik, beta, e) = dense_fit(f.y.to_numpy(), x, w, family)
    assert got.theta == pytest.approx(theta, abs=1e-3) and got.loglik == pytest.approx(loglik, abs=1e-4)
    np.testing.assert_allclose(got.beta, beta, rtol=5e-3, atol=5e-3)
    assert got.lower < got.theta < got.upper
    q = SR.fitted_quantities(df, edges, "id", "y", ["a", "b"], family).toPandas().sort_values("id")
    assert np.mean(q.innovation**2) == pytest.approx(got.sigma2, rel=1e-6)
    acc = SR.accounting(df, edges, "id", "y", ["a", "b"], family).first()
    assert acc.a_static + acc.a_dependence + acc.a_innovation == pytest.approx(1.0)
    held = SR.cross_validated(df.withColumn("fold", F.col("id") % 3), "id", "y", ["a", "b"], [family], "fold", 6, [0, 1, 2])
    assert held.count() == n and held.where("prediction is null or isnan(prediction)").isEmpty()


def test_local_p_values_come_from_the_reference_draws(spark):
    from tesserine.plans import spatial_plans  # noqa: F401
    from tesserine.plans.registry import QUERIES

    p = [r.p_value for r in QUERIES["P14_local_moran_fdr"](spark, "/root/testdata/sf0.001").collect() if r.p_value is not None]
    assert p and all(abs(x * 1000 - round(x * 1000)) < 1e-9 for x in p) and any(abs(x * 200 - round(x * 200)) > 1e-9 for x in p)


def test_left_out_scores_and_the_winning_surface(spark):
    rng = np.random.default_rng(11)
    f = clustered(90, seed=11)
    f["v"] = np.sin(np.radians(f.lat * 2)) + rng.normal(size=len(f)) * 0.01
    df = spark.createDataFrame(f)
    near = N.left_out_neighbours(df, "id", "v", 6).toPandas()
    d = np.round(km(f.lat.to_numpy()[:, None], f.lon.to_numpy()[:, None], f.lat.to_numpy(), f.lon.to_numpy()), 4)
    twin = (f.lat.to_numpy()[:, None] == f.lat.to_numpy()) & (f.lon.to_numpy()[:, None] == f.lon.to_numpy())
    predictions = {}
    for name, gone in (("location", twin), ("row", np.eye(len(f), dtype=bool))):
        rows = near[near.left_out == name]
        predictions[name] = np.empty(len(f))
        for i in range(len(f)):
            cand = np.flatnonzero(~gone[i])
            want = cand[np.lexsort((cand, d[i, cand]))][:6]
            got = rows[rows.q == i].sort_values("rank")
            np.testing.assert_allclose(got.v, f.v.to_numpy()[want])
            dist = km(f.lat[i], f.lon[i], f.lat.to_numpy()[want], f.lon.to_numpy()[want])
            v = f.v.to_numpy()[want]
            predictions[name][i] = v[dist == 0].mean() if (dist == 0).any() else np.sum(v / dist**2) / np.sum(1 / dist**2)
    model = spark.createDataFrame([(0.0, 1.0, 9000.0)], "nugget double, psill double, range_km double")
    nodes = spark.createDataFrame([(k, k * 7 - 60.5, k * 17 - 150.5) for k in range(18)], "node long, lat double, lon double")
    scores, winner, surface = N.best_surface(df, "id", "v", nodes, "node", 6, model)
    table = {(r.left_out, r.method): r for r in scores.collect()}
    for name, p in predictions.items():
        assert table[name, "idw"].rmse == pytest.approx(np.sqrt(np.mean((p - f.v) ** 2))) and table[name, "idw"].n == len(f)
    assert table["row", "idw"].rmse < table["location", "idw"].rmse  # twins leak the answer
    # a smooth field with a fitting variogram is kriged better: the surface follows
    assert winner == "kriging" and table["location", "kriging"].rmse < table["location", "idw"].rmse
    assert {r.method for r in surface.collect()} == {"kriging"} and surface.count() == 18
    # nothing but nugget makes kriging a plain mean: inverse distance wins and the surface is its own
    flat = spark.createDataFrame([(1.0, 0.0, 9000.0)], "nugget double, psill double, range_km double")
    _, winner, surface = N.best_surface(df, "id", "v", nodes, "node", 6, flat)
    q = np.array([[r.node, r.value] for r in surface.orderBy("node").collect()])
    assert winner == "idw"
    for k, value in q:
        dist = km(k * 7 - 60.5, k * 17 - 150.5, f.lat.to_numpy(), f.lon.to_numpy())
        best = np.lexsort((f.id.to_numpy(), np.round(dist, 4)))[:6]
        assert value == pytest.approx(np.sum(f.v.to_numpy()[best] / dist[best] ** 2) / np.sum(1 / dist[best] ** 2))


def test_left_out_lists_need_a_neighbour(spark):
    same = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 2.0)], "id long, lat double, lon double, v double")
    with pytest.raises(ValueError, match="no neighbours"):
        N.left_out_neighbours(same, "id", "v", 3)


def test_no_z_where_every_draw_gives_one_statistic(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), float(i * i % 7)) for i in range(12)], "id long, lat double, lon double, v double")
    m = S.moran(df, S.band_weights(df, "id", 9000.0), "id", "v", 99).first()  # every unit neighbours every other
    assert m.statistic == pytest.approx(-1 / 11) and m.p_value == 1.0 and m.z_score is None


@pytest.mark.parametrize("lookup", [0, 1000])
def test_local_p_of_draws_dealt_out_to_many_tasks(spark, monkeypatch, lookup):
    from hashlib import md5
    monkeypatch.setattr(S, "TASK_TRIALS", 50)
    monkeypatch.setattr(S, "LOOKUP_ROWS", lookup)
    rng = np.random.default_rng(8)
    n, draws = 14, 49
    f = pd.DataFrame({"id": np.arange(n) * 3, "lat": rng.uniform(-60, 60, n), "lon": rng.uniform(-180, 180, n), "v": rng.normal(size=n)})
    df = spark.createDataFrame(f)
    edges = S.knn_weights(df, "id", 4)
    got = S.local_moran_p(df, edges, "id", "v", draws).toPandas().set_index("id")
    z = (f.v - f.v.mean()).to_numpy()
    for pos, key in enumerate(f.id):
        others, count = np.delete(z, pos), 0
        for d in range(1, draws + 1):
            chosen = []
            for t in range(n - 5, n - 1):
                c = int(int(md5(f"0|{d}|{key}|{t}".encode()).hexdigest()[:12], 16) / 16**12 * (t + 1))
                chosen.append(t if c in chosen else c)
            count += abs(z[pos] * others[chosen].mean() / np.mean(z * z)) >= abs(got.local_i[key]) - 1e-12
        assert got.p_value[key] == pytest.approx((count + 1) / (draws + 1))
