"""Block search of nearest coordinates against brute force: clusters, ties, foreign queries and bounded blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import neighbours as NB
from tesserine.operators import pyramid as PY
from tesserine.operators import spatial as S


def brute(f, q, k):
    """Row numbers of the k nearest points of each query by rounded kilometres, then id."""
    d = NB._km(q.lat.to_numpy(), q.lon.to_numpy(), f.lat.to_numpy(), f.lon.to_numpy())
    rank = np.round(d, NB.TIE_DIGITS)
    return [f.id.to_numpy()[np.lexsort((f.id.to_numpy(), rank[i]))[:k]].tolist() for i in range(len(q))]


def two_spots(n, seed=0):
    """Half in a spot of some metres, half in one of some kilometres."""
    rng = np.random.default_rng(seed)
    half = n // 2
    lat = np.concatenate([51.5 + rng.normal(0, 1e-4, half), -33.9 + rng.normal(0, 0.02, n - half)])
    lon = np.concatenate([rng.normal(0, 1e-4, half), 179.99 + rng.normal(0, 0.02, n - half)])
    return pd.DataFrame({"id": rng.permutation(n), "lat": lat, "lon": np.where(lon > 180, lon - 360, lon)})


@pytest.mark.parametrize("spread", ["even", "spots", "lattice"])
def test_blocks_give_the_same_neighbours(spark, monkeypatch, spread):
    monkeypatch.setattr(NB, "BLOCK_POINTS", 64)
    monkeypatch.setattr(NB, "TASK_QUERIES", 100)
    rng = np.random.default_rng(4)
    if spread == "even":
        f = pd.DataFrame({"id": np.arange(900), "lat": np.degrees(np.arcsin(rng.uniform(-1, 1, 900))), "lon": rng.uniform(-180, 180, 900)})
    elif spread == "spots":
        f = two_spots(900)
    else:  # many equal distances
        f = pd.DataFrame([(i, float(i // 30 * 3 - 45), float(i % 30 * 12 - 180)) for i in range(900)], columns=["id", "lat", "lon"])
    q = pd.concat([f.sample(60, random_state=1), pd.DataFrame({"id": -np.arange(1, 4), "lat": [90.0, 0.0, -33.0], "lon": [0.0, 180.0, -179.9]})])
    points = spark.createDataFrame(f).withColumnRenamed("id", "p")
    got = S.nearest(spark.createDataFrame(q), points, 5, "id", "p", None).toPandas()
    want = dict(zip(q.id, brute(f, q, 5), strict=True))
    for i, rows in got.groupby("id"):
        rows = rows.sort_values("rank")
        place = {int(r.id): (r.lat, r.lon) for r in f.itertuples()}
        if spread == "lattice":  # equal kilometres may differ in their last digit
            at = q[q.id == i].iloc[0]
            d = NB._km(np.array([at.lat]), np.array([at.lon]), np.array([place[p][0] for p in rows.p]), np.array([place[p][1] for p in rows.p]))[0]
            w = NB._km(np.array([at.lat]), np.array([at.lon]), np.array([place[p][0] for p in want[i]]), np.array([place[p][1] for p in want[i]]))[0]
            np.testing.assert_allclose(d, w, atol=2e-4)
        else:
            assert rows.p.tolist() == want[i]
    assert len(got) == 5 * len(q)


def test_many_queries_of_one_block_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK_POINTS", 50)
    monkeypatch.setattr(NB, "TASK_QUERIES", 40)
    f = two_spots(400)
    rng = np.random.default_rng(9)
    q = pd.DataFrame({"id": np.arange(700), "lat": 51.5 + rng.normal(0, 2e-5, 700), "lon": rng.normal(0, 2e-5, 700)})
    got = S.nearest(spark.createDataFrame(q), spark.createDataFrame(f).withColumnRenamed("id", "p"), 3, "id", "p", None)
    assert got.groupBy("id").agg(F.collect_list("p").alias("p")).count() == 700
    rows = {r.id: r.p for r in got.orderBy("id", "rank").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "p"))).alias("l")).select("id", F.col("l.p").alias("p")).collect()}
    want = brute(f, q, 3)
    assert all(rows[i] == want[i] for i in range(700))


def test_two_spots_of_two_hundred_thousand_points(spark):
    f = two_spots(200_000)
    q = f.sample(150, random_state=2)
    points = spark.createDataFrame(f).withColumnRenamed("id", "p")
    asked = []
    search = NB._search

    def watched(targets, placed, need):
        asked.append((placed.groupBy("_block").count().agg(F.max("count")).first()[0], targets.groupBy("_block").count().agg(F.sum("count")).first()[0]))
        return search(targets, placed, need)

    NB._search = watched
    try:
        got = S.nearest(spark.createDataFrame(q), points, 4, "id", "p", None).toPandas()
    finally:
        NB._search = search
    assert max(n for n, _ in asked) < 2 * NB.BLOCK_POINTS  # no block, so no key, holds more
    assert asked[1][1] < 20 * len(q)  # few blocks are asked beyond the first
    want = dict(zip(q.id, brute(f, q, 4), strict=True))
    assert all(rows.sort_values("rank").p.tolist() == want[i] for i, rows in got.groupby("id"))


def test_curve_code_is_an_interleaving(spark):
    r = spark.createDataFrame([(0.0, 0.0), (0.0, 180.0), (90.0, 0.0)], "lat double, lon double").select(NB.curve_code("lat", "lon").alias("c")).collect()
    assert [x.c >= 0 for x in r] == [True] * 3 and len({x.c for x in r}) == 3


def many(n, seed=0):
    """Some copies of coordinates, one tight spot, the rest spread evenly."""
    rng = np.random.default_rng(seed)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[: n // 4], lon[: n // 4] = 48 + rng.normal(0, 0.2, n // 4), 2 + rng.normal(0, 0.2, n // 4)
    lat[n // 4: n // 3], lon[n // 4: n // 3] = 10.0, 20.0
    return pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon, "v": rng.normal(size=n)})


@pytest.mark.parametrize(("rings", "pairs"), [([0.0, 40.0, 3000.0, 9000.0], 64), ([100.0, 800.0, 21000.0], 9), ([0.0, 21000.0], 1)])
def test_rings_from_the_pyramid_equal_all_pairs(spark, monkeypatch, rings, pairs):
    monkeypatch.setattr(S, "PAIRED_DIRECTLY", 10)
    monkeypatch.setattr(PY, "DIRECT_PAIRS", pairs)
    f = many(300)
    got = S.ring_statistics(spark.createDataFrame(f), "v", rings).toPandas().set_index("ring")
    d = NB._km(*(f[c].to_numpy() for c in ("lat", "lon", "lat", "lon")))
    z = f.v.to_numpy() - f.v.mean()
    for r, (a, b) in enumerate(zip(rings, rings[1:], strict=False)):
        w = ((d >= a) & (d < b) & ~np.eye(len(f), dtype=bool)).astype(float)
        assert got.n_pairs[r] == w.sum() / 2
        assert got.morans_i[r] == pytest.approx(len(f) / w.sum() * (z @ w @ z) / (z @ z))
        i, j = np.nonzero(np.triu(w))
        assert got.semivariance[r] == pytest.approx(0.5 * np.mean((z[i] - z[j]) ** 2))


@pytest.mark.parametrize("radius", [0.0, 30.0, 2500.0, 21000.0])
def test_counts_from_the_pyramid_equal_all_pairs(spark, monkeypatch, radius):
    monkeypatch.setattr(S, "PAIRED_DIRECTLY", 10)
    monkeypatch.setattr(PY, "DIRECT_PAIRS", 25)
    f = many(240, seed=3)
    got = S.count_within(spark.createDataFrame(f), "id", radius).toPandas().sort_values("id")["n_near"].to_numpy()
    d = NB._km(*(f[c].to_numpy() for c in ("lat", "lon", "lat", "lon")))
    np.testing.assert_array_equal(got, (d <= radius).sum(axis=1) - 1)


def test_two_spots_meet_as_whole_cubes(spark):
    f = two_spots(200_000).assign(v=lambda x: np.sin(x.id))
    coords = PY.coded(spark.createDataFrame(f).groupBy("lat", "lon").agg(F.count("*").alias("n")))
    whole, direct = PY.cube_pairs(PY.pyramid(coords, ["n"]), ["n"], [0.0, 500.0, 20_100.0], half=True)
    assert direct.count() == 0 and whole.count() <= 10  # no coordinate is compared with another
    got = S.ring_statistics(spark.createDataFrame(f), "v", [0.0, 500.0, 20_100.0]).toPandas().set_index("ring").n_pairs
    assert got[0] == 2 * (100_000 * 99_999 // 2) and got[1] == 100_000 ** 2


def test_buffers_need_only_the_nearest_test_row(spark):
    f = many(200, seed=5)
    df = spark.createDataFrame(f)
    kept = {r.id for r in S.outside_buffer(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), 700.0).collect()}
    d = NB._km(*(f[c].to_numpy() for c in ("lat", "lon", "lat", "lon")))
    assert kept == {i for i in range(200) if i % 5 and not (d[i, ::5] <= 700.0).any()}


@pytest.mark.parametrize(("rings", "batch"), [([0.0, 40.0, 3000.0, 9000.0], 1 << 20), ([0.0, 800.0, 21000.0], 400), ([100.0, 800.0, 21000.0], 1)])
def test_training_semivariances_of_all_folds_equal_each_fold_by_itself(spark, monkeypatch, rings, batch):
    monkeypatch.setattr(PY, "BATCH_PAIRS", batch)
    f = many(260, seed=9).assign(fold=lambda x: x.id % 4)  # records at one coordinate are in different folds
    got = S.training_semivariances(spark.createDataFrame(f), "v", "fold", rings).toPandas().set_index(["fold", "ring"])
    d = NB._km(*(f[c].to_numpy() for c in ("lat", "lon", "lat", "lon")))
    v = f.v.to_numpy()
    for fold in range(4):
        kept = (f.fold != fold).to_numpy()
        for r, (a, b) in enumerate(zip(rings, rings[1:], strict=False)):
            i, j = np.nonzero(np.triu((d >= a) & (d < b) & kept[:, None] & kept, 1))
            assert got.n_pairs[fold, r] == len(i)
            assert got.semivariance[fold, r] == pytest.approx(0.5 * np.mean((v[i] - v[j]) ** 2))
