"""Results that must not depend on caps, fixed lists or widths, and scans that must be pruned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators.inequality import dispersion, lorenz_points
from tesserine.operators.tables import years_of
from tesserine.plans import catalog
from tesserine.plans.registry import QUERIES
from tesserine.sources import grids as GR

SF = "/root/testdata/sf0.001"
catalog.load()


def test_lorenz_has_a_point_per_tied_row(spark):
    d = spark.createDataFrame([(v,) for v in (1.0, 1.0, 2.0, 2.0, 4.0)], "v double")
    got = sorted((round(r.unit_share, 9), round(r.value_share, 9)) for r in lorenz_points(d, "v").collect())
    assert got == [(0.0, 0.0), (0.2, 0.1), (0.4, 0.2), (0.6, 0.4), (0.8, 0.6), (1.0, 1.0)]


def test_weighted_dispersion_in_one_pass(spark):
    x, w = np.array([1.0, 2.0, 7.0]), np.array([1.0, 3.0, 2.0])
    r = dispersion(spark.createDataFrame(list(zip(x.tolist(), w.tolist(), strict=True)), "v double, w double"), "v", F.col("w")).first()
    mean = np.average(x, weights=w)
    assert r["mean"] == pytest.approx(mean) and r["variance"] == pytest.approx(np.average((x - mean) ** 2, weights=w))


@pytest.mark.parametrize("top", [5, 255, 256, 300, 70_000])
def test_image_codes_keep_their_value(top):
    codes = np.array([[0, 1, top]])
    assert GR.geotiff_cells(GR.geotiff_bytes(codes, 1.0, 0.0, 0.0))["code"].tolist() == [0, 1, top]


def test_negative_codes_are_refused():
    with pytest.raises(ValueError):
        GR.geotiff_bytes(np.array([[-1]]), 1.0, 0.0, 0.0)


@pytest.mark.parametrize("zipped", [False, True])
def test_images_go_through_any_file_system(spark, tmp_path, zipped):
    cells = spark.createDataFrame([(r, c, 80.0 - 10 * r, 250 + r + c) for r in range(3) for c in range(4)], "ilat long, ilon long, clat double, code long")
    folder = (tmp_path / "images").as_uri()
    GR.write_files(GR.band_images(cells, 10.0, 4, zipped), "ilat", folder)
    got = GR.read_geotiff(spark, folder, "band.tif" if zipped else None).collect()
    assert sorted(r.code for r in got) == sorted(250 + r + c for r in range(3) for c in range(4))


def test_years_come_from_the_data(spark):
    d = spark.createDataFrame([(1990,), (2024,), (1990,), (None,)], "yr int")
    assert years_of(d, "yr") == [1990, 2024]


@pytest.mark.parametrize("name", ["A1_climatology", "A2_coverage", "J2_left_join_climatology", "J3_gate_semi_join", "E3_cell_trend", "A43_cell_climatology_ratio"])
def test_month_ranges_reach_the_scan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_weighted_variance_of_values_with_a_large_mean(spark):
    x, w = np.array([1e9 + 1, 1e9 + 2, 1e9 + 4]), np.array([1.0, 3.0, 2.0])
    r = dispersion(spark.createDataFrame(list(zip(x.tolist(), w.tolist(), strict=True)), "v double, w double"), "v", F.col("w")).first()
    assert r["variance"] == pytest.approx(np.average((x - np.average(x, weights=w)) ** 2, weights=w), rel=1e-9)
