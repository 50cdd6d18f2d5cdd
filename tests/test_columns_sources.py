import datetime as dt
import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions import columns as C
from tesserine.functions import distributions as D
from tesserine.sources import grids as GR
from tesserine.sources import tables as S


def one(spark, expr, **cols):
    return spark.createDataFrame([cols or {"_": 1}]).select(expr.alias("v")).first()["v"]


def test_coordinates(spark):
    rows = spark.createDataFrame([("57.05N", 57.05), (" 10.33w", -10.33), ("0.80S", -0.8)], ["t", "v"])
    got = rows.select("v", C.parse_coordinate("t").alias("p")).collect()
    assert all(r.v == pytest.approx(r.p) for r in got)


@pytest.mark.parametrize("text", ["", "12.5", "12.5X", "abcN", None])
def test_bad_coordinates_stop_the_query(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(PySparkException):
        df.select(C.parse_coordinate("t")).collect()


def test_coordinate_bound(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("91N",)], "t string").select(C.parse_coordinate("t", 90.0)).collect()


def test_window_text():
    assert C.parse_window("1950-01-01..2013-09-01") == (dt.date(1950, 1, 1), dt.date(2013, 9, 1))
    assert C.months_in_window(dt.date(1950, 1, 1), dt.date(2013, 9, 1)) == 765
    for bad in ("1950-01-01", "2000-01-01..1999-01-01", "x..y", "2000-01-01..2000-01-01"):
        with pytest.raises(ValueError):
            C.parse_window(bad)


def test_scalar_expressions(spark):
    assert one(spark, C.significant(F.lit(3.80000000049e-06))) == pytest.approx(3.8e-06, rel=1e-9)
    assert one(spark, C.nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, C.lon_to_180(F.lit(190.0))) == -170.0
    assert one(spark, C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(np.pi * 6371.0088)
    assert one(spark, C.decimal_decades(F.lit(dt.date(2014, 1, 1)))) == pytest.approx((2014 + 0.5 / 12) / 10)
    assert one(spark, C.fractional_year_to_month(F.lit(2014 + 0.5 / 12))) == dt.date(2014, 1, 1)
    with pytest.raises(PySparkException):
        one(spark, C.fractional_year_to_month(F.lit(2014.0)))


def test_natural_cubic_matches_definition(spark):
    knots, x = [1.0, 15.0, 30.0, 60.0], np.array([0.0, 10.0, 20.0, 45.0, 70.0])
    cols = C.natural_cubic_columns("x", knots)
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select(*cols).toPandas().to_numpy()
    cube = lambda t: np.maximum(t, 0.0) ** 3
    d = [(cube(x - k) - cube(x - 60.0)) / (60.0 - k) for k in knots[:3]]
    np.testing.assert_allclose(got, np.column_stack([d[0] - d[2], d[1] - d[2]]), atol=1e-9)
    beyond = np.diff(spark.createDataFrame(pd.DataFrame({"x": [60.0, 70.0, 80.0, 90.0]})).select(cols[0]).toPandas().to_numpy()[:, 0], 2)
    np.testing.assert_allclose(beyond, 0.0, atol=1e-8)  # linear past the last knot


def test_distributions():
    assert D.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert D.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.f_upper(4.0, 3, 20) == pytest.approx(0.0222, abs=2e-4)
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert D.chi2_upper_one(3.841458820694124) == pytest.approx(0.05, abs=1e-9)


def test_ingest_keeps_every_row(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("dt,value,uncertainty,place,unit,latitude,longitude\n"
                    "1950-01-01,1.5,0.2,Århus,Denmark,57.05N,10.33E\n1950-02-01,,0.2,Århus,Denmark,57.05N,10.33E\n"
                    "1950-01-01,20.0,0.1,Lima,Peru,12.05S,77.03W\n1950-01-01,21.0,0.1,Callao,Peru,12.05S,77.03W\n")
    table = S.ingest_locations(S.read_csv(spark, str(path), S.LOCATION_CSV))
    summary = S.ingest_summary(table).first()
    assert (summary.n_rows, summary.n_places, summary.dt_min, summary.dt_max) == (4, 3, "1950-01-01", "1950-02-01")
    assert table.where("value is null").count() == 1
    assert table.where("place = 'Lima'").first().latitude == -12.05


def test_text_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("year", T.LongType()), T.StructField("v", T.DoubleType())])
    titled = tmp_path / "t.csv"
    titled.write_text("Title: something\nyear,v\n1950,1.5\n1951,***\n")
    assert [tuple(r) for r in S.read_titled_csv(spark, str(titled), schema, "Title").orderBy("year").collect()] == [(1950, 1.5), (1951, None)]
    blank = tmp_path / "b.txt"
    blank.write_text(" year   v\n 1950   1.5\n\n 1951  -2.5\n")
    assert S.read_whitespace_table(spark, str(blank), schema).agg(F.sum("v")).first()[0] == -1.0


def test_typed_sink_is_ordered_and_stable(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.FloatType())])
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), (F.col("id") / 3).alias("v"), F.lit("x").alias("stray"))
    S.write_typed(df, str(tmp_path / "out"), schema, ["k"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.schema.simpleString() == schema.simpleString()
    assert [r.k for r in back.sort("k").collect()] == list(range(100))
    with pytest.raises(ValueError):
        S.typed(df.drop("v"), schema)
    with pytest.raises(ValueError):
        S.read_required(spark, str(tmp_path / "out"), ["k", "missing"])
    assert S.read_optional(spark, str(tmp_path / "nothing")) is None


def test_round_floats():
    assert S.round_floats({"a": [1 / 3, 2], "b": True}) == {"a": [0.3333333333, 2], "b": True}


@pytest.mark.parametrize("band", [1, 2, 7])
def test_classic_grid_does_not_depend_on_band_size(spark, tmp_path, band):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(4, 5, 6)).astype("f4")
    values[0, 0, 0] = np.nan
    path = tmp_path / "g.nc"
    path.write_bytes(GR.classic_bytes("temp", np.arange(4.0), np.linspace(-80, 80, 5), np.linspace(0, 300, 6), values))
    got = GR.read_grid(spark, [str(path)], "temp", band).orderBy("time", "lat", "lon").toPandas()
    np.testing.assert_allclose(got["value"].to_numpy(float), values.ravel().astype(float))
    assert GR.read_grid(spark, [str(path)], "temp", band).where("value is null").count() == 1


def test_geotiff_plain_and_zipped(spark, tmp_path):
    codes = np.arange(12, dtype="u1").reshape(3, 4)
    raw = GR.geotiff_bytes(codes, 0.5, -180.0, 90.0)
    (tmp_path / "a.tif").write_bytes(raw)
    got = GR.read_geotiff(spark, str(tmp_path / "a.tif")).toPandas()
    assert got["code"].tolist() == list(range(12)) and got["lat"].max() == 89.75 and got["lon"].min() == -179.75
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("in/a.tif", raw)
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    assert GR.read_geotiff(spark, str(tmp_path / "z.zip"), "in/a.tif").count() == 12


def test_conform_axes(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], ["valid_time", "number"])
    assert GR.conform_axes(df, {"valid_time": "time"}, ["number"]).columns == ["time"]
    with pytest.raises(ValueError):
        GR.conform_axes(df, {}, ["valid_time"])


def test_slab_size_does_not_change_the_result(spark, tmp_path):
    from tesserine.streaming.slabs import ingest_slabs, merged_climatology

    source = tmp_path / "in"
    source.mkdir()
    for i in range(5):
        lines = ["dt,value,uncertainty,place,unit,latitude,longitude"]
        lines += [f"19{50 + i}-0{m}-01,{i + m / 8},0.1,P,U,1.00N,2.00W" for m in range(1, 5)]
        (source / f"{i}.csv").write_text("\n".join(lines) + "\n")
    results = []
    for size in (1, 5):
        out, log = str(tmp_path / f"out{size}"), str(tmp_path / f"log{size}")
        ingest_slabs(spark, str(source), out, log, size)
        ingest_slabs(spark, str(source), out, log, size)  # nothing new: no second count
        results.append(sorted((r.moy, round(r.climatology, 9), r.n) for r in merged_climatology(spark, out).collect()))
    assert results[0] == results[1] and results[0][0] == (1, 2.125, 5)
