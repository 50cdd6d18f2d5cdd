"""Gridded fields in long form: zone reductions, neighbours, geometry, coverage states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.columns import band_cell_area_km2, unit_xyz

RING = tuple((di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if (di, dj) != (0, 0))
CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def axis(spark, name: str, first: float, step: float, size: int) -> DataFrame:
    """Cell centres of one regular axis."""
    return spark.range(size).select(F.col("id").alias(f"i{name}"), (F.lit(first) + F.lit(step) * F.col("id")).alias(name))


def grid(spark, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """All cells of a regular grid, generated by index arithmetic (no product of two tables)."""
    cell = spark.range(n_lat * n_lon)
    ilat, ilon = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
    return cell.select(ilat.alias("ilat"), ilon.alias("ilon"), (F.lit(lat0) + step * ilat).alias("lat"), (F.lit(lon0) + step * ilon).alias("lon"))


def neighbours(cells: DataFrame, offsets: Sequence[tuple[int, int]], n_lon: int, row: str = "ilat", col: str = "ilon") -> DataFrame:
    """One row per cell and offset with the neighbour index; columns wrap around the date line."""
    steps = F.array(*[F.struct(F.lit(a).cast("bigint").alias("di"), F.lit(b).cast("bigint").alias("dj")) for a, b in offsets])
    return cells.withColumn("_o", F.explode(steps)).select(
        *[c for c in cells.columns], "_o.di", "_o.dj", (F.col(row) + F.col("_o.di")).alias("nrow"), F.pmod(F.col(col) + F.col("_o.dj"), F.lit(n_lon)).alias("ncol"))


def area_weighted(value: Column, lat: Column) -> Column:
    """cos(latitude) weighted mean over cells that hold a value."""
    w = F.when(value.isNotNull(), F.greatest(F.cos(F.radians(lat)), F.lit(0.0)))
    return F.sum(w * value) / F.nullif(F.sum(w), F.lit(0.0))


def adjacency(cells: DataFrame, zone: str, n_lon: int) -> DataFrame:
    """Pairs of zones that touch: shared edges and shared corners, date line included.

    Each cell looks right, down and down the two diagonals, so a pair of cells
    is counted once; the lookup is an equi-join on the cell index.
    """
    land = cells.where(F.col(zone).isNotNull()).select("ilat", "ilon", F.col(zone).alias("_a"))
    look = neighbours(land, ((0, 1), (1, 0), (1, 1), (1, -1)), n_lon)
    other = land.select(F.col("ilat").alias("nrow"), F.col("ilon").alias("ncol"), F.col("_a").alias("_b"))
    touch = look.join(other, ["nrow", "ncol"]).where("_a <> _b")
    edge = (F.col("di") == 0) | (F.col("dj") == 0)
    return touch.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(
        F.count_if(edge).alias("shared_edges"), F.count_if(~edge).alias("shared_corners"))


def zone_geometry(cells: DataFrame, zone: str, step: float, n_lat: int, n_lon: int) -> DataFrame:
    """Area, spherical centroid, latitude spread and coastal share per zone."""
    land = cells.where(F.col(zone).isNotNull())
    around = neighbours(land.select("ilat", "ilon"), CROSS, n_lon)
    occupied = land.select(F.col("ilat").alias("nrow"), F.col("ilon").alias("ncol"))
    inner = around.join(occupied, ["nrow", "ncol"]).groupBy("ilat", "ilon").agg(F.count("*").alias("_sides"))
    area = band_cell_area_km2(F.col("clat") - step / 2, F.col("clat") + step / 2, step)
    x, y, z = unit_xyz("clat", "clon")
    work = land.join(inner, ["ilat", "ilon"], "left").withColumns(
        {"_w": area, "_x": x, "_y": y, "_z": z, "_coast": (F.coalesce("_sides", F.lit(0)) < 4).cast("double")})
    w = F.col("_w")
    sums = work.groupBy(zone).agg(
        F.count("*").alias("n_cells"), F.sum(w).alias("area_km2"), F.sum(w * F.col("_x")).alias("sx"), F.sum(w * F.col("_y")).alias("sy"),
        F.sum(w * F.col("_z")).alias("sz"), F.min("clat").alias("lat_min"), F.max("clat").alias("lat_max"),
        F.sum(w * F.col("clat")).alias("s1"), F.sum(w * F.col("clat") * F.col("clat")).alias("s2"), F.sum(w * F.col("_coast")).alias("sc"))
    mean = F.col("s1") / F.col("area_km2")
    return sums.select(
        zone, "n_cells", "area_km2", F.degrees(F.atan2("sy", "sx")).alias("centroid_lon"),
        F.degrees(F.asin(F.col("sz") / F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2))).alias("centroid_lat"),
        "lat_min", "lat_max", F.sqrt(F.greatest(F.col("s2") / F.col("area_km2") - mean * mean, F.lit(0.0))).alias("lat_sd"),
        (F.col("sc") / F.col("area_km2")).alias("coastal_share"))


def ring_donors(needy: DataFrame, donors: DataFrame, n_lon: int, step: float) -> DataFrame:
    """Nearest valid cell among the eight neighbours; ties by row then column."""
    look = neighbours(needy.select("ilat", "ilon"), RING, n_lon)
    valid = donors.select(F.col("ilat").alias("nrow"), F.col("ilon").alias("ncol"), F.col("value").alias("donor_value"))
    lat = F.radians((F.col("ilat") + F.col("nrow")) / 2.0 * step - 90.0 + step / 2)
    distance = F.sqrt((F.col("di") * 1.0) ** 2 + (F.col("dj") * F.cos(lat)) ** 2)
    ranked = look.join(valid, ["nrow", "ncol"]).withColumn("_d", F.round(distance, 9))
    best = F.min_by(F.struct("nrow", "ncol", "donor_value"), F.struct("_d", "nrow", "ncol"))
    found = ranked.groupBy("ilat", "ilon").agg(best.alias("_b")).select("ilat", "ilon", F.col("_b.nrow").alias("donor_row"), F.col("_b.ncol").alias("donor_col"), "_b.donor_value")
    return needy.join(found, ["ilat", "ilon"], "left")


def same_zone_ring_mean(cells: DataFrame, zone: str, value: str, n_lon: int) -> DataFrame:
    """Mean of the neighbours that belong to the same zone."""
    look = neighbours(cells.where(F.col(zone).isNotNull()).select("ilat", "ilon", F.col(zone).alias("_z")), RING, n_lon)
    other = cells.select(F.col("ilat").alias("nrow"), F.col("ilon").alias("ncol"), F.col(zone).alias("_nz"), F.col(value).alias("_v"))
    return look.join(other, ["nrow", "ncol"]).where("_z = _nz").groupBy("ilat", "ilon").agg(F.avg("_v").alias("ring_mean"), F.count("_v").alias("n_ring"))
