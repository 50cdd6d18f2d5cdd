"""Exact nearest coordinates: curve-ordered blocks of bounded size, a local search, and an exchange across block borders.

Coordinates are put in the order of a space-filling curve and cut into blocks of equally many; where they lie does not matter, so two spots that
hold everything make blocks of the same size as an even spread. A query searches one block that is near, which bounds its k-th distance,
and then only the blocks whose boxes reach into that distance. At most `MOST_BLOCKS` boxes are sent to the tasks, because blocks
grow with the table beyond that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.columns import EARTH_RADIUS_KM, haversine_km, unit_xyz
from tesserine.operators.ordering import row_ids
from tesserine.session import cut_lineage

#: Coordinates of a block, queries that meet one block in a task, and boxes at most.
BLOCK_POINTS, TASK_QUERIES, MOST_BLOCKS = 1024, 4096, 100_000
#: Distances equal to this many decimals of a kilometre are ties, resolved by identity.
TIE_DIGITS = 4
_BITS = 20
#: How far apart the bits of one axis are spread for an interleaved code: shift and mask of each step (fixed values).
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def curve_code(lat: str, lon: str) -> Column:
    """Place on a curve through cubes of about ten metres: near codes lie near each other."""
    code = F.lit(0).cast("long")
    for k, axis in enumerate(unit_xyz(lat, lon)):
        v = F.least(F.floor((axis + 1.0) / 2.0 * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("long")
        for shift, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        code = code.bitwiseOR(F.shiftleft(v, k))
    return code


def _xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    phi, lam = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])


def _km(lat: np.ndarray, lon: np.ndarray, plat: np.ndarray, plon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat)[:, None], np.radians(plat)[None, :]
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(plon[None, :] - lon[:, None]) / 2) ** 2
    return 2.0 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


def _sender(boxes: np.ndarray, near: bool):
    """Rows of a query and a block: the nearest box (`near`), or all other boxes that reach into the known distance."""
    low, high = boxes[:, :3], boxes[:, 3:]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(lat), 64):
                q = _xyz(lat[at: at + 64], lon[at: at + 64])[:, None, :]
                gap = np.maximum(np.maximum(low - q, q - high), 0.0)
                least = np.sqrt((gap ** 2).sum(axis=2))
                if near:
                    most = (np.maximum(np.abs(low - q), np.abs(high - q)) ** 2).sum(axis=2)
                    row, block = np.arange(len(q)), np.where(least <= least.min(axis=1, keepdims=True), most, np.inf).argmin(axis=1)
                    reach = np.full(len(row), np.nan)
                else:
                    home, km = (batch.column(i).to_numpy(zero_copy_only=False)[at: at + 64] for i in (2, 3))
                    chord = 2 * np.sin(np.minimum((km + 2 * 10.0 ** -TIE_DIGITS) / (2 * EARTH_RADIUS_KM), np.pi / 2)) + 1e-12
                    row, block = np.nonzero((least <= chord[:, None]) & (np.arange(len(boxes)) != home[:, None]))
                    reach = km[row]
                yield pa.RecordBatch.from_arrays([pa.array(lat[at: at + 64][row]), pa.array(lon[at: at + 64][row]), pa.array(block.astype(np.int64)), pa.array(reach)],
                                                 names=["lat", "lon", "_block", "_reach"])

    return send


def _search(targets: DataFrame, placed: DataFrame, need: int) -> DataFrame:
    """(lat, lon, plat, plon, _first, _block): up to `need` coordinates of the block nearest to each target and within its reach.

    Targets of a block are dealt out in groups of about `TASK_QUERIES`, each with its own copy of the block.
    """
    sizes = targets.groupBy("_block").agg(F.ceil(F.count("*") / F.lit(float(TASK_QUERIES))).cast("int").alias("_parts"))
    asked = targets.join(sizes, "_block").withColumn("_part", F.pmod(F.xxhash64("lat", "lon"), F.col("_parts"))).drop("_parts")
    held = placed.select("_block", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "_first").join(sizes, "_block")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    kind = dict(placed.dtypes)["_first"]

    def find(points: pa.Table, queries: pa.Table) -> pa.Table:
        plat, plon = points.column("plat").to_numpy(), points.column("plon").to_numpy()
        lat, lon, reach = (queries.column(c).to_numpy() for c in ("lat", "lon", "_reach"))
        order = np.unique(points.column("_first").to_numpy(), return_inverse=True)[1] if len(plat) else np.empty(0, np.int64)
        take, rows, cols = min(need, len(plat)), [], []
        for at in range(0, len(lat), 256) if take else ():
            km = _km(lat[at: at + 256], lon[at: at + 256], plat, plon)
            rank = np.rint(km * 10 ** TIE_DIGITS).astype(np.int64) * len(plat) + order
            best = np.argpartition(rank, take - 1, axis=1)[:, :take]
            limit = reach[at: at + 256, None]
            row, place = np.nonzero(np.isnan(limit) | (np.take_along_axis(km, best, axis=1) <= limit + 2 * 10.0 ** -TIE_DIGITS))
            rows.append(row + at)
            cols.append(best[row, place])
        row, col = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, cols))
        block = queries.column("_block").combine_chunks().take(pa.array(row))
        return pa.table({"lat": lat[row], "lon": lon[row], "plat": plat[col], "plon": plon[col], "_first": points.column("_first").take(pa.array(col)), "_block": block})

    both = held.groupBy("_block", "_part").cogroup(asked.groupBy("_block", "_part"))
    return both.applyInArrow(find, f"lat double, lon double, plat double, plon double, _first {kind}, _block long")


def closest_coordinates(queries: DataFrame, coords: DataFrame, need: int) -> DataFrame:
    """(lat, lon, plat, plon, _first, km) with the `need` nearest of `coords` (lat, lon, _first) to every distinct query coordinate, and maybe some more.

    Order is by kilometres to `TIE_DIGITS` decimals, then by `_first`.
    """
    km = haversine_km("lat", "lon", "plat", "plon")
    queries = queries.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna().distinct()
    coords = cut_lineage(coords.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "_first").dropna())
    n = coords.count()
    size = max(BLOCK_POINTS, 4 * need, -(-n // MOST_BLOCKS))
    blocks = max(1, n // size)
    if blocks == 1:
        targets = queries.select("lat", "lon", F.lit(0).cast("long").alias("_block"), F.lit(float("nan")).alias("_reach"))
        return _search(targets, coords.withColumn("_block", F.lit(0).cast("long")), need).withColumn("km", km).drop("_block")
    ordered = row_ids(coords.withColumn("_code", curve_code("lat", "lon")), ["_code", "lat", "lon"], "_pos")
    # the last block takes the remainder, so every block holds at least `size` coordinates
    placed = cut_lineage(ordered.select("lat", "lon", "_first", F.least(F.floor(F.col("_pos") / size), F.lit(blocks - 1)).cast("long").alias("_block")))
    x, y, z = unit_xyz("lat", "lon")
    axes = placed.select("_block", x.alias("x"), y.alias("y"), z.alias("z")).groupBy("_block").agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    found = axes.orderBy("_block").collect()  # at most MOST_BLOCKS rows
    boxes = np.array([r[1:] for r in found], float) + np.array([-1e-12] * 3 + [1e-12] * 3)
    kinds = "lat double, lon double, _block long, _reach double"
    home = queries.mapInArrow(_sender(boxes, near=True), kinds)
    first = cut_lineage(_search(home, placed, need).withColumn("km", km))
    known = first.groupBy("lat", "lon").agg(F.first("_block").alias("_home"), F.max("km").alias("_far"))
    others = known.mapInArrow(_sender(boxes, near=False), kinds)
    second = _search(others, placed, need).withColumn("km", km)
    return first.unionByName(second).drop("_block")
