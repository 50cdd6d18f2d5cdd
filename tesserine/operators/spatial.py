"""Neighbour search, spatial weights and autocorrelation as equi-joins on cube cells.

Points live on the unit sphere; space is cut into cubes. Records that share a
coordinate collapse to one row before any pairing, so copies never multiply.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.columns import haversine_km, km_to_chord, unit_xyz
from tesserine.operators.coupling import TIE_EPSILON, permuted
from tesserine.operators.neighbours import TIE_DIGITS, closest_coordinates
from tesserine.operators.pyramid import counts_within, fold_ring_sums, ring_of, ring_sums
from tesserine.session import cut_lineage

#: Coordinates up to which all pairs are formed; more go through the pyramid, with the same result.
PAIRED_DIRECTLY = 2_000
#: Trials of a unit (one draw each) that a task makes, and units whose values are sent to every task for looking up.
TASK_TRIALS, LOOKUP_ROWS = 250_000, 1_000_000


def _cube(x: Column | str, size: Column | float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor((x + 1.0) / size).cast("int")


def _around(cell: str) -> Column:
    return F.explode(F.sequence(F.col(cell) - 1, F.col(cell) + 1))


def _with_xyz(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    x, y, z = unit_xyz(lat, lon)
    return df.withColumns({"_x": x, "_y": y, "_z": z})


def _spread_cells(df: DataFrame) -> DataFrame:
    """The 27 cubes around a row's own cube."""
    for c in ("_cx", "_cy", "_cz"):
        df = df.withColumn(c, _around(c))
    return df


def near_coordinates(a: DataFrame, b: DataFrame, radius_km: float, half: bool = False) -> DataFrame:
    """Pairs of distinct coordinates (lat, lon) x (blat, blon) at most `radius_km` apart.

    `a` and `b` carry one row per coordinate; their other columns come along
    (those of `b` prefixed with b). `half` keeps one of (p, q) and (q, p) when
    both sides are the same table. The chord is compared first, so the
    trigonometry runs only for pairs that are kept.
    """
    size = max(km_to_chord(radius_km) * (1 + 1e-9), 1e-6)
    cells = {f"_c{k}": _cube(f"_{k}", size) for k in "xyz"}
    left = _spread_cells(_with_xyz(a).withColumns(cells))
    right = _with_xyz(b).withColumns(cells)
    right = right.select(*[F.col(c).alias(c if c.startswith("_c") else f"b{c}") for c in right.columns])
    gap = sum(((F.col(f"_{k}") - F.col(f"b_{k}")) * (F.col(f"_{k}") - F.col(f"b_{k}")) for k in "xyz"), F.lit(0.0))
    pairs = left.join(right, ["_cx", "_cy", "_cz"]).where(gap <= size * size * (1 + 1e-9))
    if half:
        pairs = pairs.where((F.col("lat") < F.col("blat")) | ((F.col("lat") == F.col("blat")) & (F.col("lon") <= F.col("blon"))))
    km = haversine_km("lat", "lon", "blat", "blon")
    scratch = ["_cx", "_cy", "_cz", *[f"_{k}" for k in "xyz"], *[f"b_{k}" for k in "xyz"]]
    return pairs.drop(*scratch).withColumn("km", km).where(F.col("km") <= radius_km)


def near_pairs(points: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Ordered pairs (i, j, km), i <> j, within the radius.

    The output itself is the pair list, so its size is that of the graph asked for.
    """
    coords = points.select("lat", "lon").distinct()
    near = near_coordinates(coords, coords, radius_km)
    left = points.select(F.col(key).alias("i"), "lat", "lon")
    right = points.select(F.col(key).alias("j"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return near.join(left, ["lat", "lon"]).join(right, ["blat", "blon"]).where("i <> j").select("i", "j", "km")


def nearest(
    queries: DataFrame, points: DataFrame, k: int, qkey: str, pkey: str, exclude: str | None = "self"
) -> DataFrame:
    """The k nearest points of each query: (qkey, pkey, km, rank), ties by smallest point key.

    Exact: coordinates are searched in blocks of bounded size (see `neighbours`). `exclude` drops the
    query's own key ("self") or every point at its coordinate ("coordinate").
    """
    take = k + 1
    coords = points.groupBy("lat", "lon").agg(F.min(pkey).alias("_first"))
    candidate = closest_coordinates(queries, coords, take + 1)
    by_coord = Window.partitionBy("lat", "lon").orderBy(F.round("km", TIE_DIGITS), "_first")
    close = candidate.withColumn("_r", F.row_number().over(by_coord)).where(F.col("_r") <= take + 1)
    # A coordinate contributes at most its k+1 smallest keys; the limit applies before the shuffle.
    heads = (points.select(F.col(pkey).alias("_p"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
             .withColumn("_h", F.row_number().over(Window.partitionBy("plat", "plon").orderBy("_p"))).where(F.col("_h") <= take).drop("_h"))
    listed = close.join(heads, ["plat", "plon"])
    if exclude == "coordinate":
        listed = listed.where((F.col("lat") != F.col("plat")) | (F.col("lon") != F.col("plon")))
    listed = listed.withColumn("_r", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(F.round("km", TIE_DIGITS), "_p"))).where(F.col("_r") <= take)
    joined = queries.select(F.col(qkey).alias("_q"), "lat", "lon").join(listed.select("lat", "lon", "_p", "km", "_r"), ["lat", "lon"])
    if exclude == "self":
        joined = joined.where("_p <> _q")
    final = Window.partitionBy("_q").orderBy("_r")  # at most k+1 rows per query
    return (joined.withColumn("rank", F.row_number().over(final).cast("bigint")).where(F.col("rank") <= k)
            .select(F.col("_q").alias(qkey), F.col("_p").alias("neighbour" if qkey == pkey else pkey), "km", "rank"))


# -- weights -------------------------------------------------------------------

def row_standardise(edges: DataFrame) -> DataFrame:
    total = edges.groupBy("i").agg(F.sum("w").alias("_t"))
    return edges.join(total, "i").where("_t > 0").select("i", "j", (F.col("w") / F.col("_t")).alias("w"))


def knn_weights(points: DataFrame, key: str, k: int) -> DataFrame:
    edges = nearest(points, points, k, key, key).select(F.col(key).alias("i"), F.col("neighbour").alias("j"), F.lit(1.0).alias("w"))
    return row_standardise(edges)


def _fallback(points: DataFrame, key: str, edges: DataFrame, k: int = 1) -> DataFrame:
    """Nearest neighbour(s) for units without any edge."""
    isolated = points.join(edges.select(F.col("i").alias(key)).distinct(), key, "left_anti")
    extra = nearest(isolated, points, k, key, key).select(F.col(key).alias("i"), F.col("neighbour").alias("j"), F.lit(1.0).alias("w"))
    return edges.select("i", "j", "w").unionByName(extra)


def band_weights(points: DataFrame, key: str, cutoff_km: float) -> DataFrame:
    edges = cut_lineage(near_pairs(points, key, cutoff_km).select("i", "j", F.lit(1.0).alias("w")))
    return row_standardise(_fallback(points, key, edges))


def inverse_distance_weights(points: DataFrame, key: str, cutoff_km: float, power: float = 1.0) -> DataFrame:
    """Truncated inverse distance; coincident pairs have no finite weight and drop out."""
    pairs = near_pairs(points, key, cutoff_km).where("km > 0")
    return row_standardise(pairs.select("i", "j", (1.0 / F.pow("km", F.lit(power))).alias("w")))


def contiguity_weights(points: DataFrame, key: str, pairs: DataFrame, fallback_k: int = 1) -> DataFrame:
    """Symmetric contiguity from (a, b) pairs; units without neighbours fall back to the nearest."""
    known = points.select(F.col(key).alias("i"))
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"))).distinct()
    inside = both.join(known, "i", "left_semi").join(known.withColumnRenamed("i", "j"), "j", "left_semi")
    edges = cut_lineage(inside.select("i", "j", F.lit(1.0).alias("w")))
    return row_standardise(_fallback(points, key, edges, fallback_k))


# -- autocorrelation -------------------------------------------------------------

def _centred(values: DataFrame, key: str, value: str) -> DataFrame:
    mu = values.agg(F.avg(value)).scalar()
    return values.select(F.col(key).alias("id"), (F.col(value) - mu).alias("z"))


def _reason(values: DataFrame, edges: DataFrame, value: str) -> Column:
    v = values.agg(F.struct(F.count("*").alias("n"), F.count(value).alias("k"), F.min(value).alias("lo"), F.max(value).alias("hi")).alias("v")).scalar()
    s0 = edges.agg(F.sum("w")).scalar()
    return (F.when(v["n"] < 3, "insufficient_samples").when(v["k"] < v["n"], "nonfinite_values")
            .when(F.coalesce(s0, F.lit(0.0)) <= 0, "unusable_neighbors").when(v["lo"] == v["hi"], "constant_residuals"))


def moran(values: DataFrame, edges: DataFrame, key: str, value: str, draws: int = 0, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """Global Moran's I, its permutation p (tail on |I|) and z; a reason instead of NaN.

    Where all draws give one statistic, as when every unit neighbours every other, there is no spread to scale by and z is NULL.
    """
    z = cut_lineage(_centred(values, key, value))
    edges = cut_lineage(edges)
    zz = z.agg(F.struct(F.sum(F.col("z") * F.col("z")).alias("q"), F.count("*").alias("n")).alias("t")).scalar()
    s0 = edges.agg(F.sum("w")).scalar()
    scale = zz["n"] / s0 / F.nullif(zz["q"], F.lit(0.0))
    cross = (edges.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j"))
    out = cross.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c")).select((scale * F.col("c")).alias("statistic"), (-1.0 / (zz["n"] - 1)).alias("expected"))
    if draws:
        out = cut_lineage(out)
        shuffled = permuted(z, "id", "z", draws, seed, max_rows)
        # Join the permuted values to both ends of each edge inside the draw.
        a = shuffled.select("draw", F.col("id").alias("i"), F.col("permuted").alias("zi"))
        b = shuffled.select("draw", F.col("id").alias("j"), F.col("permuted").alias("zj"))
        stats = cut_lineage(edges.join(a, "i").join(b, ["draw", "j"]).groupBy("draw").agg((scale * F.sum(F.col("w") * F.col("zi") * F.col("zj"))).alias("s")))
        null = stats.agg(F.struct(F.avg("s").alias("m"), F.stddev_samp("s").alias("d")).alias("t")).scalar()
        observed = out.select("statistic").scalar()
        extreme = stats.agg(F.count_if(F.abs("s") >= F.abs(observed) - TIE_EPSILON)).scalar()
        out = out.withColumns({"p_value": (extreme + 1) / F.lit(draws + 1.0), "z_score": F.when(null["d"] > TIE_EPSILON, (F.col("statistic") - null["m"]) / null["d"])})
    return out.withColumn("reason", _reason(values, edges, value))


def geary(values: DataFrame, edges: DataFrame, key: str, value: str, draws: int = 0, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """Geary's C with a permutation p on |C - 1|."""
    z = cut_lineage(_centred(values, key, value))
    edges = cut_lineage(edges)
    zz = z.agg(F.struct(F.sum(F.col("z") * F.col("z")).alias("q"), F.count("*").alias("n")).alias("t")).scalar()
    s0 = edges.agg(F.sum("w")).scalar()
    scale = (zz["n"] - 1) / (2.0 * s0 * F.nullif(zz["q"], F.lit(0.0)))
    d2 = F.col("w") * (F.col("zi") - F.col("zj")) * (F.col("zi") - F.col("zj"))
    cross = edges.join(z.select(F.col("id").alias("i"), F.col("z").alias("zi")), "i").join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
    out = cross.agg(F.sum(d2).alias("c")).select((scale * F.col("c")).alias("statistic"), F.lit(1.0).alias("expected"))
    if draws:
        out = cut_lineage(out)
        shuffled = permuted(z, "id", "z", draws, seed, max_rows)
        a = shuffled.select("draw", F.col("id").alias("i"), F.col("permuted").alias("zi"))
        b = shuffled.select("draw", F.col("id").alias("j"), F.col("permuted").alias("zj"))
        stats = edges.join(a, "i").join(b, ["draw", "j"]).groupBy("draw").agg((scale * F.sum(d2)).alias("s"))
        observed = out.select("statistic").scalar()
        extreme = stats.agg(F.count_if(F.abs(F.col("s") - 1) >= F.abs(observed - 1) - TIE_EPSILON)).scalar()
        out = out.withColumn("p_value", (extreme + 1) / F.lit(draws + 1.0))
    return out.withColumn("reason", _reason(values, edges, value))


def local_moran(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Per unit: z, spatial lag, local statistic and quadrant."""
    z = cut_lineage(_centred(values, key, value))
    m2 = z.agg(F.avg(F.col("z") * F.col("z"))).scalar()
    lag = edges.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("zj")).alias("lag"))
    joined = z.join(lag, z["id"] == lag["i"], "left")
    up, near = F.col("z") >= 0, F.col("lag") >= 0
    quadrant = F.when(F.col("lag").isNull(), "unavailable").when(up & near, "HH").when(up, "HL").when(near, "LH").otherwise("LL")
    return joined.select(F.col("id").alias(key), "z", "lag", (F.col("z") * F.col("lag") / F.nullif(m2, F.lit(0.0))).alias("local_i"), quadrant.alias("quadrant"))


def local_moran_p(values: DataFrame, edges: DataFrame, key: str, value: str, draws: int, seed: int = 0, max_rows: int | None = None) -> DataFrame:
    """Conditional permutation p per unit: the other units' values are drawn without replacement.

    Each (unit, draw) picks as many positions as the unit has neighbours by
    Floyd's sampling over position numbers, so a draw costs one row per
    neighbour and never a row per other unit.
    """
    from tesserine.operators.ordering import row_ids

    local = cut_lineage(local_moran(values, edges, key, value))
    z = cut_lineage(row_ids(local.select(key, "z"), [key], "_pos", max_rows))
    n = z.count()
    m2 = z.agg(F.avg(F.col("z") * F.col("z"))).scalar()
    weights = edges.groupBy(F.col("i").alias(key)).agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("_e"))  # one row per neighbour
    units = z.join(weights, key).select(key, F.col(key).cast("string").alias("_text"), "_pos", F.col("_e.w").alias("_w"))
    # A few thousand units make millions of picks: they are spread by the picks, not by the size of the unit table.
    units = units.repartition(max(z.sparkSession.sparkContext.defaultParallelism, n * draws // TASK_TRIALS), key)

    def pick(batches):
        for batch in batches:
            for at, (text, pos, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_text", "_pos", "_w")), strict=True)):
                last = np.arange(n - 1 - len(w), n - 1)
                u = b"".join(md5(f"{seed}|{d}|{text}|{t}".encode()).digest()[:6] for d in range(1, draws + 1) for t in last.tolist())
                u = np.frombuffer(u, np.uint8).reshape(draws, len(w), 6) @ 256.0 ** np.arange(5, -1, -1) / float(16**12)
                drawn = np.floor(u * (last + 1)).astype(np.int64)
                for s in range(1, len(w)):  # a position drawn before gives way to the last one allowed
                    drawn[:, s] = np.where((drawn[:, :s] == drawn[:, s, None]).any(axis=1), last[s], drawn[:, s])
                rows = drawn.size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(np.full(rows, at))), pa.array(np.repeat(np.arange(1, draws + 1, dtype=np.int32), len(w))),
                     pa.array(np.tile(np.array(w, float), draws)), pa.array((drawn + (drawn >= pos)).ravel())], names=[key, "draw", "w", "_other"])

    placed = units.mapInArrow(pick, f"`{key}` {dict(units.dtypes)[key]}, draw int, w double, _other long")
    found = z.select(F.col("_pos").alias("_other"), F.col("z").alias("zj"))
    drawn = placed.join(F.broadcast(found) if n <= LOOKUP_ROWS else found, "_other")
    lags = drawn.groupBy(key, "draw").agg(F.sum(F.col("w") * F.col("zj")).alias("_lag"))
    sims = lags.join(z.select(key, F.col("z").alias("zi")), key).withColumn("sim", F.col("zi") * F.col("_lag") / m2)
    scored = sims.join(local.select(key, "local_i"), key).groupBy(key).agg(
        ((F.count_if(F.abs("sim") >= F.abs("local_i") - TIE_EPSILON) + 1) / F.lit(draws + 1.0)).alias("p_value"))
    return local.join(scored, key, "left").withColumn(
        "label", F.when(F.col("quadrant") == "unavailable", "unavailable").when(F.col("p_value") < 0.05, F.col("quadrant")).otherwise("ns"))


def _direct_rings(sums: DataFrame, edges_km: list[float]) -> DataFrame:
    """`ring_sums` of few coordinates, pair by pair."""
    near = near_coordinates(sums, sums, edges_km[-1], half=True)
    same = (F.col("lat") == F.col("blat")) & (F.col("lon") == F.col("blon"))
    count = F.when(same, F.col("n") * (F.col("n") - 1)).otherwise(2 * F.col("n") * F.col("bn"))
    cross = F.when(same, F.col("s") * F.col("s") - F.col("q")).otherwise(2.0 * F.col("s") * F.col("bs"))
    square = F.when(same, 2.0 * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))).otherwise(
        2.0 * (F.col("bn") * F.col("q") + F.col("n") * F.col("bq") - 2.0 * F.col("s") * F.col("bs")))
    return near.withColumns({"ring": ring_of(F.col("km"), edges_km), "_c": count, "_x": cross, "_d": square}).where(F.col("ring").isNotNull()).groupBy("ring").agg(
        F.sum("_c").alias("c"), F.sum("_x").alias("x"), F.sum("_d").alias("d")).where("c > 0")


def ring_statistics(points: DataFrame, value: str, edges_km: list[float]) -> DataFrame:
    """Per distance ring: pairs, Moran's I (binary weights) and semivariance.

    Sums per coordinate (count, sum, sum of squares) carry everything a pair of
    coordinates contributes, so records at one place are never paired one by one.
    """
    mu = points.agg(F.avg(value)).scalar()
    z = points.select("lat", "lon", (F.col(value) - mu).alias("z"))
    sums = cut_lineage(z.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")))
    total = sums.agg(F.struct(F.sum("n").alias("n"), F.sum("q").alias("q")).alias("t")).scalar()
    rings = ring_sums(sums, edges_km) if sums.count() > PAIRED_DIRECTLY else _direct_rings(sums, edges_km)
    return rings.select("ring", (F.col("c") / 2).cast("bigint").alias("n_pairs"), (total["n"] / F.col("c") * F.col("x") / total["q"]).alias("morans_i"), (F.col("d") / F.col("c") / 2.0).alias("semivariance"))


def training_semivariances(points: DataFrame, value: str, fold: str, edges_km: list[float]) -> DataFrame:
    """(fold, ring, n_pairs, semivariance) of the rows outside every fold, from one comparison of all coordinates.

    A pair counts for all folds that hold neither of its rows, so no fold is compared by itself.
    """
    mu = points.agg(F.avg(value)).scalar()
    z = points.select("lat", "lon", F.col(fold).cast("long").alias("fold"), (F.col(value) - mu).alias("z"))
    sums = cut_lineage(z.groupBy("lat", "lon", "fold").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q")))
    pairs = cut_lineage(fold_ring_sums(sums, edges_km))
    out = sums.select(F.col("fold").alias("_out")).distinct()
    kept = pairs.join(out, (F.col("fold") != F.col("_out")) & (F.col("bfold") != F.col("_out"))).groupBy("_out", "ring").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).where("c > 0")
    return kept.select(F.col("_out").alias(fold), "ring", (F.col("c") / 2).cast("bigint").alias("n_pairs"), (F.col("d") / F.col("c") / 2.0).alias("semivariance"))


def count_within(points: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Other points within the radius of each point, counted per coordinate first."""
    sums = cut_lineage(points.groupBy("lat", "lon").agg(F.count("*").alias("n")))
    if sums.count() > PAIRED_DIRECTLY:
        around = counts_within(sums, radius_km).withColumnRenamed("total", "_t")
    else:
        around = near_coordinates(sums, sums, radius_km).groupBy("lat", "lon").agg(F.sum("bn").alias("_t"))
    return points.join(around, ["lat", "lon"]).select(key, (F.col("_t") - 1).alias("n_near"))


def outside_buffer(train: DataFrame, test: DataFrame, buffer_km: float) -> DataFrame:
    """Training rows farther than the buffer from every test row: those whose nearest test row is."""
    tests = test.groupBy("lat", "lon").agg(F.lit(0).alias("_first"))
    near = closest_coordinates(train, tests, 1).where(F.col("km") <= buffer_km)
    return train.join(near.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti")


def zone_distances(cells: DataFrame, zone: str, radius_km: float) -> DataFrame:
    """Smallest cell-centre distance of every pair of zones closer than the radius."""
    land = cut_lineage(cells.where(F.col(zone).isNotNull()).select("lat", "lon", F.col(zone).alias("z")).distinct())
    return (near_coordinates(land, land, radius_km).where("z < bz").groupBy(F.col("z").alias("a"), F.col("bz").alias("b"))
            .agg(F.min("km").alias("km")))


# -- polygon edges ---------------------------------------------------------------

def cell_boundary(cells: DataFrame, step: float, n_lon: int) -> DataFrame:
    """Edges between land cells and anything else, as planar segments."""
    land = cells.select("ilat", "ilon", "clat", "clon")
    sides = F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("di", "dj", "ax", "ay", "bx", "by"), side)]) for side in (
            (1, 0, -0.5, 0.5, 0.5, 0.5), (-1, 0, -0.5, -0.5, 0.5, -0.5), (0, 1, 0.5, -0.5, 0.5, 0.5), (0, -1, -0.5, -0.5, -0.5, 0.5))]))
    look = land.select("*", sides.alias("s")).select(
        "ilat", "ilon", (F.col("ilat") + F.col("s.di")).alias("nrow"), F.pmod(F.col("ilon") + F.col("s.dj"), F.lit(n_lon)).alias("ncol"),
        *[(F.col("clon" if c.endswith("x") else "clat") + step * F.col(f"s.{c}")).alias(n) for c, n in (("ax", "x1"), ("ay", "y1"), ("bx", "x2"), ("by", "y2"))])
    occupied = land.select(F.col("ilat").alias("nrow"), F.col("ilon").alias("ncol"))
    return look.join(occupied, ["nrow", "ncol"], "left_anti").select("x1", "y1", "x2", "y2")


def points_in_polygon(points: DataFrame, key: str, edges: DataFrame, band: float = 1.0) -> DataFrame:
    """Even-odd ray casting; points meet only the edges of their own latitude band."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.where("y1 <> y2").select(
        "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))).alias("_b"))
    crossing = (((F.col("y1") <= F.col("lat")) & (F.col("lat") < F.col("y2"))) | ((F.col("y2") <= F.col("lat")) & (F.col("lat") < F.col("y1"))))
    x_at = F.col("x1") + (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    coords = points.select("lat", "lon").distinct().withColumn("_b", F.floor(F.col("lat") / band))
    hits = coords.join(spread, "_b").where(crossing & (F.col("lon") < x_at)).groupBy("lat", "lon").agg(F.count("*").alias("_hits"))
    return points.join(hits, ["lat", "lon"], "left").select(key, (F.coalesce("_hits", F.lit(0)) % 2 == 1).alias("inside"))


def nearest_edge(points: DataFrame, key: str, edges: DataFrame, first_step: float = 5.0) -> DataFrame:
    """Distance to the nearest boundary point: planar nearest point, great-circle length.

    Squares around a point are searched with doubling side; a point is settled as
    soon as its best planar distance is no longer than the side.
    """
    edges = cut_lineage(edges.distinct())
    open_points = cut_lineage(points.select("lat", "lon").distinct())
    done: list[DataFrame] = []
    step = first_step
    while True:
        def index(c, s=step):
            return F.floor(c / s).cast("int")
        cells = edges.select("*", F.explode(F.sequence(index(F.least("x1", "x2")), index(F.greatest("x1", "x2")))).alias("_i")).select(
            "*", F.explode(F.sequence(index(F.least("y1", "y2")), index(F.greatest("y1", "y2")))).alias("_j"))
        probe = open_points.withColumns({"_i": index(F.col("lon")), "_j": index(F.col("lat"))})
        probe = probe.withColumn("_i", _around("_i")).withColumn("_j", _around("_j"))
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        t = F.least(F.greatest(((F.col("lon") - F.col("x1")) * dx + (F.col("lat") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        near = probe.join(cells, ["_i", "_j"]).withColumn("_t", F.coalesce(t, F.lit(0.0))).withColumns({"px": F.col("x1") + F.col("_t") * dx, "py": F.col("y1") + F.col("_t") * dy})
        near = near.withColumn("_d", F.sqrt((F.col("lon") - F.col("px")) ** 2 + (F.col("lat") - F.col("py")) ** 2)).withColumn("km", haversine_km("lat", "lon", "py", "px"))
        best = near.groupBy("lat", "lon").agg(F.min(F.struct(F.round("_d", 9).alias("d"), F.round("km", 6).alias("km"))).alias("_b"))
        settled = cut_lineage(best.where((F.col("_b.d") <= step) | F.lit(step >= 720.0)).select("lat", "lon", F.col("_b.d").alias("degrees"), F.col("_b.km").alias("km")))
        done.append(settled)
        open_points = cut_lineage(open_points.join(settled, ["lat", "lon"], "left_anti"))
        if step >= 720.0 or open_points.isEmpty():
            break
        step *= 2.0
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return points.join(found, ["lat", "lon"]).select(key, "degrees", "km")


# -- great-circle segments ---------------------------------------------------------

def _slerp(t: Column) -> tuple[Column, Column]:
    """Latitude and longitude at fraction t of the arc (x1, y1) -> (x2, y2)."""
    ax, ay, az = unit_xyz("y1", "x1")
    bx, by, bz = unit_xyz("y2", "x2")
    omega = F.acos(F.least(F.greatest(ax * bx + ay * by + az * bz, F.lit(-1.0)), F.lit(1.0)))
    wa = F.when(omega > 1e-12, F.sin((1 - t) * omega) / F.sin(omega)).otherwise(1 - t)
    wb = F.when(omega > 1e-12, F.sin(t * omega) / F.sin(omega)).otherwise(t)
    x, y, z = wa * ax + wb * bx, wa * ay + wb * by, wa * az + wb * bz
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def arc_km(lat: str, lon: str) -> Column:
    """Exact distance from a point to the minor arc (x1, y1) -> (x2, y2)."""
    from tesserine.functions.columns import EARTH_RADIUS_KM

    px, py, pz = unit_xyz(lat, lon)
    ax, ay, az = unit_xyz("y1", "x1")
    bx, by, bz = unit_xyz("y2", "x2")
    nx, ny, nz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    norm = F.sqrt(nx * nx + ny * ny + nz * nz)
    s = (px * nx + py * ny + pz * nz) / F.nullif(norm, F.lit(0.0))
    # The foot of the perpendicular lies on the arc when it is ahead of both ends.
    qx, qy, qz = px - s * nx / norm, py - s * ny / norm, pz - s * nz / norm
    ahead = (ay * qz - az * qy) * nx + (az * qx - ax * qz) * ny + (ax * qy - ay * qx) * nz
    behind = (qy * bz - qz * by) * nx + (qz * bx - qx * bz) * ny + (qx * by - qy * bx) * nz
    ends = F.least(haversine_km(lat, lon, "y1", "x1"), haversine_km(lat, lon, "y2", "x2"))
    plane = EARTH_RADIUS_KM * F.asin(F.least(F.abs(s), F.lit(1.0)))
    return F.when((norm > 0) & (ahead >= 0) & (behind >= 0), plane).otherwise(ends)


def nearest_arc(points: DataFrame, key: str, arcs: DataFrame, spacing_km: float = 250.0, k: int = 6) -> DataFrame:
    """Distance from each point to the nearest arc.

    Vertices at most `spacing_km` apart bound the answer: the nearest arc owns a
    vertex within the nearest vertex distance plus half the spacing. A point whose
    k-th vertex is not beyond that bound asks again for four times as many.
    """
    length = haversine_km("y1", "x1", "y2", "x2")
    named = cut_lineage(arcs.distinct().withColumn("arc", F.xxhash64("x1", "y1", "x2", "y2")))
    parts = F.greatest(F.ceil(length / spacing_km), F.lit(1)).cast("int")
    steps = named.withColumn("_m", parts).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_m"))))
    vlat, vlon = _slerp(F.col("_s") / F.col("_m"))
    vertices = cut_lineage(steps.select("arc", F.round(vlat, 9).alias("lat"), F.round(vlon, 9).alias("lon"), F.xxhash64("arc", "_s").alias("vertex")))
    total = vertices.count()
    todo, done = cut_lineage(points.select("lat", "lon").distinct().withColumn("_q", F.xxhash64("lat", "lon"))), []
    while True:
        near = cut_lineage(nearest(todo, vertices, k, "_q", "vertex", None))
        span = near.groupBy("_q").agg(F.min("km").alias("_first"), F.max("km").alias("_last"))
        hit = near.join(vertices.select("vertex", "arc"), "vertex").join(named, "arc").join(todo, "_q")
        best = hit.groupBy("_q").agg(F.min(arc_km("lat", "lon")).alias("km")).join(span, "_q")
        settled = cut_lineage(best.where((F.col("_last") > F.col("_first") + spacing_km / 2) | F.lit(k >= total)).select("_q", "km"))
        done.append(settled.join(todo, "_q").select("lat", "lon", "km"))
        todo = cut_lineage(todo.join(settled, "_q", "left_anti"))
        if k >= total or todo.isEmpty():
            break
        k = min(4 * k, total)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return points.join(found, ["lat", "lon"]).select(key, "km")
