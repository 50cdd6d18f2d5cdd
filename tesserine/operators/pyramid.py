"""Pairs of coordinates by distance ring from a pyramid of cubes: pairs of cubes that lie in one ring as a whole are added as a whole.

Level l holds the cubes of one curve-code prefix with the sums of their coordinates and the box these fill. Pairs of cubes start at the top
and are split only while their boxes leave more than one ring possible, so what is compared one by one lies near the edge of a ring.
Rounds are equi-joins on parent cubes; two dense spots meet as two cubes. Ring sums compare what is left in Arrow batches, so they stop
splitting at larger cubes than counts, which join coordinates row by row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.columns import EARTH_RADIUS_KM, haversine_km, unit_xyz
from tesserine.operators.neighbours import _km as _pair_km
from tesserine.operators.neighbours import curve_code
from tesserine.session import cut_lineage

#: Levels of the pyramid, and coordinate pairs up to which a pair of cubes is compared one by one.
LEVELS, DIRECT_PAIRS = 20, 256
#: The same for pairs of cubes that a task compares in one batch.
BATCH_PAIRS = 1 << 20
#: Kilometres by which a whole pair of cubes must stay clear of a ring's edge.
MARGIN = 1e-6
_LOW, _HIGH = ["lox", "loy", "loz"], ["hix", "hiy", "hiz"]


def cube(code: Column | str, level: Column | str) -> Column:
    """The cube of a level that holds a curve code."""
    code, level = (F.col(c) if isinstance(c, str) else c for c in (code, level))
    return F.call_function("shiftright", code, (F.lit(LEVELS) - level.cast("int")) * 3)


def pyramid(coords: DataFrame, sums: list[str]) -> DataFrame:
    """(level, cube, m, sums, box) of coordinates (lat, lon, _code, sums); m counts coordinates."""
    x, y, z = unit_xyz("lat", "lon")
    each = coords.select("_code", *sums, x.alias("x"), y.alias("y"), z.alias("z"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    return each.withColumn("cube", cube("_code", "level")).groupBy("level", "cube").agg(
        F.count("*").alias("m"), *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(f"lo{c}") for c in "xyz"], *[F.max(c).alias(f"hi{c}") for c in "xyz"])


def _km(chord: Column) -> Column:
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.least(chord / 2.0, F.lit(1.0)))


def ring_of(km: Column, edges_km: list[float]) -> Column:
    ring = F.lit(None).cast("bigint")
    for at in range(len(edges_km) - 2, -1, -1):
        ring = F.when((km >= edges_km[at]) & (km < edges_km[at + 1]), F.lit(at).cast("bigint")).otherwise(ring)
    return ring


def cube_pairs(levels: DataFrame, sums: list[str], edges_km: list[float], half: bool, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs of cubes inside one ring with their sums, pairs of cubes to compare one by one: those of up to `limit` coordinate pairs).

    `half` keeps one of (a, b) and (b, a). Pairs wholly nearer than the first edge or farther than the last are left out.
    """
    held = ["m", *sums, *_LOW, *_HIGH]
    frontier = levels.where("level = 0").select(F.lit(0).alias("level"), F.col("cube").alias("a"), F.col("cube").alias("b"))
    whole, direct = [], []
    side = lambda name: levels.select("level", F.col("cube").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in held])
    for level in range(LEVELS + 1):
        pairs = frontier.join(side("a"), ["level", "a"]).join(side("b"), ["level", "b"])
        gaps = [F.greatest(F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.lit(0.0)) for c in "xyz"]
        spans = [F.greatest(F.abs(F.col(f"a_hi{c}") - F.col(f"b_lo{c}")), F.abs(F.col(f"b_hi{c}") - F.col(f"a_lo{c}"))) for c in "xyz"]
        least, most = (_km(F.sqrt(reduce(lambda p, q: p + q, [v * v for v in side_]))) for side_ in (gaps, spans))
        pairs = pairs.withColumns({"_least": least - MARGIN, "_most": most + MARGIN})
        low = F.greatest(F.col("_least"), F.lit(0.0)) if edges_km[0] == 0 else F.col("_least")
        ring = F.when(ring_of(low, edges_km) == ring_of(F.col("_most"), edges_km), ring_of(low, edges_km))
        pairs = pairs.where((F.col("_least") < edges_km[-1]) & (F.col("_most") >= edges_km[0])).withColumn("ring", ring)
        pairs = cut_lineage(pairs.select("level", "a", "b", "a_m", "b_m", *[f"{s}_{c}" for s in "ab" for c in sums], "ring"))
        whole.append(pairs.where("ring is not null"))
        few = (F.col("a_m") * F.col("b_m") <= (DIRECT_PAIRS if limit is None else limit)) | F.lit(level == LEVELS)
        direct.append(pairs.where(F.col("ring").isNull() & few).select("level", "a", "b"))
        rest = pairs.where(F.col("ring").isNull() & ~few)
        if rest.isEmpty():
            break
        below = levels.where(F.col("level") == level + 1).select(F.col("cube").alias("_c"), F.call_function("shiftright", F.col("cube"), F.lit(3)).alias("_p"))
        split = rest.select("a", "b").join(below.select(F.col("_p").alias("a"), F.col("_c").alias("ca")), "a").join(below.select(F.col("_p").alias("b"), F.col("_c").alias("cb")), "b")
        if half:
            split = split.where("a <> b or ca <= cb")
        frontier = split.select(F.lit(level + 1).alias("level"), F.col("ca").alias("a"), F.col("cb").alias("b"))
    return reduce(DataFrame.unionByName, whole), reduce(DataFrame.unionByName, direct)


def compared(coords: DataFrame, direct: DataFrame, sums: list[str], half: bool) -> DataFrame:
    """Coordinate pairs of the cubes to compare: lat, lon, blat, blon, km, the sums of both (those of the second prefixed with b) and `same`."""
    used = [r["level"] for r in direct.select("level").distinct().collect()]  # at most one value per level
    at = coords.withColumn("level", F.explode(F.array(*[F.lit(v) for v in used]) if used else F.array().cast("array<int>"))).withColumn("_c", cube("_code", "level"))
    left = at.select("level", F.col("_c").alias("a"), "lat", "lon", *sums)
    right = at.select("level", F.col("_c").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), *[F.col(c).alias(f"b{c}") for c in sums])
    pairs = direct.join(left, ["level", "a"]).join(right, ["level", "b"])
    if half:
        pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("lat") < F.col("blat")) | ((F.col("lat") == F.col("blat")) & (F.col("lon") <= F.col("blon"))))
    same = (F.col("lat") == F.col("blat")) & (F.col("lon") == F.col("blon"))
    return pairs.withColumns({"km": haversine_km("lat", "lon", "blat", "blon"), "same": same})


def coded(coords: DataFrame) -> DataFrame:
    return cut_lineage(coords.withColumn("_code", curve_code("lat", "lon")))


def counts_within(coords: DataFrame, radius_km: float) -> DataFrame:
    """(lat, lon, total): the `n` of all coordinates up to `radius_km` away, itself included.

    A cube wholly within the radius of another credits it once; a coordinate adds the credits of the cubes that hold it.
    """
    coords = coded(coords)
    reach = [0.0, radius_km * (1 + 1e-12) + 1e-9]
    whole, direct = cube_pairs(cut_lineage(pyramid(coords, ["n"])), ["n"], reach, half=False)
    credits = cut_lineage(whole.groupBy("level", F.col("a").alias("_c")).agg(F.sum("b_n").alias("total")))
    used = [r["level"] for r in credits.select("level").distinct().collect()]  # at most one value per level
    inside = coords.select("lat", "lon", "_code", F.explode(F.array(*[F.lit(v) for v in used]) if used else F.array().cast("array<int>")).alias("level"))
    held = inside.withColumn("_c", cube("_code", "level")).join(credits, ["level", "_c"]).select("lat", "lon", "total")
    near = compared(coords, direct, ["n"], half=False).where(F.col("km") <= radius_km).select("lat", "lon", F.col("bn").alias("total"))
    return held.unionByName(near).groupBy("lat", "lon").agg(F.sum("total").alias("total"))


def _ring_batch(edges_km: list[float]):
    """Sums by ring and pair of folds of all pairs of two cubes, or of one cube with itself."""
    edges = np.array(edges_km, float)
    last = len(edges) - 1

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lat, lon, f, n, s, q = (left.column(c).to_numpy() for c in ("lat", "lon", "fold", "n", "s", "q"))
        blat, blon, bf, bn, bs, bq = (right.column(c).to_numpy() for c in ("blat", "blon", "bfold", "bn", "bs", "bq"))
        own = key[1].as_py() == key[2].as_py()
        if own:  # both sides hold the same rows, maybe in another order
            order = np.lexsort((f, lon, lat))
            lat, lon, f, n, s, q = (v[order] for v in (lat, lon, f, n, s, q))
            blat, blon, bf, bn, bs, bq = lat, lon, f, n, s, q
        folds = np.unique(np.concatenate([f, bf]))
        k, fi, bfi = len(folds), np.searchsorted(folds, f), np.searchsorted(folds, bf)
        total = np.zeros((3, last * k * k))
        counts = np.zeros(last * k * k, np.int64)
        step = max(1, BATCH_PAIRS // max(len(blat), 1))
        for at in range(0, len(lat), step):
            to = slice(at, at + step)
            ring = np.searchsorted(edges, _pair_km(lat[to], lon[to], blat, blon), side="right") - 1
            wanted = (ring >= 0) & (ring < last)
            if own:
                wanted &= np.arange(at, at + len(ring))[:, None] <= np.arange(len(blat))
            i, j = np.nonzero(wanted)
            slot = (ring[i, j] * k + fi[i + at]) * k + bfi[j]
            i = i + at
            same = own & (i == j)
            both = np.where(same, s[i] * s[i] - q[i], 2.0 * s[i] * bs[j])
            apart = np.where(same, 2.0 * (n[i] * q[i] - s[i] * s[i]), 2.0 * (bn[j] * q[i] + n[i] * bq[j] - 2.0 * s[i] * bs[j]))
            np.add.at(counts, slot, np.where(same, n[i] * (n[i] - 1), 2 * n[i] * bn[j]))
            for to_add, v in enumerate((both, apart)):
                total[to_add] += np.bincount(slot, v, minlength=last * k * k)
        used = np.flatnonzero(counts)
        return pa.table({"ring": (used // (k * k)).astype(np.int64), "fold": folds[used // k % k].astype(np.int64), "bfold": folds[used % k].astype(np.int64),
                         "c": counts[used], "x": total[0, used], "d": total[1, used]})

    return compare


def ring_sums(coords: DataFrame, edges_km: list[float]) -> DataFrame:
    """(ring, c, x, d) of coordinates with n records, the sum s and the sum of squares q of their values.

    c counts ordered pairs of records, x adds the products and d the squared differences of their values.
    """
    rows = fold_ring_sums(coords.withColumn("fold", F.lit(0).cast("long")), edges_km)
    return rows.groupBy("ring").agg(F.sum("c").alias("c"), F.sum("x").alias("x"), F.sum("d").alias("d")).where("c > 0")


def fold_ring_sums(coords: DataFrame, edges_km: list[float]) -> DataFrame:
    """(ring, fold, bfold, c, x, d): `ring_sums` by the folds of the two records; coordinates have one row per fold.

    Both orders of a pair are counted, in one of the rows (fold, bfold) and (bfold, fold) or in both, so sum over both.
    """
    sums = ["n", "s", "q"]
    coords = coded(coords.select("lat", "lon", "fold", *sums))
    whole, direct = cube_pairs(cut_lineage(pyramid(coords, ["n"])), ["n"], edges_km, half=True, limit=BATCH_PAIRS)
    held = coords.select("_code", "fold", *sums, F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("_c", cube("_code", "level"))
    held = held.join(whole.select("level").distinct(), "level", "left_semi").groupBy("level", "_c", "fold").agg(*[F.sum(c).alias(c) for c in sums])
    side = lambda a, b: held.select("level", F.col("_c").alias(a), *[F.col(c).alias(f"{b}{c}") for c in ("fold", *sums)])
    met = whole.select("level", "a", "b", "ring").join(side("a", ""), ["level", "a"]).join(side("b", "b"), ["level", "b"])
    n, s, q, bn, bs, bq = (F.col(c) for c in ("n", "s", "q", "bn", "bs", "bq"))
    own = (F.col("a") == F.col("b")) & (F.col("fold") == F.col("bfold"))
    # one cube with itself meets in both orders of its folds
    twice = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    inside = met.select("ring", "fold", "bfold", F.when(own, n * (n - 1)).otherwise(twice * n * bn).alias("c"), F.when(own, s * s - q).otherwise(twice * s * bs).alias("x"),
                        F.when(own, 2.0 * (n * q - s * s)).otherwise(twice * (bn * q + n * bq - 2.0 * s * bs)).alias("d"))
    used = [r["level"] for r in direct.select("level").distinct().collect()]  # at most one value per level
    at = coords.withColumn("level", F.explode(F.array(*[F.lit(v) for v in used]) if used else F.array().cast("array<int>"))).withColumn("_c", cube("_code", "level"))
    rows = at.select("level", "_c", "lat", "lon", "fold", "n", F.col("s").cast("double").alias("s"), F.col("q").cast("double").alias("q"))
    left, right = (direct.join(rows.withColumnRenamed("_c", c), ["level", c]) for c in "ab")
    right = right.select(*[F.col(c).alias(f"b{c}") for c in right.columns])  # names of its own: both sides come from one table
    near = left.groupBy("level", "a", "b").cogroup(right.groupBy("blevel", "ba", "bb")).applyInArrow(_ring_batch(edges_km), "ring long, fold long, bfold long, c long, x double, d double")
    return inside.unionByName(near).groupBy("ring", "fold", "bfold").agg(F.sum("c").alias("c"), F.sum("x").alias("x"), F.sum("d").alias("d"))
