"""Shoreline levels with repair, and the quadtree walk with clipping, over one small archipelago per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions.columns import EARTH_RADIUS_KM
from tesserine.operators import polygons as G
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.session import cut_lineage

#: Ten-degree tiles of a sheet that hold an archipelago; suppliers fill one sheet after another.
TILES_WIDE, TILES_HIGH, TILE = 36, 18, 10
#: Vertices around the middle of a tile: a ring that crosses itself, one that retraces an edge on its way to a hole, and a sound one that runs clockwise.
SHORES = {
    0: ((-4.0, -3.0), (4.0, 3.0), (4.0, -3.0), (-4.0, 3.0)),
    1: ((-4.0, -3.0), (4.0, -3.0), (4.0, 3.0), (-4.0, 3.0), (-4.0, -3.0), (-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)),
    2: ((-4.0, -3.0), (-4.0, 3.0), (4.0, 3.0), (4.0, -3.0)),
}
LAKE, ISLAND = (2.5, -0.5, 3.5, 0.5), (2.8, -0.2, 3.2, 0.2)
#: Grid of the walk: cells of 1.25 degrees, eight to a tile.
STEP, ROWS, COLS = 1.25, 144, 288


def _box(x0, y0, x1, y1):
    return (x0, y0), (x1, y0), (x1, y1), (x0, y1)


def shore_rings(spark, sf):
    """(sheet, ring, seq, lon, lat): three rings for every supplier; ring is three times the supplier key plus its kind."""
    place = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"))
    tile = F.col("site") % (TILES_WIDE * TILES_HIGH)
    place = place.select("site", F.floor(F.col("site") / (TILES_WIDE * TILES_HIGH)).alias("sheet"),
                         (tile % TILES_WIDE * TILE - 175).cast("double").alias("x"), (F.floor(tile / TILES_WIDE) * TILE - 85).cast("double").alias("y"))
    points = lambda ring: F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ring])
    shore = F.when(F.col("site") % 3 == 0, points(SHORES[0])).when(F.col("site") % 3 == 1, points(SHORES[1])).otherwise(points(SHORES[2]))
    kinds = F.posexplode(F.array(shore, points(_box(*LAKE)), points(_box(*ISLAND)))).alias("kind", "p")
    each = place.select("sheet", "site", "x", "y", kinds).select("sheet", (F.col("site") * 3 + F.col("kind")).alias("ring"), "x", "y", F.posexplode("p").alias("seq", "v"))
    return each.select("sheet", "ring", F.col("seq").cast("bigint").alias("seq"), (F.col("x") + F.col("v.dx")).alias("lon"), (F.col("y") + F.col("v.dy")).alias("lat"))


def levelled(spark, sf):
    """Repaired edges with their level, and the rings that were repaired."""
    edges, broken = G.repair_rings(G.ring_edges(shore_rings(spark, sf), ["sheet"]), ["sheet"])
    return cut_lineage(edges.join(G.nesting_levels(edges, ["sheet"]), ["sheet", "ring"])), broken


PLACES = f"""place AS (SELECT s_suppkey AS site, s_suppkey // {TILES_WIDE * TILES_HIGH} AS sheet, s_suppkey % {TILES_WIDE * TILES_HIGH} AS tile,
  CAST(s_suppkey % {TILES_WIDE * TILES_HIGH} % {TILES_WIDE} * {TILE} - 175 AS DOUBLE) AS x, CAST(s_suppkey % {TILES_WIDE * TILES_HIGH} // {TILES_WIDE} * {TILE} - 85 AS DOUBLE) AS y FROM supplier)"""
_R2 = EARTH_RADIUS_KM ** 2


def _box_sql(x0, y0, x1, y1):
    return f"{_R2}*radians({x1 - x0})*(sin(radians(y + {y1})) - sin(radians(y + {y0})))"


#: The crossing ring is two triangles whose width falls evenly from eight degrees at its middle to none three degrees north and south.
SHORE_KM2 = f"""CASE site % 3 WHEN 0 THEN {_R2}*4*radians(4.0)*cos(radians(y))*(1 - cos(radians(3.0)))/radians(3.0)
  WHEN 1 THEN {_box_sql(-4, -3, 4, 3)} - {_box_sql(-1, -1, 1, 1)} ELSE {_box_sql(-4, -3, 4, 3)} END"""


@query("S25_shoreline_levels", f"""WITH {PLACES}, r AS (
 SELECT site*3 AS ring, sheet, 1 AS level, CASE site % 3 WHEN 0 THEN 24.0 WHEN 1 THEN 44.0 ELSE 48.0 END AS deg2, {SHORE_KM2} AS km2,
   CASE site % 3 WHEN 0 THEN 'edges meet' WHEN 1 THEN 'edges retraced' END AS repaired FROM place
 UNION ALL SELECT site*3 + 1, sheet, 2, 1.0, {_box_sql(*LAKE)}, NULL FROM place
 UNION ALL SELECT site*3 + 2, sheet, 3, 0.16, {_box_sql(*ISLAND)}, NULL FROM place)
 SELECT CAST(sheet AS BIGINT) AS sheet, CAST(ring AS BIGINT) AS ring, CAST(level AS BIGINT) AS level, round(deg2, 6) AS deg2, round(km2, 3) AS km2, repaired FROM r""")
def shoreline_levels(spark, sf):
    edges, broken = levelled(spark, sf)
    area = G.enclosed_area(edges, ["sheet", "ring", "level"])
    return area.join(broken, ["sheet", "ring"], "left").select("sheet", "ring", "level", F.round("deg2", 6).alias("deg2"), F.round("km2", 3).alias("km2"), F.col("reason").alias("repaired"))


def walk(spark, sf):
    edges, _ = levelled(spark, sf)
    return G.quadtree_walk(G.land_edges(edges), ["sheet"], STEP, ROWS, COLS)


#: The same land as directed edges without any repair: triangles, an outer and a reversed inner box, lakes reversed.
_TRIANGLES = ((-4, 3, -4, -3), (-4, -3, 0, 0), (0, 0, -4, 3), (4, -3, 4, 3), (4, 3, 0, 0), (0, 0, 4, -3))


def _sides(x0, y0, x1, y1, turn=1):
    return ((x1, y0, x1, y1), (x0, y1, x0, y0)) if turn > 0 else ((x1, y1, x1, y0), (x0, y0, x0, y1))


_LAND = [*[(0, *e) for e in _TRIANGLES], *[(k, *e) for k in (1, 2) for e in _sides(-4, -3, 4, 3)], *[(1, *e) for e in _sides(-1, -1, 1, 1, -1)],
         *[(k, *e) for k in range(3) for e in (*_sides(*LAKE, -1), *_sides(*ISLAND))]]
LAND_SQL = f"""land AS (SELECT site, sheet, tile, x + a AS x1, y + b AS y1, x + c AS x2, y + d AS y2 FROM place JOIN (VALUES {', '.join(f'({k}, {a}, {b}, {c}, {d})' for k, a, b, c, d in _LAND)}) e(k, a, b, c, d) ON site % 3 = k WHERE b <> d)"""


@query("P43_quadtree_cells", f"""WITH {PLACES}, {LAND_SQL},
 cell AS (SELECT p.site, p.sheet, p.tile // {TILES_WIDE} * 8 + i AS r, p.tile % {TILES_WIDE} * 8 + j AS c FROM place p, range(8) a(i), range(8) b(j)),
 box AS (SELECT *, c*{STEP} - 180 AS w, c*{STEP} - 180 + {STEP} AS e, r*{STEP} - 90 AS s, r*{STEP} - 90 + {STEP} AS n FROM cell),
 part AS (SELECT k.sheet, k.r, k.c, w, e, greatest(least(l.y1, n), s) AS ya, greatest(least(l.y2, n), s) AS yb, l.x1 AS ex, l.y1 AS ey, (l.x2 - l.x1)/(l.y2 - l.y1) AS m FROM box k JOIN land l ON l.site = k.site),
 ends AS (SELECT *, ex + (ya - ey)*m AS xa, ex + (yb - ey)*m AS xb FROM part WHERE ya <> yb),
 h AS (SELECT sheet, r, c, sum(CASE WHEN abs(m) < 1e-12 THEN (least(greatest(xa, w), e) - w)*(yb - ya) ELSE
   ((CASE WHEN xb <= w THEN 0 WHEN xb < e THEN (xb - w)**2/2 ELSE {STEP}*(xb - (w + e)/2) END) - (CASE WHEN xa <= w THEN 0 WHEN xa < e THEN (xa - w)**2/2 ELSE {STEP}*(xa - (w + e)/2) END))/m END)/{STEP * STEP} AS frac FROM ends GROUP BY 1, 2, 3)
 SELECT CAST(sheet AS BIGINT) AS sheet, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(frac, 6) AS frac FROM h WHERE frac > 1e-9 AND frac < 1 - 1e-9""")
def quadtree_cells(spark, sf):
    cells = walk(spark, sf).where("kind = 'cell' and frac > 1e-9 and frac < 1 - 1e-9")
    return cells.select("sheet", F.col("r0").alias("r"), F.col("c0").alias("c"), F.round("frac", 6).alias("frac"))


@query("P43_archipelago_area", f"""WITH {PLACES} SELECT CAST(site AS BIGINT) AS site, round({SHORE_KM2} - {_box_sql(*LAKE)} + {_box_sql(*ISLAND)}, 3) AS km2 FROM place""")
def archipelago_area(spark, sf):
    # the sea between two archipelagos keeps full blocks inside one tile
    site = F.col("sheet") * (TILES_WIDE * TILES_HIGH) + F.floor(F.col("r0") / 8) * TILES_WIDE + F.floor(F.col("c0") / 8)
    return walk(spark, sf).groupBy(site.cast("bigint").alias("site")).agg(F.round(F.sum("km2"), 3).alias("km2"))


@query("P43_full_cells", f"""WITH {PLACES}, box AS (SELECT p.*, i, j, -5 + {STEP}*j AS a, -5 + {STEP}*i AS b FROM place p, range(8) r(i), range(8) s(j)),
 f AS (SELECT *, CASE site % 3 WHEN 0 THEN greatest(abs(b), abs(b + {STEP}))*4/3 <= least(abs(a), abs(a + {STEP})) AND a >= -4 AND a + {STEP} <= 4 AND a*(a + {STEP}) >= 0
   ELSE a >= -4 AND a + {STEP} <= 4 AND b >= -3 AND b + {STEP} <= 3 AND (site % 3 = 2 OR greatest(a, -1.0) >= least(a + {STEP}, 1.0) OR greatest(b, -1.0) >= least(b + {STEP}, 1.0)) END
   AND (greatest(a, {LAKE[0]}) >= least(a + {STEP}, {LAKE[2]}) OR greatest(b, {LAKE[1]}) >= least(b + {STEP}, {LAKE[3]})) AS whole FROM box)
 SELECT CAST(site AS BIGINT) AS site, count(*) FILTER (whole) AS n_full FROM f GROUP BY 1""")
def full_cells(spark, sf):
    cells = G.block_cells(walk(spark, sf).where("kind = 'full' or frac >= 1 - 1e-9"))
    site = F.col("sheet") * (TILES_WIDE * TILES_HIGH) + F.floor(F.col("r") / 8) * TILES_WIDE + F.floor(F.col("c") / 8)
    counted = cells.groupBy(site.alias("s")).agg(F.count("*").alias("n"))
    sites = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("site"))
    return sites.join(counted, F.col("site") == F.col("s"), "left").select("site", F.coalesce("n", F.lit(0)).alias("n_full"))
