"""Polygon repair, nesting and the quadtree walk against ring clipping and even-odd counts by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions.columns import EARTH_RADIUS_KM
from tesserine.operators import polygons as G
from tesserine.plans import polygon_plans as P


def vertices(spark, rings, by=0):
    rows = [(by, k, i, float(x), float(y)) for k, ring in rings.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "sheet long, ring long, seq long, lon double, lat double")


def star(rng, x, y, reach, n):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    return [(x + reach * r * math.cos(a), y + reach * r * math.sin(a)) for a, r in zip(angles, rng.uniform(0.3, 1.0, n), strict=True)]


def clip_half(ring, side, at, keep_above):
    """Sutherland-Hodgman against one axis-parallel line."""
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        ia, ib = (a[side] >= at) == keep_above, (b[side] >= at) == keep_above
        if ia != ib:
            t = (at - a[side]) / (b[side] - a[side])
            cut = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            out += [cut] if ia else [cut, b]
        elif ib:
            out.append(b)
    return out


def box_area(ring, x0, y0, x1, y1):
    for side, at, above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        ring = clip_half(ring, side, at, above) if ring else ring
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if ring else 0.0


def test_walk_equals_ring_clipping_in_every_cell(spark):
    rng = np.random.default_rng(1)
    rings = {1: star(rng, 2.0, 1.0, 6.5, 40), 2: star(rng, 2.0, 1.0, 1.5, 15)}  # a lake inside the land
    shape = G.ring_edges(vertices(spark, rings), ["sheet"])
    edges, broken = G.repair_rings(shape, ["sheet"])
    assert broken.count() == 0
    levels = {r.ring: r.level for r in G.nesting_levels(edges, ["sheet"]).collect()}
    assert levels == {1: 1, 2: 2}
    land = G.land_edges(edges.join(G.nesting_levels(edges, ["sheet"]), ["sheet", "ring"]))
    blocks = G.quadtree_walk(land, ["sheet"], 0.75, 21, 23, -7.5, -6.75).cache()
    got = {(r.r, r.c): r.frac for r in G.block_cells(blocks).collect()}
    assert blocks.where("kind = 'full' and (r1 - r0) * (c1 - c0) > 1").count() > 0
    for r in range(21):
        for c in range(23):
            box = (-7.5 + 0.75 * c, -6.75 + 0.75 * r, -7.5 + 0.75 * (c + 1), -6.75 + 0.75 * (r + 1))
            want = (abs(box_area(rings[1], *box)) - abs(box_area(rings[2], *box))) / 0.75 ** 2
            assert abs(got.get((r, c), 0.0) - want) < 1e-9, (r, c)


def test_sphere_area_of_the_walk_equals_a_fine_grid(spark):
    ring = [(-3.0, 40.0), (4.0, 42.5), (5.0, 51.0), (-2.0, 47.0)]
    edges, _ = G.repair_rings(G.ring_edges(vertices(spark, {1: ring}), ["sheet"]), ["sheet"])
    total = G.quadtree_walk(edges, ["sheet"], 1.0, 16, 16, -8.0, 38.0).agg(F.sum("km2")).first()[0]
    assert abs(total - G.enclosed_area(edges, ["sheet"]).first().km2) < 1e-3
    lat = np.linspace(40, 51, 110_001)
    middle = (lat[1:] + lat[:-1]) / 2
    width = np.zeros_like(middle)
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
        inside = (middle >= min(ya, yb)) & (middle < max(ya, yb))
        width[inside] += np.sign(yb - ya) * (xa + (middle[inside] - ya) / (yb - ya) * (xb - xa))
    want = EARTH_RADIUS_KM ** 2 * np.sum(np.radians(width) * np.cos(np.radians(middle)) * np.radians(np.diff(lat)))
    assert abs(total / want - 1) < 1e-7


def even_odd_area(ring, n=600):
    xs, ys = np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
    gx = np.linspace(xs.min(), xs.max(), n + 1)[:-1] + (xs.max() - xs.min()) / n / 2
    gy = np.linspace(ys.min(), ys.max(), n + 1)[:-1] + (ys.max() - ys.min()) / n / 2
    px, py = np.meshgrid(gx, gy)
    hits = np.zeros(px.shape, int)
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ya != yb:
            hits += (((ya <= py) & (py < yb)) | ((yb <= py) & (py < ya))) & (xa + (py - ya) / (yb - ya) * (xb - xa) > px)
    return (hits % 2).mean() * (xs.max() - xs.min()) * (ys.max() - ys.min())


@pytest.mark.parametrize(("ring", "area", "reason"), [
    (((0, 0), (2, 2), (2, 0), (0, 2)), 2.0, "edges meet"),
    (((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1)), 15.0, "edges retraced"),
    (((0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2)), 2.0, "vertex visited twice"),
    (((0, 0), (4, 0), (4, 2), (2, 0), (0, 2)), 4.0, "edges meet"),  # a vertex on another edge
    (((0, 0), (3, 0), (3, 1), (1, 1), (1, 0), (2, 0), (2, 3), (0, 3)), 6.0, "edges meet"),  # edges of one line overlap
    (((0, 0), (0, 3), (3, 3), (3, 0)), 9.0, None)])
def test_broken_rings_become_even_odd_boundaries(spark, ring, area, reason):
    edges, broken = G.repair_rings(G.ring_edges(vertices(spark, {7: ring}), ["sheet"]), ["sheet"])
    assert [r.reason for r in broken.collect()] == ([reason] if reason else [])
    assert abs(G.enclosed_area(edges, ["sheet"]).first().deg2 - area) < 1e-9
    assert abs(even_odd_area([(float(x), float(y)) for x, y in ring]) - area) < 0.05


def test_a_wild_ring_keeps_its_even_odd_area(spark):
    rng = np.random.default_rng(5)
    ring = [(float(x), float(y)) for x, y in rng.uniform(0, 10, (30, 2))]
    edges, broken = G.repair_rings(G.ring_edges(vertices(spark, {1: ring}), ["sheet"]), ["sheet"])
    assert broken.count() == 1
    area = G.enclosed_area(edges, ["sheet"]).first().deg2
    assert abs(area / even_odd_area(ring, 2000) - 1) < 2e-3
    blocks = G.quadtree_walk(edges, ["sheet"], 0.5, 20, 20, 0.0, 0.0)
    got = blocks.agg(F.sum("deg2").alias("a"), F.min("frac").alias("lo"), F.max("frac").alias("hi")).first()
    assert abs(got.a - area) < 1e-9 and got.lo > -1e-9 and got.hi < 1 + 1e-9


def test_nested_levels_and_separate_maps(spark):
    boxes = {k: [(k, k), (20 - k, k), (20 - k, 20 - k), (k, 20 - k)] for k in range(1, 5)}
    both = vertices(spark, boxes).unionByName(vertices(spark, {9: boxes[2]}, by=1))
    edges, _ = G.repair_rings(G.ring_edges(both, ["sheet"]), ["sheet"])
    levels = G.nesting_levels(edges, ["sheet"])
    assert {(r.sheet, r.ring): r.level for r in levels.collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): 4, (1, 9): 1}
    land = G.land_edges(edges.join(levels, ["sheet", "ring"]))
    assert {r.sheet: round(r.deg2, 6) for r in G.enclosed_area(land, ["sheet"]).collect()} == {0: 18.0 ** 2 - 16 ** 2 + 14 ** 2 - 12 ** 2, 1: 256.0}


def test_targets_restrict_the_walk(spark):
    edges, _ = G.repair_rings(G.ring_edges(vertices(spark, {1: [(0.5, 0.5), (7.5, 0.5), (7.5, 7.5), (0.5, 7.5)]}), ["sheet"]), ["sheet"])
    everything = {(r.r, r.c): r.frac for r in G.block_cells(G.quadtree_walk(edges, ["sheet"], 1.0, 8, 8, 0.0, 0.0)).collect()}
    assert len(everything) == 64 and everything[0, 0] == 0.25 and everything[3, 3] == 1.0 and everything[0, 3] == 0.5
    some = spark.createDataFrame([(0, 0, 0), (0, 5, 7)], "sheet long, r long, c long")
    got = {(r.r, r.c): r.frac for r in G.block_cells(G.quadtree_walk(edges, ["sheet"], 1.0, 8, 8, 0.0, 0.0, targets=some)).collect()}
    assert got[0, 0] == 0.25 and got[5, 7] == 0.5 and (0, 6) not in got and all(everything[k] == v for k, v in got.items())
    assert G.quadtree_walk(edges.limit(0), ["sheet"], 1.0, 8, 8, 0.0, 0.0).count() == 0


def _wild(spark):
    rng = np.random.default_rng(11)
    rings = {1: star(rng, 2.0, 1.0, 6.5, 40), 2: star(rng, 2.0, 1.0, 1.5, 15), 3: [(-7.0, -6.0), (-6.0, -6.0), (-6.0, 7.0), (-7.0, 7.0)]}
    edges, _ = G.repair_rings(G.ring_edges(vertices(spark, rings), ["sheet"]), ["sheet"])
    return G.land_edges(edges.join(G.nesting_levels(edges, ["sheet"]), ["sheet", "ring"])).unionByName(
        G.land_edges(edges.join(G.nesting_levels(edges, ["sheet"]), ["sheet", "ring"])).withColumn("sheet", F.lit(5).cast("long")))


def test_blocks_walked_by_one_task_equal_those_halved_in_rounds(spark, monkeypatch):
    land = _wild(spark).cache()
    kinds = {}
    for pieces in (0, 300, 1 << 22):  # rounds only, both, tasks only
        monkeypatch.setattr(G, "TASK_PIECES", pieces)
        found = G.quadtree_walk(land, ["sheet"], 0.75, 21, 23, -7.5, -6.75).collect()
        kinds[pieces] = {(r.sheet, r.kind, r.r0, r.r1, r.c0, r.c1): (r.frac, r.deg2, r.km2) for r in found}
        assert len(kinds[pieces]) == len(found)
    for pieces in (300, 1 << 22):
        assert kinds[pieces].keys() == kinds[0].keys()
        for k, v in kinds[0].items():
            assert kinds[pieces][k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_one_task_cuts_no_more_than_a_bounded_number_of_pieces(spark, monkeypatch):
    """A block too large for a task is halved in rounds first."""
    monkeypatch.setattr(G, "TASK_PIECES", 300)
    seen = []
    plain = G._finisher
    monkeypatch.setattr(G, "_finisher", lambda *a: seen.append(a) or plain(*a))
    assert G.quadtree_walk(_wild(spark), ["sheet"], 0.75, 21, 23, -7.5, -6.75).count() > 0
    assert len(seen) > 1


def test_levels_come_from_rings_whose_box_holds_the_point(spark):
    rng = np.random.default_rng(3)
    rings = {k: star(rng, *rng.uniform(-20, 20, 2), reach, 45 if k % 2 else 8) for k, reach in enumerate([25, 9, 4, 2, 1, 0.5, 0.2, 0.05] * 3, 1)}
    edges, _ = G.repair_rings(G.ring_edges(vertices(spark, rings), ["sheet"]), ["sheet"])
    got = {r.ring: r.level for r in G.nesting_levels(edges, ["sheet"]).collect()}
    rows = edges.toPandas()
    for ring, own in rows.groupby("ring"):
        low = own.loc[[min(own.index, key=lambda i: tuple(own.loc[i, ["y1", "x1", "y2", "x2"]]))]].iloc[0]
        px, py = (low.x1 + low.x2) / 2, (low.y1 + low.y2) / 2
        other = rows[(rows.ring != ring) & (rows.y1 != rows.y2)]
        hit = other[(other[["y1", "y2"]].min(axis=1) <= py) & (py < other[["y1", "y2"]].max(axis=1))
                    & (other.x1 + (py - other.y1) / (other.y2 - other.y1) * (other.x2 - other.x1) > px)]
        assert got[ring] == 1 + (hit.groupby("ring").size() % 2).sum(), ring


def _cuts_by_hand(ring):
    """(seq, along) of every cut, and pairs of edges with the same ends, from all pairs of edges."""
    edges = [(*map(float, a), *map(float, b)) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    cuts, cancel = set(), set()
    for i, j in ((i, j) for j in range(len(edges)) for i in range(j) if edges[i][:2] != edges[i][2:] and edges[j][:2] != edges[j][2:]):
        (ax, ay, bx, by), (cx, cy, dx, dy) = edges[i], edges[j]
        turn, line = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx), (cx - ax) * (by - ay) - (cy - ay) * (bx - ax)
        if turn:
            t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn, line / turn
            found = [(i, t), (j, u)] if 0 <= t <= 1 and 0 <= u <= 1 else []
        elif line == 0:
            on = lambda x, y, e: ((x - e[0]) * (e[2] - e[0]) + (y - e[1]) * (e[3] - e[1])) / ((e[2] - e[0]) ** 2 + (e[3] - e[1]) ** 2)
            found = [(i, on(cx, cy, edges[i])), (i, on(dx, dy, edges[i])), (j, on(ax, ay, edges[j])), (j, on(bx, by, edges[j]))]
            cancel |= {i} if {(ax, ay), (bx, by)} == {(cx, cy), (dx, dy)} else set()
        else:
            found = []
        cuts |= {(k, round(at, 9)) for k, at in found if 0 < at < 1}
    return cuts, cancel


def test_pairs_of_edges_are_made_once_in_squares_or_short_rings(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rings = {1: [tuple(p) for p in rng.uniform(-4, 4, (24, 2))], 2: [(0, 0), (3, 0), (3, 1), (1, 1), (1, 0), (2, 0), (2, 3), (0, 3)],
             3: [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], 4: [(0, 0), (0, 3), (3, 3), (3, 0)]}
    edges = G.ring_edges(vertices(spark, rings), ["sheet"])
    edges = spark.createDataFrame(edges.collect(), edges.schema)
    for short in (0, 9, 32):  # squares only, both, short rings only
        monkeypatch.setattr(G, "SHORT_RING", short)
        cuts = G._crossings(edges, ["sheet", "ring"], 0.7)
        plan = cuts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 3  # both sides learn the size of their ring, then meet once
        rows = cuts.collect()
        assert len(set(rows)) == len(rows)
        for k, ring in rings.items():
            own = [r for r in rows if r.ring == k]
            assert ({(r.seq, round(r.along, 9)) for r in own if r.px is not None}, {r.seq for r in own if r.px is None}) == _cuts_by_hand(ring)


def test_rounds_of_the_archipelago_do_not_follow_the_depth_of_the_grid(spark, monkeypatch):
    """Halving 144 x 288 cells in rounds of their own writes two tables for each of nine rounds."""
    written = []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(1) or plain(df))
    land = G.land_edges(P.levelled(spark, "/root/testdata/sf0.001")[0])
    before = len(written)
    assert G.quadtree_walk(land, ["sheet"], P.STEP, P.ROWS, P.COLS).count() > 0
    assert len(written) - before == 2
