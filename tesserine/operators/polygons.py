"""Level polygons (land, lake, island, pond) as directed edges: repair, nesting, areas and clipping by an adaptive quadtree.

A polygon is the set of its edges (x1, y1, x2, y2) in degrees, directed so that its inside lies to their left; no row ever holds a whole
ring. Edges of one latitude enclose nothing by Green's theorem and are left out. `by` names the columns that tell separate maps apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.columns import EARTH_RADIUS_KM
from tesserine.session import cut_lineage

EDGE = ["x1", "y1", "x2", "y2"]
BLOCK = ["r0", "r1", "c0", "c1"]
#: Edges up to which all edges of a ring are paired, and pieces that the rows of a block can at most be cut into for one task to walk it to its cells.
SHORT_RING, TASK_PIECES = 32, 1 << 22
#: Squares that hold boxes of rings have sides of 2 to the power of -LEVELS .. LEVELS degrees.
LEVELS = 9


def ring_edges(vertices: DataFrame, by: list[str]) -> DataFrame:
    """Edges of closed rings from vertices (by, ring, seq from 0, lon, lat); an end that repeats the start does no harm.

    The next vertex is found by an equi-join on its number, so a ring of any length is spread over all tasks.
    """
    key = [*by, "ring"]
    sizes = vertices.groupBy(*key).agg(F.count("*").alias("_n"))
    first = vertices.join(sizes, key).select(*key, "seq", F.pmod(F.col("seq") + 1, F.col("_n")).alias("_next"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    second = vertices.select(*key, F.col("seq").alias("_next"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return first.join(second, [*key, "_next"]).where("x1 <> x2 or y1 <> y2").select(*key, "seq", *EDGE)


def _range_cells(low: Column, high: Column, size: float | Column) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _crossings(edges: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, seq, px, py, along) for every place where an edge of a ring must be cut; px is null where two edges run along each other."""
    # a short ring is one square: its edges are fewer than the squares they pass
    sizes = edges.groupBy(*key).agg((F.count("*") <= SHORT_RING).alias("_short"))
    square = lambda end, a, b: F.when(F.col("_short"), F.lit(0).cast("bigint")).otherwise(F.floor(end(a, b) / size))
    cells = edges.join(sizes, key)
    for at, x in (("_i", "x"), ("_j", "y")):
        low, high = (square(end, f"{x}1", f"{x}2") for end in (F.least, F.greatest))
        cells = cells.withColumn(f"{at}0", low).withColumn(at, F.explode(F.sequence(low, high)))
    other = cells.select(*key, "_i", "_j", F.col("_i0").alias("_bi0"), F.col("_j0").alias("_bj0"), F.col("seq").alias("_q"), *[F.col(c).alias(f"b{c}") for c in EDGE])
    # two edges meet in the first square that both pass, so every pair comes once
    pairs = cells.join(other, [*key, "_i", "_j"]).where("seq < _q and _i = greatest(_i0, _bi0) and _j = greatest(_j0, _bj0)").select(
        *key, "seq", "_q", *EDGE, *[f"b{c}" for c in EDGE])
    rx, ry, sx, sy = (F.col(a) - F.col(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("bx2", "bx1"), ("by2", "by1")))
    qx, qy = F.col("bx1") - F.col("x1"), F.col("by1") - F.col("y1")
    turn, line = rx * sy - ry * sx, qx * ry - qy * rx
    at = pairs.withColumns({"_turn": turn, "_line": line}).withColumns({
        "_t": F.when(F.col("_turn") != 0, (qx * sy - qy * sx) / F.nullif(F.col("_turn"), F.lit(0.0))),
        "_u": F.when(F.col("_turn") != 0, F.col("_line") / F.nullif(F.col("_turn"), F.lit(0.0)))})

    def place(x: str) -> Column:
        """One point for both edges; ends of edges keep their coordinates."""
        return (F.when(F.col("_t") <= 0, F.col(f"{x}1")).when(F.col("_t") >= 1, F.col(f"{x}2")).when(F.col("_u") <= 0, F.col(f"b{x}1"))
                .when(F.col("_u") >= 1, F.col(f"b{x}2")).otherwise(F.col(f"{x}1") + F.col("_t") * (F.col(f"{x}2") - F.col(f"{x}1"))))

    def along(px: str, py: str, b: str) -> Column:
        x1, y1, x2, y2 = (F.col(b + c) for c in EDGE)
        return ((F.col(px) - x1) * (x2 - x1) + (F.col(py) - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))

    def cut(seq: str, px: Column, py: Column, t: Column) -> Column:
        return F.struct(F.col(seq).alias("seq"), px.alias("px"), py.alias("py"), t.alias("along"))

    meet = (F.col("_turn") != 0) & F.col("_t").between(0, 1) & F.col("_u").between(0, 1)
    same = (F.col("_turn") == 0) & (F.col("_line") == 0)
    ends = [("seq", "bx1", "by1", ""), ("seq", "bx2", "by2", ""), ("_q", "x1", "y1", "b"), ("_q", "x2", "y2", "b")]
    # two edges with the same ends have nothing to cut, but cancel
    equal = (((F.col("x1") == F.col("bx1")) & (F.col("y1") == F.col("by1")) & (F.col("x2") == F.col("bx2")) & (F.col("y2") == F.col("by2")))
             | ((F.col("x1") == F.col("bx2")) & (F.col("y1") == F.col("by2")) & (F.col("x2") == F.col("bx1")) & (F.col("y2") == F.col("by1"))))
    none = F.lit(None).cast("double")
    # all that a pair gives comes from one pass over the pairs, which are made once
    found = F.when(meet, F.array(cut("seq", place("x"), place("y"), F.col("_t")), cut("_q", place("x"), place("y"), F.col("_u")))).when(
        same, F.array(*[cut(e, F.col(x), F.col(y), along(x, y, b)) for e, x, y, b in ends], F.when(equal, cut("seq", none, none, none))))
    each = at.where(meet | same).select(*key, F.explode(found).alias("_f")).where("_f is not null and (_f.px is null or (_f.along > 0 and _f.along < 1))")
    return each.select(*key, "_f.seq", "_f.px", "_f.py", "_f.along").distinct()


def _ray_hits(points: DataFrame, edges: DataFrame, key: list[str], band: float) -> DataFrame:
    """Pairs of a point (px, py, ...) and an edge (_k, x1 .. y2) of its key that crosses the ray from the point to larger x."""
    spread = edges.where("y1 <> y2").withColumn("_b", _range_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), band))
    x_at = F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return points.withColumn("_b", F.floor(F.col("py") / band)).join(spread, [*key, "_b"]).where((low <= F.col("py")) & (F.col("py") < high) & (x_at > F.col("px")))


def repair_rings(edges: DataFrame, by: list[str], cell: float = 1.0, band: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(edges with the inside to the left, repaired rings with a reason).

    A ring that crosses, touches or retraces itself becomes the boundary of the points it winds around an odd number of times: its edges are cut
    where they meet, pieces run over twice cancel, and each piece is directed by the parity of the pieces beyond it. Cuts come from an
    equi-join on squares of side `cell`, parities from one on bands of height `band`. Sound rings only get their direction.
    """
    key = [*by, "ring"]
    edges = cut_lineage(edges.select(*key, "seq", *[F.col(c).cast("double").alias(c) for c in EDGE]))
    cuts = cut_lineage(_crossings(edges, key, cell))
    twice = edges.groupBy(*key, "x1", "y1").agg(F.count("*").alias("_n")).where("_n > 1").select(*key, F.lit(2).alias("_why"))
    found = cuts.select(*key, F.when(F.col("px").isNull(), 1).otherwise(0).alias("_why")).union(twice).groupBy(*key).agg(F.min("_why").alias("_why"))
    broken = cut_lineage(found.withColumn("reason", F.when(F.col("_why") == 0, "edges meet").when(F.col("_why") == 1, "edges retraced").otherwise("vertex visited twice")).drop("_why"))
    # cut the edges of broken rings
    bad = edges.join(broken.select(*key), key, "left_semi")
    places = cuts.where("px is not null").groupBy(*key, "seq").agg(F.collect_set(F.struct("along", F.col("px").alias("x"), F.col("py").alias("y"))).alias("_c"))
    start, end = F.array(F.struct(F.lit(0.0).alias("along"), F.col("x1").alias("x"), F.col("y1").alias("y"))), F.array(F.struct(F.lit(1.0).alias("along"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    way = F.concat(start, F.coalesce(F.array_sort("_c"), F.array().cast("array<struct<along:double,x:double,y:double>>")), end)
    pieces = bad.join(places, [*key, "seq"], "left").withColumn("_w", way).select(
        *key, F.inline(F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w") - 1), lambda a, b: F.struct(
            F.least(F.struct(a["y"], a["x"]), F.struct(b["y"], b["x"])).alias("a"), F.greatest(F.struct(a["y"], a["x"]), F.struct(b["y"], b["x"])).alias("b")))))
    odd = pieces.where("a <> b").groupBy(*key, "a", "b").agg((F.count("*") % 2).alias("_odd")).where("_odd = 1")
    up = cut_lineage(odd.select(*key, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).where("y1 < y2").withColumn("_k", F.xxhash64(*EDGE)))
    middle = up.select(*key, F.col("_k").alias("_p"), ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py"))
    beyond = _ray_hits(middle, up, key, band).where("_k <> _p").groupBy(*key, F.col("_p").alias("_k")).agg((F.count("*") % 2).alias("_odd"))
    flip = F.coalesce("_odd", F.lit(0)) == 1
    mended = _directed(up.join(beyond, [*key, "_k"], "left"), flip).select(*key, *EDGE)
    # sound rings: the sign of the enclosed area tells the direction
    good = edges.join(broken.select(*key), key, "left_anti")
    signs = good.groupBy(*key).agg((F.sum((F.col("x1") + F.col("x2")) * (F.col("y2") - F.col("y1"))) < 0).alias("_cw"))
    sound = _directed(good.join(signs, key), F.col("_cw")).where("y1 <> y2").select(*key, *EDGE)
    return cut_lineage(mended.unionByName(sound)), broken


def _directed(edges: DataFrame, flip: Column) -> DataFrame:
    turned = {a: F.when(flip, F.col(b)).otherwise(F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    return edges.select(*[turned[c].alias(c) if c in turned else F.col(c) for c in edges.columns])


def nesting_levels(edges: DataFrame, by: list[str], band: float = 1.0) -> DataFrame:
    """(by, ring, level): 1 plus the number of rings of the same map around the ring, by the parity of edges beyond one of its points."""
    low = edges.groupBy(*by, "ring").agg(F.min(F.struct("y1", "x1", "y2", "x2")).alias("_e"))
    point = low.select(*by, F.col("ring").alias("_r"), ((F.col("_e.x1") + F.col("_e.x2")) / 2).alias("px"), ((F.col("_e.y1") + F.col("_e.y2")) / 2).alias("py"))
    # only a ring whose box holds the point can lie around it; a box takes four squares at most of a size of its own
    box = edges.groupBy(*by, "ring").agg(*[f(g(f"{c}1", f"{c}2")).alias(f"_{n}{c}") for c in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    side = F.greatest(F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy"), F.lit(2.0 ** -LEVELS))
    box = cut_lineage(box.withColumn("_l", F.least(F.ceil(F.log2(side)), F.lit(LEVELS)).cast("int")))
    used = [r["_l"] for r in box.select("_l").distinct().collect()]  # at most one value per level
    size = F.pow(F.lit(2.0), F.col("_l"))
    squares = box.withColumn("_i", _range_cells(F.col("_lox"), F.col("_hix"), size)).withColumn("_j", _range_cells(F.col("_loy"), F.col("_hiy"), size))
    probes = point.withColumn("_l", F.explode(F.array(*[F.lit(v) for v in used]) if used else F.array().cast("array<int>")))
    probes = probes.withColumns({"_i": F.floor(F.col("px") / size), "_j": F.floor(F.col("py") / size)})
    near = probes.join(squares, [*by, "_l", "_i", "_j"]).where("ring <> _r and px between _lox and _hix and py between _loy and _hiy")
    hits = _ray_hits(near.select(*by, "_r", "ring", "px", "py"), edges, [*by, "ring"], band)
    around = hits.groupBy(*by, "_r", "ring").agg((F.count("*") % 2).alias("_odd")).groupBy(*by, F.col("_r").alias("ring")).agg(F.sum("_odd").alias("_d"))
    return low.drop("_e").join(around, [*by, "ring"], "left").select(*by, "ring", (F.coalesce("_d", F.lit(0)) + 1).cast("bigint").alias("level"))


def land_edges(edges: DataFrame) -> DataFrame:
    """Edges of (land - lake) + (island - pond) for nested rings with `level`: water rings turn round."""
    return _directed(edges, F.col("level") % 2 == 0)


def _green(x0: Column) -> tuple[Column, Column]:
    """What an edge adds to the area left of it and right of x0: in square degrees, and on the sphere in square kilometres."""
    flat = ((F.col("x1") + F.col("x2")) / 2 - x0) * (F.col("y2") - F.col("y1"))
    a, b, p, q = F.radians(F.col("x1") - x0), F.radians(F.col("x2") - x0), F.radians("y1"), F.radians("y2")
    slope = (b - a) / F.nullif(q - p, F.lit(0.0))
    return flat, EARTH_RADIUS_KM ** 2 * (b * F.sin(q) - a * F.sin(p) + slope * (F.cos(q) - F.cos(p)))


def enclosed_area(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, deg2, km2) of directed edges; edges are straight in longitude and latitude, areas on the sphere exact for such edges."""
    flat, sphere = _green(F.lit(0.0))
    return edges.where("y1 <> y2").groupBy(*by).agg(F.sum(flat).alias("deg2"), F.sum(sphere).alias("km2"))


# -- quadtree -----------------------------------------------------------------------


def _halves(low: str, high: str) -> Column:
    middle = F.floor((F.col(low) + F.col(high)) / 2)
    pair = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.explode(F.when(F.col(high) - F.col(low) > 1, F.array(pair(F.col(low), middle), pair(middle, F.col(high)))).otherwise(F.array(pair(F.col(low), F.col(high)))))


def _clip(block: tuple, edge: tuple, d: np.ndarray, step: float, west: float, south: float) -> tuple[np.ndarray, tuple, np.ndarray]:
    """(row, edge, d) of what is left of rows that were each given a smaller block (r0, r1, c0, c1); x1 is NaN in marks.

    What lies left of the block is dropped. What lies right of it acts as if it ran up or down the block's right side; only the heights where
    that begins (+1) and ends (-1) are kept as marks, and these cancel along a coast, so a block far from any edge has one such row or none.
    """
    r0, r1, c0, c1 = block
    x1, y1, x2, y2 = edge
    old = np.flatnonzero(np.isnan(x1))
    low, high = r0 * step + south, r1 * step + south
    level = np.maximum(y1[old], low[old])
    old, level = old[level < high[old]], level[level < high[old]]
    row = np.flatnonzero(~np.isnan(x1) & (np.maximum(y1, y2) > low) & (np.minimum(y1, y2) < high))
    low, high, left, right = low[row], high[row], c0[row] * step + west, c1[row] * step + west
    x1, y1, x2, y2 = (v[row] for v in edge)
    slope = (x2 - x1) / (y2 - y1)
    ya, yb = (np.minimum(np.maximum(y, low), high) for y in (y1, y2))
    xa, xb = (np.where(at == y, x, x1 + (at - y1) * slope) for at, y, x in ((ya, y1, x1), (yb, y2, x2)))
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = np.where(x1 == x2, np.nan, (y2 - y1) / (x2 - x1))
        between = [np.fmin(np.fmax(y1 + (x - x1) * rise, np.minimum(ya, yb)), np.maximum(ya, yb)) for x in (left, right)]
    ends = [(np.minimum(np.maximum(x, left), right), np.where(x < left, between[0], np.where(x > right, between[1], y))) for x, y in ((xa, ya), (xb, yb))]
    piece = np.flatnonzero((np.maximum(xa, xb) > left) & (np.minimum(xa, xb) < right) & (ends[0][1] != ends[1][1]))
    begins, stops = (np.where(x >= right, y, between[1]) for x, y in ((xa, ya), (xb, yb)))
    beyond = (np.maximum(xa, xb) >= right) & (begins != stops)
    up, down = (np.flatnonzero(beyond & (y < high)) for y in (begins, stops))
    marks = [(old, level, d[old]), (row[up], begins[up], np.ones(len(up))), (row[down], stops[down], -np.ones(len(down)))]
    none = np.full(sum(len(m[0]) for m in marks), np.nan)
    made = tuple(np.concatenate([v, *more]) for v, more in zip(
        (ends[0][0][piece], ends[0][1][piece], ends[1][0][piece], ends[1][1][piece]), ((none,), [m[1] for m in marks], (none,), (none,)), strict=True))
    return np.concatenate([row[piece], *[m[0] for m in marks]]), made, np.concatenate([np.full(len(piece), np.nan), *[m[2] for m in marks]])


def _columns(rows: pa.Table | pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """Columns as arrays; NULL is NaN."""
    return [np.asarray(rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy()) for c in names]


def _clipped(state: DataFrame, by: list[str], step: float, west: float, south: float) -> DataFrame:
    """The rows of `state`, each already given a smaller block, cut to that block (see `_clip`)."""
    names = [*by, *BLOCK, *EDGE, "d"]
    state = state.select(*names)

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, edge, d = _clip(tuple(_columns(batch, BLOCK)), tuple(v.astype(float) for v in _columns(batch, EDGE)), _columns(batch, ["d"])[0].astype(float), step, west, south)
            kept = [batch.column(c).take(pa.array(row)) for c in (*by, *BLOCK)]
            whole = pa.array(np.where(np.isnan(d), 0, d).astype(np.int64), mask=np.isnan(d))
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, mask=np.isnan(v)) for v in edge], whole], names=names)

    cut = state.mapInArrow(clip, state.schema)
    none = F.lit(None).cast("double")
    marks = cut.where("d is not null").groupBy(*by, *BLOCK, "y1").agg(F.sum("d").alias("d")).where("d <> 0")
    return cut.where("d is null").unionByName(marks.select(*by, *BLOCK, none.alias("x1"), "y1", none.alias("x2"), none.alias("y2"), "d"))


def _areas(block: tuple, edge: tuple, d: np.ndarray, step: float, west: float, south: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row: whether an edge shows in it, and what it adds to its block in square degrees and square kilometres (see `_green`)."""
    r0, r1, c0, c1 = block
    x1, y1, x2, y2 = edge
    mark, top, width = np.isnan(x1), r1 * step + south, (c1 - c0) * step
    x0 = c0 * step + west
    a, b, p, q = np.radians(x1 - x0), np.radians(x2 - x0), np.radians(y1), np.radians(y2)
    with np.errstate(divide="ignore", invalid="ignore"):
        sphere = b * np.sin(q) - a * np.sin(p) + np.where(q == p, np.nan, (b - a) / (q - p)) * (np.cos(q) - np.cos(p))
    flat = np.where(mark, width * d * (top - y1), ((x1 + x2) / 2 - x0) * (y2 - y1))
    return ~mark | (y1 > r0 * step + south), flat, EARTH_RADIUS_KM ** 2 * np.nan_to_num(np.where(mark, np.radians(width) * d * (np.sin(np.radians(top)) - np.sin(p)), sphere))


def _finisher(by: list[str], step: float, west: float, south: float):
    """The rest of the walk of one block whose rows make at most `TASK_PIECES` pieces: the same halving, clipping and sums."""

    def finish(rows: pa.Table) -> pa.Table:
        block, edge, d = tuple(_columns(rows, BLOCK)), tuple(v.astype(float) for v in _columns(rows, EDGE)), _columns(rows, ["d"])[0].astype(float)
        done = []
        while len(d):
            name = block[0] * (1 << 32) + block[2]  # blocks of one round do not overlap
            _, first, at = np.unique(name, return_index=True, return_inverse=True)
            shows, flat, sphere = _areas(block, edge, d, step, west, south)
            r0, r1, c0, c1 = (v[first] for v in block)
            single, empty = (r1 - r0 == 1) & (c1 - c0 == 1), np.bincount(at, shows) == 0
            ready = single | empty
            done.append([v[ready] for v in (empty, r0, r1, c0, c1, np.bincount(at, flat), np.bincount(at, sphere))])
            on = ~ready[at]
            block, edge, d = tuple(v[on] for v in block), tuple(v[on] for v in edge), d[on]
            halves = []
            for low, high in (block[:2], block[2:]):
                middle, two = (low + high) // 2, high - low > 1
                halves.append([(np.ones(len(low), bool), low, np.where(two, middle, high)), (two, middle, high)])
            parts = []
            for has_r, ra, rb in halves[0]:
                for has_c, ca, cb in halves[1]:
                    use = has_r & has_c
                    given = tuple(v[use] for v in (ra, rb, ca, cb))
                    row, made, e = _clip(given, tuple(v[use] for v in edge), d[use], step, west, south)
                    parts.append([*[v[row] for v in given], *made, e])
            r0, r1, c0, c1, x1, y1, x2, y2, d = (np.concatenate(v) for v in zip(*parts, strict=True))
            # marks of one height are added up, and cancel
            marks = np.flatnonzero(~np.isnan(d))
            marks = marks[np.lexsort((y1[marks], c0[marks], r0[marks]))]
            fresh = np.ones(len(marks), bool)
            fresh[1:] = np.any([v[marks][1:] != v[marks][:-1] for v in (r0, c0, y1)], axis=0)
            d[marks[fresh]] = np.bincount(np.cumsum(fresh) - 1, d[marks]) if len(marks) else 0.0
            keep = np.isnan(d)
            keep[marks[fresh]] = d[marks[fresh]] != 0
            block, edge, d = tuple(v[keep] for v in (r0, r1, c0, c1)), tuple(v[keep] for v in (x1, y1, x2, y2)), d[keep]
        full, r0, r1, c0, c1, flat, sphere = (np.concatenate(v) for v in zip(*done, strict=True))
        same = pa.array(np.zeros(len(full), np.int64))
        return pa.table({**{c: rows.column(c).take(same) for c in by}, "kind": pa.array(np.where(full, "full", "cell").tolist(), pa.string()),
                         **dict(zip(BLOCK, (r0, r1, c0, c1), strict=True)), "frac": flat / ((r1 - r0) * (c1 - c0) * (step * step)), "deg2": flat, "km2": sphere})

    return finish


def quadtree_walk(edges: DataFrame, by: list[str], step: float, rows: int, cols: int, west: float = -180.0, south: float = -90.0,
                  targets: DataFrame | None = None) -> DataFrame:
    """(by, kind, r0, r1, c0, c1, frac, deg2, km2): blocks wholly inside (`full`) and single grid cells that edges pass (`cell`).

    `edges` are directed (see `land_edges`), `rows` x `cols` cells of side `step` begin at (south, west). Each round halves the blocks that
    edges still pass and clips their edges; a block that no edge passes (an edge of one latitude shows by where the land beside the
    block begins or ends) is settled as full or as outside, which has no row. A round moves no edge: only heights on block sides are grouped. A block
    whose rows, each crossing all its rows and columns of cells, would make at most `TASK_PIECES` pieces is walked to its cells by one task, so
    rounds are few; with targets all of it goes in rounds. `targets` (by, r, c) restricts the walk to blocks that hold such a cell; each
    full block is then still whole. Areas are exact for edges straight in longitude and latitude.
    """
    keys = [*by, *BLOCK]
    whole_map = [F.lit(v).cast("bigint").alias(n) for n, v in zip(BLOCK, (0, rows, 0, cols), strict=True)]
    start = edges.where("y1 <> y2").select(*by, *whole_map, *[F.col(c).cast("double").alias(c) for c in EDGE], F.lit(None).cast("bigint").alias("d"))
    state = cut_lineage(_clipped(start, by, step, west, south))
    wanted = None if targets is None else targets.select(*by, "r", "c", *whole_map)
    done: list[DataFrame] = []
    while True:
        x0, top = F.col("c0") * step + west, F.col("r1") * step + south
        width = (F.col("c1") - F.col("c0")) * step
        flat, sphere = _green(x0)
        beside = EARTH_RADIUS_KM ** 2 * F.radians(width) * F.col("d") * (F.sin(F.radians(top)) - F.sin(F.radians("y1")))
        sums = state.groupBy(*keys).agg(
            F.count("*").alias("_rows"), F.count_if(F.col("x1").isNotNull() | (F.col("y1") > F.col("r0") * step + south)).alias("_edges"), F.sum(F.when(F.col("x1").isNull(), width * F.col("d") * (top - F.col("y1"))).otherwise(flat)).alias("deg2"),
            F.sum(F.when(F.col("x1").isNull(), beside).otherwise(sphere)).alias("km2"))
        single = (F.col("r1") - F.col("r0") == 1) & (F.col("c1") - F.col("c0") == 1)
        kind = F.when(F.col("_edges") == 0, "full").when(single, "cell")
        sums = cut_lineage(sums.withColumn("kind", kind))
        whole = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")) * (step * step)
        done.append(sums.where("kind is not null").select(*by, "kind", *BLOCK, (F.col("deg2") / whole).alias("frac"), "deg2", "km2"))
        left = sums.where("kind is null")
        if wanted is None:
            fits = F.col("_rows") * (F.col("r1") - F.col("r0") + F.col("c1") - F.col("c0")) <= TASK_PIECES
            small = state.join(left.where(fits).select(*keys), keys, "left_semi").select(*keys, *EDGE, "d")
            done.append(small.groupBy(*keys).applyInArrow(_finisher(by, step, west, south), done[0].schema))
            left = left.where(~fits)
        left = left.select(*keys)
        if wanted is not None:
            left = left.join(wanted.select(*keys).distinct(), keys, "left_semi")
        if left.isEmpty():
            break
        parts = state.join(left, keys, "left_semi").withColumn("_r", _halves("r0", "r1")).withColumn("_c", _halves("c0", "c1"))
        parts = parts.select(*by, F.col("_r.a").alias("r0"), F.col("_r.b").alias("r1"), F.col("_c.a").alias("c0"), F.col("_c.b").alias("c1"), *EDGE, "d")
        if wanted is not None:
            half = wanted.withColumn("_rm", F.floor((F.col("r0") + F.col("r1")) / 2)).withColumn("_cm", F.floor((F.col("c0") + F.col("c1")) / 2))
            up, right = (F.col("r") >= F.col("_rm")) & (F.col("r1") - F.col("r0") > 1), (F.col("c") >= F.col("_cm")) & (F.col("c1") - F.col("c0") > 1)
            wanted = cut_lineage(half.select(
                *by, "r", "c", F.when(up, F.col("_rm")).otherwise(F.col("r0")).alias("r0"), F.when(up | (F.col("r1") - F.col("r0") == 1), F.col("r1")).otherwise(F.col("_rm")).alias("r1"),
                F.when(right, F.col("_cm")).otherwise(F.col("c0")).alias("c0"), F.when(right | (F.col("c1") - F.col("c0") == 1), F.col("c1")).otherwise(F.col("_cm")).alias("c1")))
            parts = parts.join(wanted.select(*keys).distinct(), keys, "left_semi")
        state = cut_lineage(_clipped(parts, by, step, west, south))
    return reduce(DataFrame.unionByName, done)


def block_cells(blocks: DataFrame) -> DataFrame:
    """Single grid cells (r, c) of blocks; a full block gives all of its cells."""
    cells = blocks.withColumn("r", F.explode(F.sequence("r0", F.col("r1") - 1))).withColumn("c", F.explode(F.sequence("c0", F.col("c1") - 1)))
    return cells.drop(*BLOCK)
