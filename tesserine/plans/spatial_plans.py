"""Distances, neighbours, weights, autocorrelation, interpolation and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import coupling as K
from tesserine.operators import folds as FO
from tesserine.operators import interpolate as N
from tesserine.operators import spatial as S
from tesserine.operators import zonal as Z
from tesserine.plans import views as V
from tesserine.plans.panel_plans import HAV
from tesserine.plans.registry import query
from tesserine.session import cut_lineage

r6 = C.r6
DRAWS = 199
#: Draws of all other statistics but the centroid one: a false-discovery label needs p-values well below a tenth of its level.
LOCAL_DRAWS = 999


def unit_points(spark, sf):
    """Units at their mean coordinates; read several times by each statistic."""
    return cut_lineage(V.natrend(spark, sf).select("nk", "lat", "lon", "warming", "warming_area"))


def site_points(spark, sf):
    return V.sites(spark, sf).select("site", "nk", "lat", "lon")


def site_values(spark, sf):
    return cut_lineage(V.strend(spark, sf).select("site", "nk", "lat", "lon", F.col("ols_slope").alias("v")))


def dist_sql(src: str, key: str, name: str, where: str = "") -> str:
    return (f"{name} AS (SELECT a.{key} AS i, b.{key} AS j, {HAV('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM {src} a, {src} b WHERE a.{key} <> b.{key} {where})")


def nn_sql(k: int, dist: str = "d", name: str = "nn") -> str:
    return f"{name} AS (SELECT * FROM (SELECT i, j, km, row_number() OVER (PARTITION BY i ORDER BY round(km, 4), j) AS rank FROM {dist}) WHERE rank <= {k})"


DS = dist_sql("sites", "site", "d")
DU = dist_sql("natrend", "nk", "d")
KNN_W = f"{nn_sql(8)}, e AS (SELECT i, j, 1.0/count(*) OVER (PARTITION BY i) AS w FROM nn)"
MORAN = "z AS (SELECT nk, warming - avg(warming) OVER () AS z FROM natrend)"
MORAN_STAT = "(SELECT (SELECT count(*) FROM z)/(SELECT sum(w) FROM e)*sum(e.w*a.z*b.z)/(SELECT sum(z*z) FROM z) FROM e JOIN z a ON a.nk = e.i JOIN z b ON b.nk = e.j)"


def perm_sql(stat: str, draws: int = DRAWS) -> str:
    return f"""x AS (SELECT nk, z, row_number() OVER (ORDER BY nk) AS pos FROM z),
 pp AS (SELECT d.draw, a.nk, row_number() OVER (PARTITION BY d.draw ORDER BY md5('0|' || d.draw || '|' || a.nk)) AS pos FROM z a, (SELECT unnest(range(1, {draws + 1})) AS draw) d),
 pz AS (SELECT pp.draw, pp.nk, x.z FROM pp JOIN x ON x.pos = pp.pos),
 ps AS (SELECT a.draw, {stat} AS s FROM e JOIN pz a ON a.nk = e.i JOIN pz b ON b.nk = e.j AND b.draw = a.draw GROUP BY 1)"""


PERM_STAT = "(SELECT count(*) FROM z)/(SELECT sum(w) FROM e)*sum(e.w*a.z*b.z)/(SELECT sum(z*z) FROM z)"
PERM_MORAN, PERM_MORAN_999 = perm_sql(PERM_STAT), perm_sql(PERM_STAT, LOCAL_DRAWS)
GEARY_STAT = "((SELECT count(*) FROM z) - 1)*sum(e.w*(a.z-b.z)*(a.z-b.z))/(2.0*(SELECT sum(w) FROM e)*(SELECT sum(z*z) FROM z))"


@query("P1_distance_pairs", f"WITH {DU} SELECT i, j, round(km, 3) AS km FROM d", ("natrend",))
def distance_pairs(spark, sf):
    return S.near_pairs(unit_points(spark, sf), "nk", 20_100.0).select("i", "j", F.round("km", 3).alias("km"))


@query("J11_nearest_neighbours", f"WITH {DS}, {nn_sql(8)} SELECT i AS site, j AS neighbour, round(km, 3) AS km, rank FROM nn", ("sites",))
def nearest_neighbours(spark, sf):
    p = site_points(spark, sf)
    return S.nearest(p, p, 8, "site", "site").withColumn("km", F.round("km", 3))


@query("P16_identity_tie_graph", f"WITH {DS}, {nn_sql(4)} SELECT i AS site, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS neighbours FROM nn GROUP BY 1", ("sites",))
def identity_tie_graph(spark, sf):
    p = site_points(spark, sf)
    g = S.nearest(p, p, 4, "site", "site").groupBy("site").agg(F.array_sort(F.collect_list("neighbour")).alias("n"))
    return g.select("site", F.array_join(F.transform("n", lambda v: v.cast("string")), ",").alias("neighbours"))


@query("J12_count_within_radius", f"WITH {DS} SELECT s.site, count(CASE WHEN d.km <= 1500 THEN 1 END) AS n_near FROM sites s LEFT JOIN d ON d.i = s.site GROUP BY 1", ("sites",))
def count_within_radius(spark, sf):
    return S.count_within(site_points(spark, sf), "site", 1500.0)


@query("P2_knn_weights", f"WITH {DU}, {KNN_W} SELECT i, j, round(w, 6) AS w FROM e", ("natrend",))
def knn_weights(spark, sf):
    return S.knn_weights(unit_points(spark, sf), "nk", 8).select("i", "j", F.round("w", 6).alias("w"))


@query("P10_row_standardise", f"WITH {DU}, e AS (SELECT i, j, (1/km)/sum(1/km) OVER (PARTITION BY i) AS w FROM d WHERE km <= 4000) SELECT i, count(*) AS n, round(sum(w), 6) AS total, round(max(w), 6) AS top FROM e GROUP BY 1", ("natrend",))
def row_standardise(spark, sf):
    e = S.inverse_distance_weights(unit_points(spark, sf), "nk", 4000.0)
    return e.groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("top"))


BAND = "b0 AS (SELECT i, j FROM d WHERE km <= {cut}), b1 AS (SELECT * FROM b0 UNION ALL SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(km, 4), j) AS rk FROM d WHERE i NOT IN (SELECT i FROM b0)) WHERE rk = 1), e AS (SELECT i, j, 1.0/count(*) OVER (PARTITION BY i) AS w FROM b1)"


@query("P7_band_weights", f"WITH {DU}, {BAND.format(cut=1500)} SELECT i, j, round(w, 6) AS w FROM e", ("natrend",))
def band_weights(spark, sf):
    return S.band_weights(unit_points(spark, sf), "nk", 1500.0).select("i", "j", F.round("w", 6).alias("w"))


@query("P8_inverse_distance_weights", f"WITH {DU} SELECT i, j, round((1/km)/sum(1/km) OVER (PARTITION BY i), 6) AS w FROM d WHERE km <= 3000 AND km > 0", ("natrend",))
def inverse_distance_weights(spark, sf):
    return S.inverse_distance_weights(unit_points(spark, sf), "nk", 3000.0).select("i", "j", F.round("w", 6).alias("w"))


TOUCH = """l AS (SELECT ilat, ilon, nk FROM mask WHERE nk IS NOT NULL), t AS (SELECT DISTINCT a.nk AS a, b.nk AS b FROM l a JOIN l b ON (b.ilat = a.ilat AND b.ilon = (a.ilon+1)%36) OR (b.ilat = a.ilat+1 AND (b.ilon = a.ilon OR b.ilon = (a.ilon+1)%36 OR b.ilon = (a.ilon+35)%36)) WHERE a.nk <> b.nk),
 c0 AS (SELECT a AS i, b AS j FROM t UNION SELECT b, a FROM t), c1 AS (SELECT i, j FROM c0 WHERE i IN (SELECT nk FROM natrend) AND j IN (SELECT nk FROM natrend)),
 c2 AS (SELECT * FROM c1 UNION ALL SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(km, 4), j) AS rk FROM d WHERE i NOT IN (SELECT i FROM c1)) WHERE rk = 1)"""


@query("P9_contiguity_weights", f"WITH {DU}, {TOUCH} SELECT i, j, round(1.0/count(*) OVER (PARTITION BY i), 6) AS w FROM c2", ("natrend", "mask"))
def contiguity_weights(spark, sf):
    pairs = Z.adjacency(cut_lineage(V.mask(spark, sf)), "nk", 36)
    return S.contiguity_weights(unit_points(spark, sf), "nk", pairs).select("i", "j", F.round("w", 6).alias("w"))


def _moran_row(m):
    return m.select(r6("statistic").alias("statistic"), r6("expected").alias("expected"), r6("p_value").alias("p_value"), r6("z_score").alias("z_score"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("P3_moran_centroid_knn", f"WITH {DU}, {KNN_W}, {MORAN}, {PERM_MORAN}, o AS (SELECT {MORAN_STAT} AS s) SELECT round(any_value(o.s), 6)+0.0 AS statistic, round(-1.0/((SELECT count(*) FROM z)-1), 6) AS expected, round((count(*) FILTER (WHERE abs(ps.s) >= abs(o.s) - 1e-12) + 1)/{DRAWS + 1.0}, 6) AS p_value, round((any_value(o.s) - avg(ps.s))/stddev_samp(ps.s), 6)+0.0 AS z_score, '' AS reason FROM ps, o", ("natrend",))
def moran_centroid_knn(spark, sf):
    p = unit_points(spark, sf)
    return _moran_row(S.moran(p, S.knn_weights(p, "nk", 8), "nk", "warming", DRAWS, max_rows=V.unit_bound(spark, sf)))


@query("P4_moran_band", f"WITH {DU}, {BAND.format(cut=4000)}, {MORAN}, {PERM_MORAN_999}, o AS (SELECT {MORAN_STAT} AS s) SELECT round(any_value(o.s), 6)+0.0 AS statistic, round(-1.0/((SELECT count(*) FROM z)-1), 6) AS expected, round((count(*) FILTER (WHERE abs(ps.s) >= abs(o.s) - 1e-12) + 1)/{LOCAL_DRAWS + 1.0}, 6) AS p_value, round((any_value(o.s) - avg(ps.s))/stddev_samp(ps.s), 6)+0.0 AS z_score, '' AS reason FROM ps, o", ("natrend",))
def moran_band(spark, sf):
    p = unit_points(spark, sf)
    return _moran_row(S.moran(p, S.band_weights(p, "nk", 4000.0), "nk", "warming", LOCAL_DRAWS, max_rows=V.unit_bound(spark, sf)))


@query("P4_moran_sites", f"WITH {dist_sql('strend', 'site', 'd')}, {KNN_W}, z AS (SELECT site AS nk, ols_slope - avg(ols_slope) OVER () AS z FROM strend) SELECT round({MORAN_STAT}, 6)+0.0 AS statistic, count(*) AS n FROM z", ("strend",))
def moran_sites(spark, sf):
    p = site_values(spark, sf)
    m = S.moran(p, S.knn_weights(p, "site", 8), "site", "v")
    return m.select(r6("statistic").alias("statistic"), F.lit(1).alias("_")).drop("_").withColumn("n", p.agg(F.count("*")).scalar())


@query("P4_moran_unavailable", "SELECT 'constant_residuals' AS reason, count(*) AS n FROM natrend", ("natrend",))
def moran_unavailable(spark, sf):
    p = unit_points(spark, sf).withColumn("flat", F.lit(2.5))
    m = S.moran(p, S.knn_weights(p, "nk", 8), "nk", "flat")
    return m.select("reason").withColumn("n", p.agg(F.count("*")).scalar())


PERM_GEARY = perm_sql(GEARY_STAT, LOCAL_DRAWS)


@query("P5_geary", f"WITH {DU}, {KNN_W}, {MORAN}, {PERM_GEARY}, o AS (SELECT {GEARY_STAT} AS s FROM e JOIN z a ON a.nk = e.i JOIN z b ON b.nk = e.j) SELECT round(any_value(o.s), 6)+0.0 AS statistic, round((count(*) FILTER (WHERE abs(ps.s - 1) >= abs(o.s - 1) - 1e-12) + 1)/{LOCAL_DRAWS + 1.0}, 6) AS p_value FROM ps, o", ("natrend",))
def geary(spark, sf):
    p = unit_points(spark, sf)
    return S.geary(p, S.knn_weights(p, "nk", 8), "nk", "warming", LOCAL_DRAWS, max_rows=V.unit_bound(spark, sf)).select(r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


LISA = "lg AS (SELECT e.i AS nk, sum(e.w*z.z) AS lag FROM e JOIN z ON z.nk = e.j GROUP BY 1), li AS (SELECT z.nk, z.z, lg.lag, z.z*lg.lag/(SELECT avg(z*z) FROM z) AS local_i, CASE WHEN z.z >= 0 AND lag >= 0 THEN 'HH' WHEN z.z >= 0 THEN 'HL' WHEN lag >= 0 THEN 'LH' ELSE 'LL' END AS quadrant FROM z JOIN lg ON lg.nk = z.nk)"


@query("P6_local_moran", f"WITH {DU}, {KNN_W}, {MORAN}, {LISA} SELECT nk, round(local_i, 6)+0.0 AS local_i, round(lag, 6)+0.0 AS lag, quadrant FROM li", ("natrend",))
def local_moran(spark, sf):
    p = unit_points(spark, sf)
    return S.local_moran(p, S.knn_weights(p, "nk", 8), "nk", "warming").select("nk", r6("local_i").alias("local_i"), r6("lag").alias("lag"), "quadrant")


def lisa_p_sql(key: str, k: int = 8, draws: int = LOCAL_DRAWS) -> str:
    """Conditional permutation p of `li` over graph `e` with k neighbours each: other units' places are drawn by digests, each once (lp)."""
    steps = []
    for s in range(k):
        place = f"(n - {k + 1 - s})"
        drawn = f"CAST(floor(CAST('0x' || substr(md5('0|' || draw || '|' || {key} || '|' || {place}), 1, 12) AS BIGINT)/{float(16 ** 12)}*({place} + 1)) AS BIGINT)"
        taken = f"CASE WHEN r{s} IN ({', '.join(f'p{q}' for q in range(s))}) THEN {place} ELSE r{s} END" if s else "r0"
        steps.append(f"{drawn} AS r{s}, {taken} AS p{s}")
    picked = ", ".join(f"p{s}" for s in range(k))
    return f"""lx AS (SELECT {key}, z, row_number() OVER (ORDER BY {key}) - 1 AS pos, count(*) OVER () AS n FROM z),
 lr AS (SELECT draw, {key}, z, pos, {', '.join(steps)} FROM lx, (SELECT unnest(range(1, {draws + 1})) AS draw)),
 ls AS (SELECT {key}, draw, z, pos, unnest([{picked}]) AS idx FROM lr),
 lm AS (SELECT ls.{key}, ls.draw, any_value(ls.z)*sum(o.z)/{k}/(SELECT avg(z*z) FROM z) AS sim FROM ls JOIN lx o ON o.pos = ls.idx + CASE WHEN ls.idx < ls.pos THEN 0 ELSE 1 END GROUP BY 1, 2),
 lp AS (SELECT li.{key}, any_value(li.local_i) AS local_i, any_value(quadrant) AS quadrant, (count(*) FILTER (abs(sim) >= abs(li.local_i) - 1e-12) + 1)/{draws + 1.0} AS p_value FROM lm JOIN li ON li.{key} = lm.{key} GROUP BY 1),
 ll AS (SELECT *, CASE WHEN p_value < 0.05 THEN quadrant ELSE 'ns' END AS label FROM lp)"""


@query("P6_local_moran_p", f"WITH {DU}, {KNN_W}, {MORAN}, {LISA}, {lisa_p_sql('nk')} SELECT nk, round(local_i, 6)+0.0 AS local_i, quadrant, p_value, label FROM ll", ("natrend",))
def local_moran_p(spark, sf):
    p = unit_points(spark, sf)
    return S.local_moran_p(p, S.knn_weights(p, "nk", 8), "nk", "warming", LOCAL_DRAWS, max_rows=V.unit_bound(spark, sf)).select("nk", r6("local_i").alias("local_i"), "quadrant", "p_value", "label")


@query("P14_local_moran_fdr", f"""WITH {DU}, {KNN_W}, {MORAN}, {LISA}, {lisa_p_sql('nk')},
 c AS (SELECT *, p_value*count(*) OVER ()/row_number() OVER (ORDER BY p_value, nk) AS c FROM ll), f AS (SELECT *, least(min(c) OVER (ORDER BY p_value DESC RANGE UNBOUNDED PRECEDING), 1.0) AS q FROM c)
 SELECT nk, label, p_value, round(q, 6)+0.0 AS q_value, CASE WHEN q <= 0.05 THEN quadrant ELSE 'ns' END AS fdr_label FROM f""", ("natrend",))
def local_moran_fdr(spark, sf):
    p, n = unit_points(spark, sf), V.unit_bound(spark, sf)
    local = cut_lineage(S.local_moran_p(p, S.knn_weights(p, "nk", 8), "nk", "warming", LOCAL_DRAWS, max_rows=n))
    q = K.bh_adjust(local, "p_value", "q_value", max_rows=n)
    return q.select("nk", "label", "p_value", r6("q_value").alias("q_value"), F.when(F.col("q_value") <= 0.05, F.col("quadrant")).otherwise("ns").alias("fdr_label"))


@query("P15_local_structure", f"WITH {DU}, {KNN_W}, {MORAN}, {LISA}, e2 AS (SELECT i, j, 1.0/count(*) OVER (PARTITION BY i) AS w FROM (SELECT * FROM nn WHERE rank <= 4)), lg2 AS (SELECT e2.i AS nk, sum(e2.w*z.z) AS lag FROM e2 JOIN z ON z.nk = e2.j GROUP BY 1) SELECT quadrant, count(*) AS n, count(*) FILTER (WHERE (li.lag >= 0) = (lg2.lag >= 0)) AS n_agree FROM li JOIN lg2 ON lg2.nk = li.nk GROUP BY 1", ("natrend",))
def local_structure(spark, sf):
    p = unit_points(spark, sf)
    a = S.local_moran(p, S.knn_weights(p, "nk", 8), "nk", "warming").select("nk", "quadrant")
    b = S.local_moran(p, S.knn_weights(p, "nk", 4), "nk", "warming").select("nk", F.col("quadrant").alias("other"))
    return a.join(b, "nk").groupBy("quadrant").agg(F.count("*").alias("n"), F.count_if(F.col("quadrant") == F.col("other")).alias("n_agree"))


RINGS = [0.0, 500.0, 1000.0, 2000.0, 3000.0, 5000.0]
RING_CASE = "CASE " + " ".join(f"WHEN km >= {a} AND km < {b} THEN {i}" for i, (a, b) in enumerate(zip(RINGS, RINGS[1:]))) + " END"


@query("P11_correlogram", f"WITH {dist_sql('strend', 'site', 'd')}, z AS (SELECT site, ols_slope - avg(ols_slope) OVER () AS z FROM strend), r AS (SELECT {RING_CASE} AS ring, a.z AS za, b.z AS zb FROM d JOIN z a ON a.site = d.i JOIN z b ON b.site = d.j) SELECT CAST(ring AS BIGINT) AS ring, count(*)//2 AS n_pairs, round((SELECT count(*)/sum(z*z) FROM z)*sum(za*zb)/count(*), 6)+0.0 AS morans_i, round(avg((za-zb)*(za-zb))/2, 6) AS semivariance FROM r WHERE ring IS NOT NULL GROUP BY 1", ("strend",))
def correlogram(spark, sf):
    return S.ring_statistics(site_values(spark, sf), "v", RINGS).select("ring", "n_pairs", r6("morans_i").alias("morans_i"), F.round("semivariance", 6).alias("semivariance"))


ZD = f"l AS (SELECT clat AS lat, clon AS lon, nk FROM mask WHERE nk IS NOT NULL), zd AS (SELECT a.nk AS a, b.nk AS b, min({HAV('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS km FROM l a JOIN l b ON a.nk < b.nk GROUP BY 1, 2)"


def zone_pairs(spark, sf, radius):
    return S.zone_distances(V.mask(spark, sf).select(F.col("clat").alias("lat"), F.col("clon").alias("lon"), "nk"), "nk", radius)


@query("J26_zone_distance", f"WITH {ZD} SELECT a, b, round(km, 3) AS km FROM zd WHERE km <= 2000", ("mask",))
def zone_distance(spark, sf):
    return zone_pairs(spark, sf, 2000.0).select("a", "b", F.round("km", 3).alias("km"))


@query("J27_zone_distance_bounds", f"WITH {ZD} SELECT a, b, round(greatest(km - 2*785.0, 0), 3) AS lower_km, round(km, 3) AS upper_km FROM zd WHERE km <= 3000", ("mask",))
def zone_distance_bounds(spark, sf):
    # A ten-degree cell reaches at most 785 km from its centre, so footprints are no closer than centre distance minus two reaches.
    return zone_pairs(spark, sf, 3000.0).select("a", "b", F.round(F.greatest(F.col("km") - 2 * 785.0, F.lit(0.0)), 3).alias("lower_km"), F.round("km", 3).alias("upper_km"))


@query("P12_border_correlogram", f"WITH {ZD}, {MORAN}, r AS (SELECT {RING_CASE.replace('km', 'zd.km')} AS ring, x.z AS za, y.z AS zb FROM zd JOIN z x ON x.nk = zd.a JOIN z y ON y.nk = zd.b) SELECT CAST(ring AS BIGINT) AS ring, count(*) AS n_pairs, round((SELECT count(*)/sum(z*z) FROM z)*sum(za*zb)/count(*), 6)+0.0 AS morans_i FROM r WHERE ring IS NOT NULL GROUP BY 1", ("mask", "natrend"))
def border_correlogram(spark, sf):
    p = unit_points(spark, sf)
    mu = p.agg(F.avg("warming")).scalar()
    z = cut_lineage(p.select("nk", (F.col("warming") - mu).alias("z")))
    total = z.agg(F.struct(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("q")).alias("t")).scalar()
    ring = F.expr(RING_CASE)
    pairs = zone_pairs(spark, sf, RINGS[-1]).join(z.select(F.col("nk").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("nk").alias("b"), F.col("z").alias("zb")), "b")
    return pairs.withColumn("ring", ring.cast("bigint")).where("ring is not null").groupBy("ring").agg(
        F.count("*").alias("n_pairs"), r6(total["n"] / total["q"] * F.sum(F.col("za") * F.col("zb")) / F.count("*")).alias("morans_i"))


def _scheme_sql(name: str, edges: str) -> str:
    return f"SELECT '{name}' AS scheme, round((SELECT count(*) FROM z)/sum(e.w)*sum(e.w*a.z*b.z)/(SELECT sum(z*z) FROM z), 6)+0.0 AS morans_i FROM ({edges}) e JOIN z a ON a.nk = e.i JOIN z b ON b.nk = e.j"


@query("P13_weight_sweep", f"WITH {DU}, {MORAN}, {nn_sql(8)} " + " UNION ALL ".join([
    _scheme_sql("knn 4", "SELECT i, j, 0.25 AS w FROM nn WHERE rank <= 4"), _scheme_sql("knn 8", "SELECT i, j, 0.125 AS w FROM nn"),
    _scheme_sql("inverse 1", "SELECT i, j, (1/km)/sum(1/km) OVER (PARTITION BY i) AS w FROM d WHERE km <= 3000"),
    _scheme_sql("inverse 2", "SELECT i, j, (1/(km*km))/sum(1/(km*km)) OVER (PARTITION BY i) AS w FROM d WHERE km <= 3000")]), ("natrend",))
def weight_sweep(spark, sf):
    p = unit_points(spark, sf)
    schemes = {"knn 4": S.knn_weights(p, "nk", 4), "knn 8": S.knn_weights(p, "nk", 8),
               "inverse 1": S.inverse_distance_weights(p, "nk", 3000.0), "inverse 2": S.inverse_distance_weights(p, "nk", 3000.0, 2.0)}
    out = None
    for name, edges in schemes.items():
        row = S.moran(p, edges, "nk", "warming").select(F.lit(name).alias("scheme"), r6("statistic").alias("morans_i"))
        out = row if out is None else out.unionByName(row)
    return out


@query("P18_supplied_permutations", f"WITH {DU}, {KNN_W}, {MORAN}, {PERM_MORAN_999} SELECT draw, round(s, 6)+0.0 AS statistic FROM ps", ("natrend",))
def supplied_permutations(spark, sf):
    p = unit_points(spark, sf)
    mu = p.agg(F.avg("warming")).scalar()
    z = cut_lineage(p.select("nk", (F.col("warming") - mu).alias("z")))
    table = K.permuted(z, "nk", "z", LOCAL_DRAWS, 0, V.unit_bound(spark, sf))
    edges = S.knn_weights(p, "nk", 8)
    total = z.agg(F.struct(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("q")).alias("t")).scalar()
    a = table.select("draw", F.col("nk").alias("i"), F.col("permuted").alias("za"))
    b = table.select("draw", F.col("nk").alias("j"), F.col("permuted").alias("zb"))
    s = edges.join(a, "i").join(b, ["draw", "j"]).groupBy("draw").agg((total["n"] / F.sum("w") * F.sum(F.col("w") * F.col("za") * F.col("zb")) / total["q"]).alias("s"))
    return s.select(F.col("draw").cast("bigint").alias("draw"), r6("s").alias("statistic"))


# -- polygons --------------------------------------------------------------------

EDGES = """l AS (SELECT ilat, ilon, clat, clon FROM mask WHERE nk IS NOT NULL), o AS (SELECT l.*, d.* FROM l, (VALUES (1,0,-5.0,5.0,5.0,5.0),(-1,0,-5.0,-5.0,5.0,-5.0),(0,1,5.0,-5.0,5.0,5.0),(0,-1,-5.0,-5.0,-5.0,5.0)) d(di,dj,ax,ay,qx,qy)),
 eg AS (SELECT DISTINCT clon+ax AS x1, clat+ay AS y1, clon+qx AS x2, clat+qy AS y2 FROM o WHERE NOT EXISTS (SELECT 1 FROM l q WHERE q.ilat = o.ilat+o.di AND q.ilon = (o.ilon+o.dj+36)%36))"""


def coast(spark, sf):
    return S.cell_boundary(cut_lineage(V.mask(spark, sf).where("nk is not null")), 10.0, 36)


@query("J14_point_in_polygon", f"WITH {EDGES} SELECT s.site, count(eg.x1) % 2 = 1 AS inside FROM sites s LEFT JOIN eg ON eg.y1 <> eg.y2 AND ((eg.y1 <= s.lat AND s.lat < eg.y2) OR (eg.y2 <= s.lat AND s.lat < eg.y1)) AND s.lon < eg.x1 + (s.lat-eg.y1)/(eg.y2-eg.y1)*(eg.x2-eg.x1) GROUP BY 1", ("mask", "sites"))
def point_in_polygon(spark, sf):
    return S.points_in_polygon(V.sites(spark, sf), "site", coast(spark, sf).distinct())


NEAR_EDGE = f"""ne AS (SELECT s.site, s.lat, s.lon, x1 + t*(x2-x1) AS px, y1 + t*(y2-y1) AS py FROM (SELECT s.*, eg.*, least(greatest(((s.lon-x1)*(x2-x1)+(s.lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 0), 1) AS t FROM sites s, eg) s),
 nd AS (SELECT site, round(sqrt((lon-px)**2+(lat-py)**2), 9) AS d, round({HAV('lat', 'lon', 'py', 'px')}, 6) AS km FROM ne)"""


@query("J13_coast_distance", f"WITH {EDGES}, {NEAR_EDGE} SELECT site, round(min(d), 4) AS degrees, round(arg_min(km, (d, km)), 3) AS km FROM nd GROUP BY 1", ("mask", "sites"))
def coast_distance(spark, sf):
    return S.nearest_edge(V.sites(spark, sf), "site", coast(spark, sf)).select("site", F.round("degrees", 4).alias("degrees"), F.round("km", 3).alias("km"))


@query("S24_polygon_edges", f"WITH {EDGES} SELECT count(*) AS n_edges, round(sum(abs(x2-x1)+abs(y2-y1)), 3) AS perimeter FROM eg", ("mask",))
def polygon_edges(spark, sf):
    return coast(spark, sf).distinct().agg(F.count("*").alias("n_edges"), F.round(F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))), 3).alias("perimeter"))


@query("J31_exclusion_buffer", f"WITH {DS} SELECT s.site FROM sites s WHERE s.site % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.i = s.site AND d.j % 5 = 0 AND d.km <= 500)", ("sites",))
def exclusion_buffer(spark, sf):
    s = site_points(spark, sf)
    return S.outside_buffer(s.where("site % 5 <> 0"), s.where("site % 5 = 0"), 500.0).select("site")


# -- interpolation -----------------------------------------------------------------

LOO = f"""{dist_sql('strend', 'site', 'd', 'AND NOT (a.lat = b.lat AND a.lon = b.lon)')}, {nn_sql(10)},
 pr AS (SELECT nn.i AS site, sum(t.ols_slope/(km*km))/sum(1/(km*km)) AS idw FROM nn JOIN strend t ON t.site = nn.j GROUP BY 1)"""


def loo_neighbours(spark, sf, k=10):
    v = site_values(spark, sf)
    near = N.neighbour_values(v, v.select(F.col("site").alias("other"), "lat", "lon", F.col("v").alias("ov")), k, "site", "other", "ov", "coordinate")
    return v, cut_lineage(near)


@query("P19_idw_leave_location_out", f"WITH {LOO} SELECT site, round(idw, 6)+0.0 AS idw FROM pr", ("strend",))
def idw_leave_location_out(spark, sf):
    _, near = loo_neighbours(spark, sf)
    return N.idw(near, "site", "ov").select("site", r6("idw").alias("idw"))


@query("P22_idw_scores", f"WITH {LOO} SELECT count(*) AS n, round(sqrt(avg((idw-ols_slope)*(idw-ols_slope))), 6) AS rmse, round(avg(abs(idw-ols_slope)), 6) AS mae FROM pr JOIN strend t ON t.site = pr.site", ("strend",))
def idw_scores(spark, sf):
    v, near = loo_neighbours(spark, sf)
    e = F.col("idw") - F.col("v")
    return N.idw(near, "site", "ov").join(v, "site").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


@query("P20_variogram_fit")
def variogram_fit(spark, sf):
    return N.variogram(site_values(spark, sf), "v", 5000.0).select(*[r6(c, 4).alias(c) for c in ("nugget", "psill", "range_km")])


@query("P21_kriging_surface")
def kriging_surface(spark, sf):
    v = site_values(spark, sf)
    model = cut_lineage(N.variogram(v, "v", 5000.0))
    nodes = V.mask(spark, sf).where("nk is not null").select((F.col("ilat") * 36 + F.col("ilon")).alias("node"), F.col("clat").alias("lat"), F.col("clon").alias("lon"))
    near = N.neighbour_values(nodes, v, 12, "node", "site", "v", None)
    return N.ordinary_kriging(near, "node", "v", model).select("node", r6("kriging", 4).alias("kriging"), r6("variance", 4).alias("variance"))


@query("P22_interpolation_cv")
def interpolation_cv(spark, sf):
    v, near = loo_neighbours(spark, sf)
    model = cut_lineage(N.variogram(v, "v", 5000.0))
    both = N.idw(near, "site", "ov").join(N.ordinary_kriging(near, "site", "ov", model), "site").join(v, "site")
    long = both.unpivot(["site", "v"], ["idw", "kriging"], "method", "p").withColumn("e", F.col("p") - F.col("v"))
    return long.groupBy("method").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.avg(F.abs("e"))).alias("mae"))


SURFACE = f"""g AS (SELECT ilat*36 + ilon AS node, clat AS lat, clon AS lon FROM mask WHERE nk IS NOT NULL), d AS (SELECT g.node AS i, t.site AS j, {HAV('g.lat', 'g.lon', 't.lat', 't.lon')} AS km FROM g, strend t), {nn_sql(8)},
 pr AS (SELECT nn.i AS node, CASE WHEN min(km) = 0 THEN avg(CASE WHEN km = 0 THEN t.ols_slope END) ELSE sum(t.ols_slope/nullif(km*km, 0))/sum(1/nullif(km*km, 0)) END AS v FROM nn JOIN strend t ON t.site = nn.j GROUP BY 1)"""


@query("P25_land_surface", f"WITH {SURFACE} SELECT node, round(v, 6)+0.0 AS value FROM pr", ("mask", "strend"))
def land_surface(spark, sf):
    v = site_values(spark, sf)
    nodes = V.mask(spark, sf).where("nk is not null").select((F.col("ilat") * 36 + F.col("ilon")).alias("node"), F.col("clat").alias("lat"), F.col("clon").alias("lon"))
    return N.idw(N.neighbour_values(nodes, v, 8, "node", "site", "v", None), "node", "v").select("node", r6("idw").alias("value"))


def _land_nodes(spark, sf):
    return V.mask(spark, sf).where("nk is not null").select((F.col("ilat") * 36 + F.col("ilon")).alias("node"), F.col("clat").alias("lat"), F.col("clon").alias("lon"))


@query("P25_winning_surface")
def winning_surface(spark, sf):
    """The surface of whichever method has the smaller error with locations left out."""
    v = site_values(spark, sf)
    _, _, surface = N.best_surface(v, "site", "v", _land_nodes(spark, sf), "node", 10, cut_lineage(N.variogram(v, "v", 5000.0)))
    return surface.select("node", "method", r6("value", 4).alias("value"))


@query("P22_left_out_scores")
def left_out_scores(spark, sf):
    v = site_values(spark, sf)
    s = N.interpolation_scores(v, "site", "v", 10, cut_lineage(N.variogram(v, "v", 5000.0)))
    return s.select("left_out", "method", "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"))


_LEFT_OUT = f"""{dist_sql('strend', 'site', 'd')}, t AS (SELECT site, lat, lon, ols_slope AS v FROM strend), dd AS (SELECT d.i, d.j, d.km, a.lat = b.lat AND a.lon = b.lon AS twin FROM d JOIN t a ON a.site = d.i JOIN t b ON b.site = d.j),
 kk AS (SELECT least(10, sum(c) - max(c)) AS k FROM (SELECT count(*) AS c FROM t GROUP BY lat, lon)),
 w AS (SELECT 'location' AS left_out, i, j, km, row_number() OVER (PARTITION BY i ORDER BY round(km, 4), j) AS rk, (SELECT k FROM kk) AS k FROM dd WHERE NOT twin
   UNION ALL SELECT 'row', i, j, km, row_number() OVER (PARTITION BY i ORDER BY round(km, 4), j), (SELECT least(10, count(*) - 1) FROM t) FROM dd),
 pr AS (SELECT left_out, i, CASE WHEN min(km) = 0 THEN avg(CASE WHEN km = 0 THEN t.v END) ELSE sum(t.v/nullif(km*km, 0))/sum(1/nullif(km*km, 0)) END AS p FROM w JOIN t ON t.site = w.j WHERE rk <= k GROUP BY 1, 2)"""


@query("P22_left_out_idw", f"WITH {_LEFT_OUT} SELECT left_out, count(*) AS n, round(sqrt(avg((p - t.v)*(p - t.v))), 6) AS rmse, round(avg(abs(p - t.v)), 6) AS mae FROM pr JOIN t ON t.site = pr.i GROUP BY 1", ("strend",))
def left_out_idw(spark, sf):
    """Inverse distance with the location or only the row left out."""
    v = site_values(spark, sf)
    near = N.left_out_neighbours(v, "site", "v", 10).withColumn("_q", F.struct("left_out", "q"))
    e = F.col("idw") - F.col("v")
    both = N.idw(near, "_q", "v").select("_q.left_out", F.col("_q.q").alias("site"), "idw").join(v.select("site", "v"), "site")
    return both.groupBy("left_out").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))


# -- folds -------------------------------------------------------------------------

@query("P24_grouped_random_folds", """WITH g AS (SELECT lat, lon, (row_number() OVER (ORDER BY md5('0|' || CAST(CAST(lat AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(lon AS BIGINT) AS VARCHAR))) - 1) % 5 AS fold FROM (SELECT DISTINCT lat, lon FROM sites)) SELECT s.site, g.fold FROM sites s JOIN g ON g.lat = s.lat AND g.lon = s.lon""", ("sites",))
def grouped_random_folds(spark, sf):
    return FO.grouped_random(site_points(spark, sf), 5).select("site", "fold")


@query("P26_kmeans_folds")
def kmeans_folds(spark, sf):
    return FO.spherical_kmeans(site_points(spark, sf), 6, seed=0).select("site", "fold")


@query("P27_label_folds", "SELECT t.nk, dense_rank() OVER (ORDER BY u.zone) - 1 AS fold FROM natrend t JOIN units u ON u.nk = t.nk", ("natrend", "units"))
def label_folds(spark, sf):
    return FO.from_labels(V.natrend(spark, sf).select("nk").join(V.units(spark, sf), "nk"), "zone").select("nk", "fold")


BUFFERED = "{dist}, f AS (SELECT s.site, s.site % 5 AS fold FROM sites s), m AS (SELECT a.site, k.fold FROM f a, (SELECT unnest(range(5)) AS fold) k WHERE a.fold <> k.fold AND NOT EXISTS (SELECT 1 FROM d JOIN f b ON b.site = d.j WHERE d.i = a.site AND b.fold = k.fold AND d.km <= {km}))"


def _buffered(spark, sf, km):
    s = site_points(spark, sf).withColumn("fold", F.col("site") % 5)
    return FO.training_rows(s, "site", "fold", km)


@query("P28_buffered_folds", f"WITH {BUFFERED.format(dist=DS, km=500)} SELECT fold, count(*) AS n_train, sum(site)::BIGINT AS id_sum FROM m GROUP BY 1", ("sites",))
def buffered_folds(spark, sf):
    return _buffered(spark, sf, 500.0).groupBy("fold").agg(F.count("*").alias("n_train"), F.sum("site").alias("id_sum"))


@query("P45_buffer_sensitivity", " UNION ALL ".join(f"SELECT {km}::BIGINT AS buffer_km, (SELECT count(*) FROM m{km}) AS n_train" for km in (250, 1000, 1500)).join(["WITH " + DS + ", f AS (SELECT s.site, s.site % 5 AS fold FROM sites s), " + ", ".join(f"m{km} AS (SELECT a.site, k.fold FROM f a, (SELECT unnest(range(5)) AS fold) k WHERE a.fold <> k.fold AND NOT EXISTS (SELECT 1 FROM d JOIN f b ON b.site = d.j WHERE d.i = a.site AND b.fold = k.fold AND d.km <= {km}))" for km in (250, 1000, 1500)) + " ", ""]), ("sites",))
def buffer_sensitivity(spark, sf):
    out = None
    for km in (250, 1000, 1500):
        row = _buffered(spark, sf, float(km)).agg(F.lit(km).cast("bigint").alias("buffer_km"), F.count("*").alias("n_train"))
        out = row if out is None else out.unionByName(row)
    return out


@query("P23_fold_predictions")
def fold_predictions(spark, sf):
    """Interpolation fitted on each fold's training rows only, variogram included."""
    v = cut_lineage(FO.grouped_random(site_values(spark, sf), 5))
    models = cut_lineage(N.fold_variograms(v, "v", "fold", 5000.0))
    out = None
    for f in range(5):
        train, test = v.where(F.col("fold") != f), v.where(F.col("fold") == f)
        train = train.select(F.col("site").alias("other"), "lat", "lon", F.col("v").alias("ov"))
        near = cut_lineage(N.neighbour_values(test, train, 10, "site", "other", "ov", None))
        both = N.idw(near, "site", "ov").join(N.ordinary_kriging(near, "site", "ov", models.where(F.col("fold") == f)), "site")
        part = both.select("site", F.lit(f).alias("fold"), r6("idw").alias("idw"), r6("kriging", 4).alias("kriging"))
        out = part if out is None else out.unionByName(part)
    return out


FOLD_IDW = f"""g AS (SELECT lat, lon, (row_number() OVER (ORDER BY md5('0|' || CAST(CAST(lat AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(lon AS BIGINT) AS VARCHAR))) - 1) % 5 AS fold FROM (SELECT DISTINCT lat, lon FROM strend)), t AS (SELECT s.site, s.lat, s.lon, s.ols_slope AS v, g.fold FROM strend s JOIN g ON g.lat = s.lat AND g.lon = s.lon),
 d AS (SELECT a.site AS i, b.site AS j, {HAV('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM t a JOIN t b ON a.fold <> b.fold), {nn_sql(10)}"""


@query("P23_fold_idw", f"WITH {FOLD_IDW} SELECT nn.i AS site, round(sum(t.v/(km*km))/sum(1/(km*km)), 6)+0.0 AS idw FROM nn JOIN t ON t.site = nn.j GROUP BY 1", ("strend",))
def fold_idw(spark, sf):
    v = cut_lineage(FO.grouped_random(site_values(spark, sf), 5))
    out = None
    for f in range(5):
        train = v.where(F.col("fold") != f).select(F.col("site").alias("other"), "lat", "lon", F.col("v").alias("ov"))
        near = N.neighbour_values(v.where(F.col("fold") == f), train, 10, "site", "other", "ov", None)
        part = N.idw(near, "site", "ov").select("site", r6("idw").alias("idw"))
        out = part if out is None else out.unionByName(part)
    return out
