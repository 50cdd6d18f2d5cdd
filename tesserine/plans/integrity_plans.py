"""Gates, digests, gridded sources, order checks and figure data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import checks as Q
from tesserine.operators import linear as L
from tesserine.operators import ordering as O
from tesserine.operators import panel as P
from tesserine.operators import row_orders as RO
from tesserine.operators import spatial as S
from tesserine.operators.tables import years_of
from tesserine.plans import model_plans as M
from tesserine.plans import relational_plans as RP
from tesserine.plans import series_plans as SP
from tesserine.plans import spatial_plans as XP
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.session import cut_lineage
from tesserine.sources import grids as GR
from tesserine.sources import tables as T

r6 = C.r6


@query("Q1_design_schema", f"WITH {M.DESIGN} SELECT nk, round(warming, 6) AS warming, round(abs_lat, 6) AS abs_lat FROM dg", ("country",))
def design_schema(spark, sf):
    d = M.design(spark, sf).select("nk", F.round("warming", 6).alias("warming"), F.round("abs_lat", 6).alias("abs_lat"))
    return Q.require_design(d, {"geography": ["abs_lat"]}, ["nk", "warming"])


@query("Q2_disjoint_groups", "SELECT 6::BIGINT AS n_features, true AS disjoint, count(*) AS n FROM country", ("country",))
def disjoint_groups(spark, sf):
    Q.require_disjoint(M.GROUPS)
    return V.country(spark, sf).agg(F.lit(len(M.ALL)).cast("bigint").alias("n_features"), F.lit(True).alias("disjoint"), F.count("*").alias("n"))


@query("Q3_definition_hash", "SELECT nk, sha256(unit || '|' || zone) AS definition_hash FROM units", ("units",))
def definition_hash(spark, sf):
    return V.units(spark, sf).select("nk", F.sha2(F.concat_ws("|", "unit", "zone"), 256).alias("definition_hash"))


@query("Q5_series_invariants", f"WITH {SP.MONTHS} SELECT count(*) = max(t) - min(t) + 1 AS contiguous, count(*) FILTER (WHERE y IS NULL OR n_orders IS NULL) AS n_missing, avg(y) BETWEEN 20 AND 60 AS in_band, max(abs(n_late)) < 10000 AS bounded FROM sr", ("panel",))
def series_invariants(spark, sf):
    return SP.months(spark, sf).agg(
        (F.count("*") == F.max("t") - F.min("t") + 1).alias("contiguous"), F.count_if(F.col("y").isNull() | F.col("n_orders").isNull()).alias("n_missing"),
        F.avg("y").between(20, 60).alias("in_band"), (F.max(F.abs("n_late")) < 10000).alias("bounded"))


@query("Q6_null_rate_gate", "SELECT round(avg(CASE WHEN consumption IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, avg(CASE WHEN consumption IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 AS passes FROM emis", ("emis",))
def null_rate_gate(spark, sf):
    return Q.null_rate_gate(V.emis(spark, sf), "consumption", 0.5).select(F.round("null_rate", 6).alias("null_rate"), "passes")


@query("Q7_sampling_determinism", "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, count(*) >= 0 AS passes FROM sites", ("sites",))
def sampling_determinism(spark, sf):
    from tesserine.plans.zonal_plans import nearest_cell
    first = cut_lineage(nearest_cell(spark, sf))
    return Q.same_rows(first, nearest_cell(spark, sf))


@query("Q8_spot_checks", "SELECT unit, CASE unit WHEN 'NATION_3' THEN zone = 'EUROPE' WHEN 'NATION_6' THEN zone = 'AMERICA' WHEN 'NATION_8' THEN zone = 'EUROPE' END AS passes FROM units WHERE unit IN ('NATION_3', 'NATION_6', 'NATION_8')", ("units",))
def spot_checks(spark, sf):
    expected = {"NATION_3": "EUROPE", "NATION_6": "AMERICA", "NATION_8": "EUROPE"}
    return V.units(spark, sf).where(F.col("unit").isin(*expected)).select("unit", (F.col("zone") == C.mapped("unit", expected)).alias("passes"))


@query("Q9_preflight", "SELECT 'coverage' AS gate, avg(coverage) >= 0.9 AS passes FROM cover UNION ALL SELECT 'nulls', avg(CASE WHEN consumption IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 FROM emis UNION ALL SELECT 'orphans', (SELECT count(*) FROM sites s WHERE s.nk NOT IN (SELECT nk FROM units)) = 0", ("cover", "emis", "sites", "units"))
def preflight(spark, sf):
    cover = P.coverage(V.panel(spark, sf, V.WINDOW), ["site"], V.WINDOW, V.MIN_COVERAGE).agg((F.avg("coverage") >= 0.9).alias("passes"))
    nulls = Q.null_rate_gate(V.emis(spark, sf), "consumption", 0.5).select("passes")
    lost = V.sites(spark, sf).join(V.units(spark, sf), "nk", "left_anti").agg((F.count("*") == 0).alias("passes"))
    out = None
    for name, row in (("coverage", cover), ("nulls", nulls), ("orphans", lost)):
        part = row.select(F.lit(name).alias("gate"), "passes")
        out = part if out is None else out.unionByName(part)
    return out


@query("Q10_content_manifest")
def content_manifest(spark, sf):
    return T.file_manifest(spark, sf, "*.parquet")


@query("Q11_pointer_index", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def pointer_index(spark, sf):
    return V.table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("Q12_evidence_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def evidence_digests(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("Q13_stage_receipt", "SELECT 'completed' AS status, count(*) AS n FROM sites", ("sites",))
def stage_receipt(spark, sf):
    receipts = Q.Receipts(spark, T.shared_folder(spark, "receipts"))
    record = receipts.stage("sites", [f"{sf}/supplier.parquet"], lambda path: V.sites(spark, sf).write.parquet(path))
    return spark.read.parquet(receipts.verified("sites")).agg(F.lit(record["status"]).alias("status"), F.count("*").alias("n"))


@query("Q16_package_verification", "SELECT count(*) AS n FROM sites", ("sites",))
def package_verification(spark, sf):
    folder = T.shared_folder(spark, "package")
    V.sites(spark, sf).write.parquet(folder)
    manifest = T.shared_folder(spark, "manifest")
    T.file_manifest(spark, folder, "*.parquet").write.parquet(manifest)
    Q.verify_manifest(spark, folder, spark.read.parquet(manifest))
    return spark.read.parquet(folder).agg(F.count("*").alias("n"))


@query("Q17_representation_equivalence", "SELECT count(*) AS n, true AS passes FROM country", ("country",))
def representation_equivalence(spark, sf):
    d = M.design(spark, sf)
    def fitted(cols):
        beta = L.fit(d, cols, "warming").select("beta").scalar()
        return d.select("nk", L.predicted(beta, cols).alias("fitted"))
    gap = Q.largest_gap(fitted(["abs_lat", "log_cum", "log_pop"]), fitted(["abs_lat", "log_resp", "log_pop"]), "nk", "fitted")
    return gap.select("n", (F.col("gap") <= 1e-8).alias("passes"))


# -- gridded files -------------------------------------------------------------------

def _grid_folder(spark, sf):
    """The monthly field as one classic NetCDF file per latitude row, times as fractional years."""
    stamp = F.year("month") + (F.month("month") - 0.5) / 12.0
    field = V.with_zone(V.cells(spark, sf)).select("ilat", stamp.alias("t"), F.col("clat").alias("lat"), F.col("clon").alias("lon"), "value")
    folder = T.shared_folder(spark, "grid")
    GR.write_files(GR.band_files(field), "ilat", folder)
    return folder


def _grid_row():
    return F.round((F.col("lat") + 85.0) / 10.0).cast("bigint").alias("ilat")


@query("S18_band_scan", "SELECT ilat, count(*) AS n, round(avg(value), 3) AS mean_value FROM cells GROUP BY 1", ("cells",))
def band_scan(spark, sf):
    grid = GR.read_grid_files(spark, _grid_folder(spark, sf), "field")
    return grid.where("value is not null and not isnan(value)").groupBy(_grid_row()).agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_value"))


@query("S18_time_and_band_slice", "SELECT ilat, strftime(month, '%Y') AS year, count(*) AS n, round(avg(value), 3) AS mean_value FROM cells WHERE month >= DATE '1994-01-01' AND month < DATE '1997-01-01' AND ilat BETWEEN 5 AND 12 GROUP BY 1, 2", ("cells",))
def time_and_band_slice(spark, sf):
    """Three years of the latitudes 40 S to 40 N: both bounds reach the reader, which seeks past the other bytes."""
    grid = GR.read_grid_files(spark, _grid_folder(spark, sf), "field", times=(1994.0, 1997.0), lats=(-40.0, 40.0))
    year = F.floor("time").cast("int").cast("string").alias("year")
    return grid.where("value is not null").groupBy(_grid_row(), year).agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_value"))


@query("S31_conform_axes", "SELECT ilat, ilon, strftime(month, '%Y-%m-%d') AS time, round(value, 4) AS field FROM cells", ("cells",))
def conform_axes(spark, sf):
    raw = V.cells(spark, sf).select("ilat", "ilon", F.date_format("month", "yyyy-MM-dd").alias("valid_time"), F.round("value", 4).alias("t2m"), F.lit(0).alias("number"), F.lit("0001").alias("expver"))
    return GR.conform_axes(raw, {"valid_time": "time", "t2m": "field"}, ["number", "expver"])


@query("S27_year_snapshot", """WITH v AS (SELECT nk, yr, production FROM emis), m AS (SELECT max(production) AS hi FROM v) SELECT nk, round(production/hi, 6) AS score, CASE WHEN production IS NOT NULL THEN 1998.0::DOUBLE END AS year FROM v, m WHERE yr = 1998""", ("emis",))
def year_snapshot(spark, sf):
    e = cut_lineage(V.emis(spark, sf))
    hi = e.agg(F.max("production")).scalar()
    scored = e.withColumn("score", F.col("production") / hi)
    years = years_of(scored, "yr")
    wide = scored.groupBy("nk").pivot("yr", years).agg(F.first("score"))
    long = wide.unpivot(["nk"], [str(y) for y in years], "yr", "score").where("yr = '1998' and score is not null")
    RP.B.require_unique(long, ["nk"])
    bad = long.where("not (score between 0 and 1)")
    if not bad.isEmpty():
        raise Q.GateFailure("score outside [0, 1]")
    return long.select("nk", F.round("score", 6).alias("score"), F.lit(1998.0).alias("year"))


# -- order and identity ----------------------------------------------------------------

@query("T9_canonical_sort", "SELECT site, row_number() OVER (ORDER BY nk, lat, lon, site) AS pos FROM sites", ("sites",))
def canonical_sort(spark, sf):
    s = RP.B.require_unique(V.sites(spark, sf), ["nk", "lat", "lon", "site"])
    if not s.where("isnan(lat) or isnan(lon) or lat is null or lon is null").isEmpty():
        raise ValueError("coordinates must be finite")
    return O.row_ids(s, ["nk", "lat", "lon", "site"], "p").select("site", (F.col("p") + 1).cast("bigint").alias("pos"))


@query("T10_order_invariance", "SELECT count(*) AS n_groups, 0::BIGINT AS n_changed FROM trend", ("trend",))
def order_invariance(spark, sf):
    base = cut_lineage(V.trend(spark, sf).withColumn("v", F.round("ols_slope", 9)))
    shuffled = V.anom(spark, sf).repartition(7, F.xxhash64("month", "site")).sortWithinPartitions(F.xxhash64("site", "month"))
    again = P.ols_trend(shuffled, ["site"]).select("site", F.round("ols_slope", 9).alias("w"))
    return base.join(again, "site").agg(F.count("*").alias("n_groups"), F.count_if(F.abs(F.col("v") - F.col("w")) > 1e-8).alias("n_changed"))


@query("P17_neighbour_order", "SELECT 800::BIGINT * (SELECT count(*) FROM sites) // 100 AS n_edges, 0::BIGINT AS only_first, 0::BIGINT AS only_second", ("sites",))
def neighbour_order(spark, sf):
    p = XP.site_points(spark, sf)
    first = cut_lineage(S.nearest(p, p, 8, "site", "site").select("site", "neighbour"))
    q = p.repartition(5, F.xxhash64("lon", "site"))
    second = cut_lineage(S.nearest(q, q, 8, "site", "site").select("site", "neighbour"))
    return Q.same_rows(first, second).select("only_first", "only_second").withColumn("n_edges", first.agg(F.count("*")).scalar())


@query("P44_arc_distance", f"""WITH {XP.EDGES}, a AS (SELECT s.site, cos(radians(s.lat))*cos(radians(s.lon)) AS px, cos(radians(s.lat))*sin(radians(s.lon)) AS py, sin(radians(s.lat)) AS pz, cos(radians(y1))*cos(radians(x1)) AS ax, cos(radians(y1))*sin(radians(x1)) AS ay, sin(radians(y1)) AS az,
 cos(radians(y2))*cos(radians(x2)) AS bx, cos(radians(y2))*sin(radians(x2)) AS bz0, sin(radians(y2)) AS bz, least({XP.HAV('s.lat', 's.lon', 'y1', 'x1')}, {XP.HAV('s.lat', 's.lon', 'y2', 'x2')}) AS ends FROM sites s, eg),
 n AS (SELECT *, ay*bz - az*bz0 AS nx, az*bx - ax*bz AS ny, ax*bz0 - ay*bx AS nz FROM a), m AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS nn FROM n), s AS (SELECT *, (px*nx+py*ny+pz*nz)/nullif(nn, 0) AS s FROM m),
 q AS (SELECT *, px - s*nx/nn AS qx, py - s*ny/nn AS qy, pz - s*nz/nn AS qz FROM s)
 SELECT site, round(min(CASE WHEN nn > 0 AND (ay*qz-az*qy)*nx + (az*qx-ax*qz)*ny + (ax*qy-ay*qx)*nz >= 0 AND (qy*bz-qz*bz0)*nx + (qz*bx-qx*bz)*ny + (qx*bz0-qy*bx)*nz >= 0 THEN {C.EARTH_RADIUS_KM}*asin(least(abs(s), 1.0)) ELSE ends END), 3) AS km FROM q GROUP BY 1""", ("mask", "sites"))
def arc_distance(spark, sf):
    return S.nearest_arc(V.sites(spark, sf), "site", XP.coast(spark, sf)).select("site", F.round("km", 3).alias("km"))


# -- figure data -------------------------------------------------------------------------

@query("V1_one_series", "SELECT strftime(month, '%Y-%m-%d') AS month, round(anomaly, 6)+0.0 AS anomaly FROM anom WHERE site = 7", ("anom",))
def one_series(spark, sf):
    # The filter sits on the fact scan, not after the aggregation.
    lines = V.table(spark, sf, "lineitem").where("l_suppkey = 7")
    p = P.monthly_panel(lines, "l_suppkey", "l_shipdate", "l_extendedprice")
    return P.gated_anomalies(p, ["site"], V.BASELINE, V.WINDOW, V.MIN_COVERAGE, calendar_bound=True).select(F.date_format("month", "yyyy-MM-dd").alias("month"), r6("anomaly").alias("anomaly"))


@query("V2_unit_picker", "SELECT s.site, s.lat, s.lon FROM sites s JOIN units u ON u.nk = s.nk WHERE u.unit = 'NATION_6' ORDER BY s.site", ("sites", "units"))
def unit_picker(spark, sf):
    return V.sites(spark, sf).join(V.units(spark, sf).where("unit = 'NATION_6'"), "nk").orderBy("site").select("site", "lat", "lon")


@query("V3_latitude_scatter", "SELECT CAST(floor(lat/10) AS BIGINT) AS band, count(*) AS n, round(median(ols_slope), 6)+0.0 AS median FROM strend GROUP BY 1 HAVING count(*) >= 3", ("strend",))
def latitude_scatter(spark, sf):
    return RP.band_medians(spark, sf, 3)


@query("V4_stacked_segments", f"WITH {M.TWO}, s AS (SELECT 1 AS o, 'geography' AS grp, (r1+r12-r2)/2 AS share FROM q UNION ALL SELECT 2, 'economy', (r2+r12-r1)/2 FROM q UNION ALL SELECT 3, 'residual', 1-r12 FROM q) SELECT grp AS \"group\", round(sum(share) OVER (ORDER BY o) - share, 6)+0.0 AS start, round(sum(share) OVER (ORDER BY o), 6)+0.0 AS stop FROM s", M.SITE_VIEWS)
def stacked_segments(spark, sf):
    from pyspark.sql import Window
    s = L.group_shares(M.site_design(spark, sf), {"geography": ["x"], "economy": ["a"]}, "y").withColumn("o", C.mapped("group", {"geography": 1, "economy": 2, "residual": 3}))
    stop = F.sum("share").over(Window.orderBy("o"))  # one row per column group
    return s.select("group", r6(stop - F.col("share")).alias("start"), r6(stop).alias("stop"))


@query("V5_lorenz_chart", "SELECT round(u, 6)+0.0 AS unit_share, round(v, 6)+0.0 AS value_share FROM (SELECT row_number() OVER (ORDER BY warming, nk)*1.0/count(*) OVER () AS u, sum(warming) OVER (ORDER BY warming, nk ROWS UNBOUNDED PRECEDING)/sum(warming) OVER () AS v FROM natrend UNION ALL SELECT 0.0, 0.0)", ("natrend",))
def lorenz_chart(spark, sf):
    from tesserine.operators.inequality import lorenz_points
    p = lorenz_points(cut_lineage(V.natrend(spark, sf)), "warming", max_rows=V.unit_bound(spark, sf))
    return p.select(r6("unit_share").alias("unit_share"), r6("value_share").alias("value_share"))


@query("V6_tier_boxes", f"WITH {RP.TIER_SQL} SELECT CAST(tier AS BIGINT) AS tier, round(quantile_cont(warming, 0.25), 6) AS q1, round(quantile_cont(warming, 0.5), 6) AS q2, round(quantile_cont(warming, 0.75), 6) AS q3 FROM tier JOIN natrend t ON t.nk = tier.nk GROUP BY 1", ("wealth", "natrend"))
def tier_boxes(spark, sf):
    joined = RP.tiers(spark, sf).join(V.natrend(spark, sf), "nk")
    q = O.quantiles(joined, "warming", (0.25, 0.5, 0.75), ("q1", "q2", "q3"), by=["tier"], max_rows=V.unit_bound(spark, sf))
    return q.select("tier", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


@query("V8_rolling_and_line", "SELECT strftime(month, '%Y-%m-%d') AS month, round(anomaly, 6)+0.0 AS anomaly, round(CASE WHEN count(*) OVER w = 12 THEN avg(anomaly) OVER w END, 6)+0.0 AS rolling, round(regr_intercept(anomaly, x) OVER () + regr_slope(anomaly, x) OVER ()*x, 6)+0.0 AS line FROM anom WHERE site = 11 WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)", ("anom",))
def rolling_and_line(spark, sf):
    from pyspark.sql import Window
    lines = V.table(spark, sf, "lineitem").where("l_suppkey = 11")
    p = P.monthly_panel(lines, "l_suppkey", "l_shipdate", "l_extendedprice")
    a = cut_lineage(P.gated_anomalies(p, ["site"], V.BASELINE, V.WINDOW, V.MIN_COVERAGE, calendar_bound=True))
    fit = P.ols_trend(a, ["site"]).select(F.struct("ols_slope", "ols_intercept").alias("f")).scalar()
    w = Window.orderBy("month").rowsBetween(-6, 5)  # one site: bounded by the calendar
    return a.select(F.date_format("month", "yyyy-MM-dd").alias("month"), r6("anomaly").alias("anomaly"), r6(F.when(F.count("*").over(w) == 12, F.avg("anomaly").over(w))).alias("rolling"),
                    r6(fit["ols_intercept"] + fit["ols_slope"] * C.decimal_decades("month")).alias("line"))


@query("V9_map_join", "SELECT u.unit, round(t.warming, 6) AS warming, round(t.lat, 6)+0.0 AS lat FROM units u LEFT JOIN natrend t ON t.nk = u.nk", ("units", "natrend"))
def map_join(spark, sf):
    return V.units(spark, sf).join(V.natrend(spark, sf), "nk", "left").select("unit", F.round("warming", 6).alias("warming"), r6("lat").alias("lat"))


@query("V10_sorted_table", "SELECT u.unit, round(t.warming, 6) AS warming FROM units u JOIN natrend t ON t.nk = u.nk ORDER BY t.warming DESC, u.unit", ("units", "natrend"))
def sorted_table(spark, sf):
    return V.units(spark, sf).join(V.natrend(spark, sf), "nk").orderBy(F.desc("warming"), "unit").select("unit", F.round("warming", 6).alias("warming"))


CODES = "SELECT ilat, ilon, CAST(CASE WHEN nk IS NULL THEN 0 ELSE nk + 1 END AS BIGINT) AS code FROM mask"


def _image_cells(spark, sf, zipped):
    """Zone codes written as one image per latitude row by the task that owns it, then read back."""
    field = V.mask(spark, sf).select("ilat", "ilon", "clat", F.coalesce(F.col("nk") + 1, F.lit(0)).alias("code"))
    folder = T.shared_folder(spark, "image")
    GR.write_files(GR.band_images(field, 10.0, 36, zipped), "ilat", folder)
    cells = GR.read_geotiff(spark, folder, "band.tif" if zipped else None)
    return cells.select(F.round((F.col("lat") + 85.0) / 10.0).cast("bigint").alias("ilat"), F.round((F.col("lon") + 175.0) / 10.0).cast("bigint").alias("ilon"), "code")


@query("S22_geotiff_scan", CODES, ("mask",))
def geotiff_scan(spark, sf):
    return _image_cells(spark, sf, False)


@query("S23_zip_member_scan", CODES, ("mask",))
def zip_member_scan(spark, sf):
    return _image_cells(spark, sf, True)


@query("S26_verified_source", "SELECT count(*) AS n FROM supplier")
def verified_source(spark, sf):
    pinned = T.file_manifest(spark, f"{sf}/supplier.parquet").select("sha256").collect()[0][0]
    T.verify_checksum(spark, f"{sf}/supplier.parquet", pinned)
    return V.table(spark, sf, "supplier").agg(F.count("*").alias("n"))


@query("S32_cached_field", "SELECT ilat, ilon, round(slope, 6)+0.0 AS slope FROM cellfit", ("cellfit",))
def cached_field(spark, sf):
    folder = T.shared_folder(spark, "field")
    V.cellfit(spark, sf).write.parquet(folder)
    return T.read_required(spark, folder, ["ilat", "ilon", "slope"]).withColumn("slope", r6("slope"))


_ORDERS = """w AS (SELECT site, nk, lat, lon, row_number() OVER (ORDER BY nk, lat, lon, site) - 1 AS ident, row_number() OVER (ORDER BY site) - 1 AS ser, row_number() OVER (ORDER BY nk, site) - 1 AS grp, count(*) OVER () AS n FROM {src}),
 named AS (SELECT 'serialized' AS order_name, site, ident, lpad(CAST(ser AS VARCHAR), 20, '0') AS by_ FROM w UNION ALL SELECT 'group_first', site, ident, lpad(CAST(grp AS VARCHAR), 20, '0') FROM w
   UNION ALL SELECT 'identity_sorted', site, ident, lpad(CAST(ident AS VARCHAR), 20, '0') FROM w UNION ALL SELECT 'reverse_identity', site, ident, lpad(CAST(n - 1 - ident AS VARCHAR), 20, '0') FROM w
   UNION ALL SELECT 'seed_' || s, site, ident, md5(s || '|' || site) FROM w, (SELECT unnest(range(10)) AS s)),
 ord AS (SELECT order_name, site, ident, row_number() OVER (PARTITION BY order_name ORDER BY by_, ident) - 1 AS pos FROM named)"""


def _orders(units):
    return RO.row_orders(units.select("site", "nk", "lat", "lon"), "site", ["site"], ["nk"], ["nk", "lat", "lon", "site"])


@query("T10_row_orders", f"""WITH {_ORDERS.format(src='sites')} SELECT order_name, count(*) AS n, CAST(sum((pos + 1)*site) AS BIGINT) AS checksum, CAST(arg_min(site, pos) AS BIGINT) AS first_site,
 CAST(arg_max(site, pos) AS BIGINT) AS last_site, count(*) FILTER (pos = ident) AS n_in_place FROM ord GROUP BY 1""", ("sites",))
def row_orders(spark, sf):
    o = _orders(V.sites(spark, sf))
    return o.groupBy("order_name").agg(
        F.count("*").alias("n"), F.sum((F.col("position") + 1) * F.col("site")).cast("bigint").alias("checksum"), F.min_by("site", "position").cast("bigint").alias("first_site"),
        F.max_by("site", "position").cast("bigint").alias("last_site"), F.count_if(F.col("position") == F.col("identity")).alias("n_in_place"))


def _validation(spark, sf):
    u = cut_lineage(XP.site_values(spark, sf))
    return RO.order_validation(u, _orders(u), "site", "v")


VALIDATION = f"""{_ORDERS.format(src='strend')}, {XP.dist_sql('strend', 'site', 'd')}, z AS (SELECT site, ols_slope - avg(ols_slope) OVER () AS z FROM strend), q AS (SELECT sum(z*z) AS q FROM z),
 names AS (SELECT DISTINCT order_name FROM ord),
 gp AS (SELECT 'position' AS policy, order_name, i, j FROM (SELECT o.order_name, d.i, d.j, row_number() OVER (PARTITION BY o.order_name, d.i ORDER BY round(d.km, 4), o.pos) AS rk FROM d JOIN ord o ON o.site = d.j) WHERE rk <= 8),
 gi AS (SELECT 'identity' AS policy, order_name, i, j FROM (SELECT d.i, d.j, row_number() OVER (PARTITION BY d.i ORDER BY round(d.km, 4), w.ident) AS rk FROM d JOIN w ON w.site = d.j), names WHERE rk <= 8),
 g AS (SELECT * FROM gp UNION ALL SELECT * FROM gi),
 same AS (SELECT a.policy, a.order_name, a.i, count(b.j) AS c FROM g a LEFT JOIN g b ON b.policy = a.policy AND b.order_name = 'serialized' AND b.i = a.i AND b.j = a.j GROUP BY 1, 2, 3),
 ov AS (SELECT policy, order_name, count(*) FILTER (c < 8) AS changed_rows, avg(c/8.0) AS mean_overlap FROM same GROUP BY 1, 2),
 perm AS (SELECT draw, slot, row_number() OVER (PARTITION BY draw ORDER BY md5('0|' || draw || '|' || slot), slot) - 1 AS source FROM (SELECT ident AS slot FROM w), (SELECT unnest(range(1, 200)) AS draw)),
 ix AS (SELECT 'positional' AS randomization, order_name, site, pos AS slot FROM ord UNION ALL SELECT 'identity', order_name, site, ident FROM ord),
 vals AS (SELECT a.randomization, a.order_name, p.draw, a.site, z.z AS v FROM ix a JOIN perm p ON p.slot = a.slot JOIN ix b ON b.randomization = a.randomization AND b.order_name = a.order_name AND b.slot = p.source JOIN z ON z.site = b.site),
 st AS (SELECT g.policy, g.order_name, a.randomization, a.draw, sum(a.v*b.v)/8/any_value(q.q) AS s FROM g JOIN vals a ON a.order_name = g.order_name AND a.site = g.i JOIN vals b ON b.order_name = g.order_name AND b.randomization = a.randomization AND b.draw = a.draw AND b.site = g.j, q GROUP BY 1, 2, 3, 4),
 ob AS (SELECT g.policy, g.order_name, sum(a.z*b.z)/8/any_value(q.q) AS moran FROM g JOIN z a ON a.site = g.i JOIN z b ON b.site = g.j, q GROUP BY 1, 2),
 pv AS (SELECT st.policy, st.order_name, st.randomization, any_value(ob.moran) AS moran, (count(*) FILTER (abs(s) >= abs(ob.moran) - 1e-12) + 1)/200.0 AS p_value FROM st JOIN ob USING (policy, order_name) GROUP BY 1, 2, 3)"""


@query("P17_order_validation", f"WITH {VALIDATION} SELECT policy, order_name, randomization, round(moran, 6)+0.0 AS moran, p_value, p_value < 0.05 AS rejects, changed_rows, round(mean_overlap, 6) AS mean_overlap FROM pv JOIN ov USING (policy, order_name)", ("strend",))
def order_validation(spark, sf):
    return _validation(spark, sf).select(
        "policy", "order_name", "randomization", C.r6("moran").alias("moran"), "p_value", "rejects", "changed_rows", F.round("mean_overlap", 6).alias("mean_overlap"))


@query("P17_order_acceptance", f"""WITH {VALIDATION}, f AS (SELECT * FROM pv JOIN ov USING (policy, order_name) WHERE policy = 'identity' AND randomization = 'identity')
 SELECT count(*) AS n_orders, sum(changed_rows) = 0 AS graph_identical, max(moran) - min(moran) <= 1e-12 AS i_equal, count(DISTINCT p_value) = 1 AS p_exact,
   sum(changed_rows) = 0 AND max(moran) - min(moran) <= 1e-12 AND count(DISTINCT p_value) = 1 AS accepted FROM f""", ("strend",))
def order_acceptance(spark, sf):
    return RO.acceptance(_validation(spark, sf)).select("n_orders", "graph_identical", (F.col("i_range") <= 1e-12).alias("i_equal"), "p_exact", "accepted")
