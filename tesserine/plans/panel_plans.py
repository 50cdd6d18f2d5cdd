"""Scans, cleaning, panels and per-key trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions import columns as C
from tesserine.operators import panel as P
from tesserine.operators.ordering import quantiles, row_ids
from tesserine.operators.robust import theil_sen
from tesserine.plans import views as V
from tesserine.plans.registry import query
from tesserine.sources import tables as S

r6 = C.r6
SITE_XY = """CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END"""


def _raw_locations(spark, sf):
    """Monthly location series in its raw text layout, derived from the fact table."""
    return (
        V.panel(spark, sf).join(V.sites(spark, sf), "site").join(V.units(spark, sf), "nk")
        .select(
            F.col("month").alias("dt"), "value", (F.col("value") / F.col("n")).alias("uncertainty"),
            F.concat(F.lit("place "), F.col("site") % 40).alias("place"), "unit",
            F.concat(F.abs("lat").cast("decimal(10,2)").cast("string"), C.hemisphere("lat")).alias("latitude"),
            F.concat(F.abs("lon").cast("decimal(10,2)").cast("string"),
                     F.when(F.col("lon") >= 0, "E").otherwise("W")).alias("longitude"),
        )
    )


RAW_SQL = """raw AS (SELECT p.month AS dt, p.value, p.value / p.n AS uncertainty,
    'place ' || CAST(s.site % 40 AS VARCHAR) AS place, u.unit, s.lat AS latitude, s.lon AS longitude
    FROM panel p JOIN sites s ON s.site = p.site JOIN units u ON u.nk = s.nk)"""
RAW_VIEWS = ("panel", "sites", "units")


def _csv_round_trip(spark, sf):
    folder = S.shared_folder(spark, "locations")
    _raw_locations(spark, sf).write.option("header", "true").csv(folder)
    return S.read_csv(spark, folder, S.LOCATION_CSV)


@query("S1_csv_scan", f"""WITH {RAW_SQL}
SELECT unit, count(*) AS n_rows, round(sum(value), 4) + 0.0 AS total FROM raw GROUP BY unit""", RAW_VIEWS)
def csv_scan(spark, sf):
    raw = _csv_round_trip(spark, sf)
    raw.createOrReplaceTempView("raw_locations")
    return spark.sql("SELECT unit, count(*) AS n_rows, round(sum(value), 4) + 0.0D AS total FROM raw_locations GROUP BY unit")


@query("S2_ingest", f"""WITH {RAW_SQL}
SELECT unit, place, latitude, longitude, count(*) AS n_rows, strftime(min(dt), '%Y-%m-%d') AS first_month,
 round(max(value), 6) + 0.0 AS top_value FROM raw GROUP BY 1, 2, 3, 4""", RAW_VIEWS)
def ingest(spark, sf):
    return S.ingest_locations(_csv_round_trip(spark, sf)).groupBy("unit", "place", "latitude", "longitude").agg(
        F.count("*").alias("n_rows"), F.date_format(F.min("dt"), "yyyy-MM-dd").alias("first_month"),
        r6(F.max("value")).alias("top_value"))


@query("S3_ingest_summary", f"""WITH {RAW_SQL}
SELECT count(*) AS n_rows, count(DISTINCT (place, unit)) AS n_places, strftime(min(dt), '%Y-%m-%d') AS dt_min,
 strftime(max(dt), '%Y-%m-%d') AS dt_max FROM raw""", RAW_VIEWS)
def ingest_summary(spark, sf):
    return S.ingest_summary(S.ingest_locations(_raw_locations(spark, sf)))


@query("S4_distinct_then_map", "SELECT CAST(lat AS DOUBLE) AS latitude, count(*) AS n FROM sites GROUP BY 1", ("sites",))
def distinct_then_map(spark, sf):
    text = V.sites(spark, sf).select(F.concat(F.abs("lat").cast("decimal(10,2)").cast("string"), C.hemisphere("lat")).alias("raw"))
    parsed = text.distinct().select("raw", C.parse_coordinate("raw", 90.0).alias("latitude"))
    return text.join(parsed, "raw").groupBy("latitude").agg(F.count("*").alias("n"))


TREND_SCHEMA = T.StructType([
    T.StructField("site", T.LongType()), T.StructField("n_obs", T.LongType()),
    T.StructField("ols_slope", T.DoubleType()), T.StructField("window", T.StringType())])


@query("S5_typed_ordered_sink", """SELECT site, n_obs, round(ols_slope, 6) + 0.0 AS ols_slope,
 '1995-02-01..2001-10-01' AS "window" FROM trend""", ("trend",))
def typed_sink(spark, sf):
    folder = S.shared_folder(spark, "trends")
    frame = V.trend(spark, sf).withColumn("window", F.lit("1995-02-01..2001-10-01")).withColumn("ols_slope", r6("ols_slope"))
    S.write_typed(frame, folder, TREND_SCHEMA, ["site"])
    return S.read_required(spark, folder, TREND_SCHEMA.names)


@query("S6_significant_figures", """SELECT nk, CAST(printf('%.9e', mean_acct) AS DOUBLE) AS mean_acct FROM
 (SELECT CAST(c_nationkey AS BIGINT) AS nk, CAST(sum(CAST(floor(c_acctbal*100+0.5) AS BIGINT)) AS DOUBLE)/count(*)/700.0 AS mean_acct
  FROM customer GROUP BY 1)""")
def significant_figures(spark, sf):
    return (V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nk"))
            .agg((F.sum(P.cents("c_acctbal")).cast("double") / F.count("*") / 700.0).alias("m"))
            .select("nk", C.significant("m").alias("mean_acct")))


@query("S7_stored_table_read", "SELECT nk, count(*) AS n FROM sites GROUP BY nk", ("sites",))
def stored_table(spark, sf):
    folder = S.shared_folder(spark, "sites")
    V.sites(spark, sf).write.parquet(folder)
    return spark.read.parquet(folder).groupBy("nk").agg(F.count("*").alias("n"))


@query("S8_frame_as_relation", """SELECT moy, count(*) AS n, round(avg(climatology), 6) + 0.0 AS mean_clim FROM clim GROUP BY moy""", ("clim",))
def frame_as_relation(spark, sf):
    base = P.climatology(V.panel(spark, sf, V.BASELINE), ["site"], *V.BASELINE)
    return spark.sql("SELECT moy, count(*) AS n, round(avg(climatology), 6) + 0.0D AS mean_clim FROM {base} GROUP BY moy", base=base)


@query("S11_recursive_locate", "SELECT count(*) AS n_rows, count(DISTINCT nk) AS n_units FROM sites", ("sites",))
def recursive_locate(spark, sf):
    folder = S.shared_folder(spark, "tree")
    V.sites(spark, sf).write.parquet(f"{folder}/deep/er")
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
            .agg(F.count("*").alias("n_rows"), F.count_distinct("nk").alias("n_units")))


@query("S12_column_subset", """SELECT unit, yr, round(production, 6) + 0.0 AS production FROM emis""", ("emis",))
def column_subset(spark, sf):
    return V.emis(spark, sf).select("unit", "yr", r6("production").alias("production"))


@query("S13_rename_select", "SELECT unit AS country, zone AS continent FROM units", ("units",))
def rename_select(spark, sf):
    return V.units(spark, sf).withColumnsRenamed({"unit": "country", "zone": "continent"}).select("country", "continent")


@query("S14_latest_per_entity", """SELECT o_custkey AS entity, max(year(o_orderdate)) AS yr,
 arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS class FROM orders GROUP BY 1""")
def latest_per_entity(spark, sf):
    latest = F.struct("o_orderdate", "o_orderkey")
    return V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.year(F.max("o_orderdate")).cast("bigint").alias("yr"), F.max_by("o_orderpriority", latest).alias("class"))


@query("S15_tab_lookup", """SELECT nk AS code, upper(substr(unit, 1, 3)) AS iso3 FROM units WHERE zone <> 'EUROPE'""", ("units",))
def tab_lookup(spark, sf):
    folder = S.shared_folder(spark, "codes")
    V.units(spark, sf).select(
        F.col("nk").alias("code"), F.when(F.col("zone") != "EUROPE", F.upper(F.substring("unit", 1, 3))).otherwise(" ").alias("iso3")
    ).write.option("sep", "\t").option("header", "true").option("ignoreTrailingWhiteSpace", "false").csv(folder)
    return S.read_codes(spark, folder)


@query("S16_titled_csv", """SELECT CAST(yr AS BIGINT) AS yr, CAST(sum(n) AS BIGINT) AS n FROM (SELECT year(month) AS yr, n FROM panel) GROUP BY 1""", ("panel",))
def titled_csv(spark, sf):
    folder = S.shared_folder(spark, "titled")
    yearly = V.panel(spark, sf).groupBy(F.year("month").cast("bigint").alias("yr")).agg(F.sum("n").alias("n"))
    (yearly.select(F.concat_ws("\n", F.lit("Title: yearly counts"), F.lit("yr,n"), F.concat_ws(",", "yr", "n")).alias("value"))
     .write.text(folder))
    schema = T.StructType([T.StructField("yr", T.LongType()), T.StructField("n", T.LongType())])
    return S.read_titled_csv(spark, folder, schema, "Title")


@query("S17_whitespace_table", """SELECT CAST(yr AS BIGINT) AS yr, CASE WHEN yr % 2 = 0 THEN NULL ELSE round(CAST(n AS DOUBLE), 1) END AS n FROM
 (SELECT year(month) AS yr, sum(n) AS n FROM panel GROUP BY 1)""", ("panel",))
def whitespace_table(spark, sf):
    folder = S.shared_folder(spark, "blank")
    yearly = V.panel(spark, sf).groupBy(F.year("month").cast("bigint").alias("yr")).agg(F.sum("n").alias("n"))
    shown = F.when(F.col("yr") % 2 == 0, F.lit("***")).otherwise(F.col("n").cast("string"))
    yearly.select(F.concat(F.lit("  "), F.col("yr").cast("string"), F.lit("    "), shown).alias("value")).write.text(folder)
    schema = T.StructType([T.StructField("yr", T.LongType()), T.StructField("n", T.DoubleType())])
    return S.read_whitespace_table(spark, folder, schema)


@query("S28_required_columns", "SELECT site, n_obs FROM trend", ("trend",))
def required_columns(spark, sf):
    folder = S.shared_folder(spark, "required")
    V.trend(spark, sf).write.parquet(folder)
    return S.read_required(spark, folder, ["site", "n_obs"])


@query("S29_optional_source", "SELECT count(*) AS n_present, CAST(0 AS BIGINT) AS n_absent FROM sites", ("sites",))
def optional_source(spark, sf):
    present = S.read_optional(spark, f"{sf}/supplier.parquet")
    absent = S.read_optional(spark, f"{sf}/no_such_table.parquet")
    return present.agg(F.count("*").alias("n_present"), F.lit(0 if absent is None else 1).cast("bigint").alias("n_absent"))


@query("S30_compressed_copy", "SELECT nk, count(*) AS n, round(sum(acct), 2) + 0.0 AS acct FROM sites GROUP BY nk", ("sites",))
def compressed_copy(spark, sf):
    folder = S.shared_folder(spark, "copy")
    V.sites(spark, sf).write.option("compression", "zstd").parquet(folder)
    return S.read_required(spark, folder, ["nk", "acct"]).groupBy("nk").agg(
        F.count("*").alias("n"), r6(F.sum("acct"), 2).alias("acct"))


@query("S33_line_json_log", "SELECT site AS draw, n_obs FROM trend", ("trend",))
def line_json_log(spark, sf):
    folder = S.shared_folder(spark, "log")
    V.trend(spark, sf).select(F.col("site").alias("draw"), "n_obs").write.json(folder)
    return spark.read.schema("draw bigint, n_obs bigint").json(folder)


@query("S34_fill_count", """SELECT ilat, ilon, count(*) AS n_months, count(*) FILTER (WHERE n = 1) AS n_fill FROM cells GROUP BY 1, 2""", ("cells",))
def fill_count(spark, sf):
    return V.cells(spark, sf).groupBy("ilat", "ilon").agg(
        F.count("*").alias("n_months"), F.count_if(F.col("n") == 1).alias("n_fill"))


@query("S35_long_to_grid", """SELECT ilat, """ + ", ".join(
    f"round(max(CASE WHEN ilon = {j} THEN mean_value END), 6) + 0.0 AS lon_{j}" for j in range(36)) + " FROM cellfit GROUP BY 1", ("cellfit",))
def long_to_grid(spark, sf):
    # The axis is fixed (36 columns), so the pivot needs no extra pass to find its values.
    wide = V.cellfit(spark, sf).groupBy("ilat").pivot("ilon", list(range(36))).agg(r6(F.first("mean_value")))
    return wide.select("ilat", *[F.col(str(j)).alias(f"lon_{j}") for j in range(36)])


# -- scalar cleaning ----------------------------------------------------------

@query("F1_parse_coordinate", "SELECT site, lat AS latitude FROM sites", ("sites",))
def parse_coordinate(spark, sf):
    text = F.concat(F.lit(" "), F.abs("lat").cast("string"), F.lower(C.hemisphere("lat")))
    return V.sites(spark, sf).select("site", C.parse_coordinate(text).alias("latitude"))


@query("F2_bounded_coordinates", "SELECT site, lat AS latitude, lon AS longitude FROM sites", ("sites",))
def bounded_coordinates(spark, sf):
    ew = F.when(F.col("lon") >= 0, "E").otherwise("W")
    return V.sites(spark, sf).select(
        "site", C.parse_coordinate(F.concat(F.abs("lat").cast("string"), C.hemisphere("lat")), 90.0).alias("latitude"),
        C.parse_coordinate(F.concat(F.abs("lon").cast("string"), ew), 180.0).alias("longitude"))


@query("F3_decimal_decades", """SELECT round((year(month) + (month(month) - 0.5) / 12.0) / 10.0, 6) AS decades, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY 1""", ("panel",))
def decimal_decades(spark, sf):
    return V.panel(spark, sf).groupBy(F.round(C.decimal_decades("month"), 6).alias("decades")).agg(F.sum("n").alias("n"))


@query("F4_parse_window", """SELECT count(*) AS n, CAST(81 AS BIGINT) AS n_months FROM lineitem
 WHERE l_shipdate >= DATE '1995-02-01' AND l_shipdate < DATE '2001-11-01'""")
def parse_window(spark, sf):
    start, end = C.parse_window("1995-02-01..2001-10-31")
    return V.table(spark, sf, "lineitem").where(
        (F.col("l_shipdate") >= F.lit(start)) & (F.col("l_shipdate") < F.lit(end + dt.timedelta(days=1)))
    ).agg(F.count("*").alias("n"), F.lit(C.months_in_window(start, end)).cast("bigint").alias("n_months"))


@query("F5_date_parts", """SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, CAST(month(l_shipdate) AS BIGINT) AS moy, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def date_parts(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(
        F.year("l_shipdate").cast("bigint").alias("yr"), F.month("l_shipdate").cast("bigint").alias("moy")).agg(F.count("*").alias("n"))


@query("F6_window_filter", """SELECT l_returnflag, count(*) AS n FROM lineitem
 WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-01' GROUP BY 1""")
def window_filter(spark, sf):
    return V.table(spark, sf, "lineitem").where(
        C.in_window("l_shipdate", dt.date(1996, 1, 1), dt.date(1998, 12, 1))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("F7_bound_parameters", """SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value FROM events
 WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND value IS NOT NULL GROUP BY 1""")
def bound_parameters(spark, sf):
    return spark.sql(
        """SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0D AS mean_value FROM {events}
           WHERE ts BETWEEN to_timestamp_ntz(:a) AND to_timestamp_ntz(:b) AND value IS NOT NULL GROUP BY event_type""",
        args={"a": "2024-01-05 00:00:00", "b": "2024-01-20 00:00:00"}, events=V.table(spark, sf, "events"))


@query("F8_latitude_features", """SELECT site, abs(lat) AS abs_latitude, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere FROM sites""", ("sites",))
def latitude_features(spark, sf):
    return V.sites(spark, sf).select("site", F.abs("lat").alias("abs_latitude"), C.hemisphere("lat").alias("hemisphere"))


@query("F9_class_mapping", """SELECT p_partkey AS part, CASE CAST(substr(p_brand, 7, 1) AS INTEGER) WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' END AS class FROM part""")
def class_mapping(spark, sf):
    return V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), C.mapped(F.substring("p_brand", 7, 1).cast("int"), {1: "A", 2: "B", 3: "C"}).alias("class"))


SEGMENT_RANK = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}


@query("F10_ordinal_rank", """SELECT CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END AS BIGINT) AS tier, count(*) AS n FROM customer GROUP BY 1""")
def ordinal_rank(spark, sf):
    return V.table(spark, sf, "customer").groupBy(
        C.mapped("c_mktsegment", SEGMENT_RANK).cast("bigint").alias("tier")).agg(F.count("*").alias("n"))


@query("F11_name_override", """SELECT CASE p_brand WHEN 'Brand#11' THEN 'Eleven' WHEN 'Brand#22' THEN 'Twenty-two' ELSE p_brand END AS name, count(*) AS n FROM part GROUP BY 1""")
def name_override(spark, sf):
    name = C.mapped("p_brand", {"Brand#11": "Eleven", "Brand#22": "Twenty-two"}, default=F.col("p_brand"))
    return V.table(spark, sf, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("F12_exclude_aggregates", """SELECT code, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 9000 THEN ''
  WHEN c_acctbal > 7000 THEN 'AGG_' || c_mktsegment ELSE substr(c_mktsegment, 1, 3) END AS code FROM customer)
 WHERE code IS NOT NULL AND code <> '' AND NOT starts_with(code, 'AGG_') GROUP BY 1""")
def exclude_aggregates(spark, sf):
    k = F.col("c_acctbal")
    code = (F.when(k < 0, F.lit(None)).when(k > 9000, "").when(k > 7000, F.concat(F.lit("AGG_"), "c_mktsegment"))
            .otherwise(F.substring("c_mktsegment", 1, 3)))
    iso = F.coalesce("code", F.lit(""))
    return (V.table(spark, sf, "customer").select(code.alias("code")).where((iso != "") & ~iso.startswith("AGG_"))
            .groupBy("code").agg(F.count("*").alias("n")))


@query("F13_positive_log10", """SELECT s_suppkey AS site, round(log10(s_acctbal), 6) + 0.0 AS log_acct FROM supplier WHERE s_acctbal > 0""")
def positive_log10(spark, sf):
    return V.table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("site"), r6(F.log10("s_acctbal")).alias("log_acct"))


@query("F14_complete_cases", """SELECT yr, count(*) AS n, round(sum(production - consumption), 4) + 0.0 AS gap FROM emis
 WHERE consumption IS NOT NULL AND production IS NOT NULL GROUP BY yr""", ("emis",))
def complete_cases(spark, sf):
    return (V.emis(spark, sf).dropna(subset=["production", "consumption"]).groupBy("yr")
            .agg(F.count("*").alias("n"), r6(F.sum(F.col("production") - F.col("consumption")), 4).alias("gap")))


@query("F15_longitude_360", "SELECT site, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS lon360 FROM sites", ("sites",))
def longitude_360(spark, sf):
    return V.sites(spark, sf).select("site", C.lon_to_360("lon").alias("lon360"))


@query("F16_longitude_180", "SELECT site, CASE WHEN l >= 180 THEN l - 360 ELSE l END AS lon180 FROM (SELECT site, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS l FROM sites)", ("sites",))
def longitude_180(spark, sf):
    return V.sites(spark, sf).select("site", C.lon_to_180(C.lon_to_360("lon")).alias("lon180"))


@query("F17_fractional_year", "SELECT strftime(month, '%Y-%m-%d') AS month, CAST(sum(n) AS BIGINT) AS n FROM panel GROUP BY 1", ("panel",))
def fractional_year(spark, sf):
    stamp = F.year("month") + (F.month("month") - 0.5) / 12.0
    return (V.panel(spark, sf).groupBy(F.date_format(C.fractional_year_to_month(stamp), "yyyy-MM-dd").alias("month"))
            .agg(F.sum("n").alias("n")))


@query("F18_month_floor", "SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def month_floor(spark, sf):
    return V.table(spark, sf, "events").groupBy(
        F.date_format(F.trunc(F.col("ts").cast("date"), "month"), "yyyy-MM-dd").alias("month"), "event_type").agg(F.count("*").alias("n"))


@query("F19_axis_summary", """SELECT min(clat) AS lat_min, max(clat) AS lat_max, min(clon) AS lon_min, max(clon) AS lon_max,
 min_by(clat, ilat) < max_by(clat, ilat) AS lat_ascending, max(clon) > 180 AS lon_is_360 FROM mask""", ("mask",))
def axis_summary(spark, sf):
    return V.mask(spark, sf).agg(
        F.min("clat").alias("lat_min"), F.max("clat").alias("lat_max"), F.min("clon").alias("lon_min"), F.max("clon").alias("lon_max"),
        (F.min_by("clat", "ilat") < F.max_by("clat", "ilat")).alias("lat_ascending"), (F.max("clon") > 180).alias("lon_is_360"))


@query("F20_unique_labels", """SELECT site, CASE WHEN count(*) OVER (PARTITION BY nk, site % 3) > 1
 THEN 'place ' || CAST(site % 3 AS VARCHAR) || printf(' (%.2f, %.2f)', lat, lon) ELSE 'place ' || CAST(site % 3 AS VARCHAR) END AS label FROM sites""", ("sites",))
def unique_labels(spark, sf):
    named = V.sites(spark, sf).withColumn("place", F.concat(F.lit("place "), F.col("site") % 3))
    # Count names with a partial aggregate, then attach: a name shared by many rows is not gathered.
    counts = named.groupBy("nk", "place").agg(F.count("*").alias("_same"))
    return named.join(counts, ["nk", "place"]).select("site", F.when(
        F.col("_same") > 1, F.format_string("%s (%.2f, %.2f)", "place", "lat", "lon")).otherwise(F.col("place")).alias("label"))


@query("F21_marker_to_null", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value <= 400) AS n_valid, round(sum(CASE WHEN value <= 400 THEN value END), 4) + 0.0 AS total FROM events GROUP BY 1")
def marker_to_null(spark, sf):
    text = F.when(F.col("value") > 400, "***").otherwise(F.col("value").cast("string"))
    return (V.table(spark, sf, "events").withColumn("v", text.try_cast("double")).groupBy("event_type")
            .agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), r6(F.sum("v"), 4).alias("total")))


@query("F22_mid_year_floor", "SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n FROM orders GROUP BY 1")
def mid_year_floor(spark, sf):
    return V.table(spark, sf, "orders").groupBy(F.floor(F.year("o_orderdate") + 0.5).cast("bigint").alias("yr")).agg(F.count("*").alias("n"))


@query("F23_status_column", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'revised' END AS status
 FROM (SELECT sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END) AS a, sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END) AS b
 FROM lineitem GROUP BY l_partkey, l_suppkey)) GROUP BY 1""")
def status_column(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    both = V.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", q)).alias("a"), F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("b"))
    status = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("revised"))
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


KNOT_SQL = """k AS (SELECT min(abs(lat)) AS k0, quantile_cont(abs(lat), 1.0/3) AS k1, quantile_cont(abs(lat), 2.0/3) AS k2, max(abs(lat)) AS k3 FROM sites)"""


def _knots(s):
    """Training knots: extremes and exact tertiles of `a`."""
    return quantiles(s, "a", (0.0, 1 / 3, 2 / 3, 1.0), ("k0", "k1", "k2", "k3"))


@query("F24_cubic_basis", f"""WITH {KNOT_SQL}, b AS (SELECT site, lat, abs(lat) AS a, k.* FROM sites, k),
c AS (SELECT site, lat, a, k0, k1, k2, k3, greatest(a-k0, 0)**3 AS c0, greatest(a-k1, 0)**3 AS c1, greatest(a-k2, 0)**3 AS c2, greatest(a-k3, 0)**3 AS c3 FROM b)
SELECT site, round((c0-c3)/(k3-k0) - (c2-c3)/(k3-k2), 6) + 0.0 AS basis_1, round((c1-c3)/(k3-k1) - (c2-c3)/(k3-k2), 6) + 0.0 AS basis_2,
 CASE WHEN lat < 0 THEN a ELSE 0.0 END AS south_slope FROM c""", ("sites",))
def cubic_basis(spark, sf):
    s = V.sites(spark, sf).withColumn("a", F.abs("lat"))
    state = _knots(s).select(F.struct("k0", "k1", "k2", "k3")).scalar()
    knots = [state[f"k{i}"] for i in range(4)]
    c1, c2 = C.natural_cubic_columns("a", knots)
    return s.select("site", r6(c1).alias("basis_1"), r6(c2).alias("basis_2"), F.when(F.col("lat") < 0, F.col("a")).otherwise(0.0).alias("south_slope"))


@query("F25_knot_state", f"WITH {KNOT_SQL} SELECT round(k0,6) AS k0, round(k1,6) AS k1, round(k2,6) AS k2, round(k3,6) AS k3, (SELECT count(*) FROM sites) AS n_train FROM k", ("sites",))
def knot_state(spark, sf):
    s = V.sites(spark, sf).withColumn("a", F.abs("lat"))
    return _knots(s).select(*[r6(f"k{i}").alias(f"k{i}") for i in range(4)], s.agg(F.count("*")).scalar().alias("n_train"))


@query("F26_cell_state", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN nk IS NULL THEN 'masked' WHEN n_months = 0 THEN 'empty'
 WHEN n_months >= 80 THEN 'complete' ELSE 'partial' END AS state FROM zonal) GROUP BY 1""", ("zonal",))
def cell_state(spark, sf):
    state = (F.when(F.col("nk").isNull(), "masked").when(F.col("n_months") == 0, "empty").when(F.col("n_months") >= 80, "complete").otherwise("partial"))
    return V.zonal(spark, sf).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


R = C.EARTH_RADIUS_KM


@query("F27_cell_area", f"""SELECT ilat, ilon, round({R}*{R}*radians(10)*(sin(radians(clat+5)) - sin(radians(clat-5))), 3) AS area_km2 FROM mask""", ("mask",))
def cell_area(spark, sf):
    return V.mask(spark, sf).select("ilat", "ilon", F.round(C.band_cell_area_km2(F.col("clat") - 5, F.col("clat") + 5, 10.0), 3).alias("area_km2"))


@query("F28_unit_sphere", """SELECT site, round(cos(radians(lat))*cos(radians(lon)),6)+0.0 AS x, round(cos(radians(lat))*sin(radians(lon)),6)+0.0 AS y, round(sin(radians(lat)),6)+0.0 AS z FROM sites""", ("sites",))
def unit_sphere(spark, sf):
    x, y, z = C.unit_xyz("lat", "lon")
    return V.sites(spark, sf).select("site", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


HAV = lambda a1, o1, a2, o2: (
    f"2*{R}*asin(sqrt(least(greatest(pow(sin(radians({a2}-({a1}))/2),2)+cos(radians({a1}))*cos(radians({a2}))*pow(sin(radians({o2}-({o1}))/2),2),0.0),1.0)))")


@query("F29_great_circle", f"""SELECT site, round({HAV('lat', 'lon', '51.5', '-0.125')}, 4) AS km FROM sites""", ("sites",))
def great_circle(spark, sf):
    return V.sites(spark, sf).select("site", F.round(C.haversine_km("lat", "lon", F.lit(51.5), F.lit(-0.125)), 4).alias("km"))


@query("F30_earth_centred", f"""SELECT site, round(n*cos(radians(lat))*cos(radians(lon)),5)+0.0 AS x, round(n*cos(radians(lat))*sin(radians(lon)),5)+0.0 AS y,
 round(n*(1-e2)*sin(radians(lat)),5)+0.0 AS z FROM (SELECT site, lat, lon, e2, {C.WGS84_A_KM}/sqrt(1-e2*pow(sin(radians(lat)),2)) AS n
 FROM sites, (SELECT (1/298.257223563::DOUBLE)*(2-1/298.257223563::DOUBLE) AS e2))""", ("sites",))
def earth_centred(spark, sf):
    x, y, z = C.ecef_km("lat", "lon")
    return V.sites(spark, sf).select("site", r6(x, 5).alias("x"), r6(y, 5).alias("y"), r6(z, 5).alias("z"))


@query("F31_chord_to_km", f"""SELECT site, round(2*{R}*asin(least(abs(lat)/90.0/2, 1.0)), 4) AS km FROM sites""", ("sites",))
def chord_to_km(spark, sf):
    return V.sites(spark, sf).select("site", F.round(C.chord_to_km(F.abs("lat") / 90.0), 4).alias("km"))


@query("F32_cell_of_point", """SELECT site, CAST(least(greatest(floor((lat+90)/10), 0), 17) AS BIGINT) AS ilat, CAST(least(greatest(floor((lon+180)/10), 0), 35) AS BIGINT) AS ilon FROM sites""", ("sites",))
def cell_of_point(spark, sf):
    return V.sites(spark, sf).select("site", C.cell_index("lat", -90.0, 10.0, 18).alias("ilat"), C.cell_index("lon", -180.0, 10.0, 36).alias("ilon"))


@query("F33_float_slimming", "SELECT site, round(CAST(CAST(acct AS FLOAT) AS DOUBLE), 2) AS acct FROM sites", ("sites",))
def float_slimming(spark, sf):
    return V.sites(spark, sf).select("site", F.round(F.col("acct").cast("float").cast("double"), 2).alias("acct"))


# -- panel and trend ----------------------------------------------------------

@query("A1_climatology", "SELECT site, moy, round(climatology, 6) + 0.0 AS climatology FROM clim", ("clim",))
def climatology(spark, sf):
    return P.climatology(V.panel(spark, sf, V.BASELINE), ["site"], *V.BASELINE).select("site", "moy", r6("climatology").alias("climatology"))


@query("A2_coverage", "SELECT site, n_obs, n_possible, round(coverage, 6) AS coverage, coverage >= 0.99 AS keep FROM cover", ("cover",))
def coverage(spark, sf):
    return P.coverage(V.panel(spark, sf, V.WINDOW), ["site"], V.WINDOW, 0.99).withColumn("coverage", F.round("coverage", 6))


@query("A3_distinct_tuples", "SELECT count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus, l_suppkey)) AS n_keys, strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day FROM lineitem")
def distinct_tuples(spark, sf):
    return V.table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.count_distinct(F.struct("l_returnflag", "l_linestatus", "l_suppkey")).alias("n_keys"),
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_day"))


@query("W8_anomalies", "SELECT site, strftime(month, '%Y-%m-%d') AS month, round(anomaly, 6) + 0.0 AS anomaly FROM anom", ("anom",))
def anomalies(spark, sf):
    return V.anom(spark, sf).select("site", F.date_format("month", "yyyy-MM-dd").alias("month"), r6("anomaly").alias("anomaly"))


@query("J2_left_join_climatology", """SELECT p.site, CAST(month(p.month) AS BIGINT) AS moy, count(*) AS n, count(c.climatology) AS n_matched, round(sum(p.value - c.climatology), 4) + 0.0 AS total
 FROM panel p LEFT JOIN clim c ON c.site = p.site AND c.moy = month(p.month) WHERE p.month BETWEEN DATE '1995-02-01' AND DATE '2001-10-01' GROUP BY 1, 2""", ("clim",))
def left_join_climatology(spark, sf):
    return (P.anomalies(V.panel(spark, sf, V.WINDOW), ["site"], V.BASELINE, V.WINDOW).groupBy("site", "moy")
            .agg(F.count("*").alias("n"), F.count("climatology").alias("n_matched"), r6(F.sum("anomaly"), 4).alias("total")))


@query("J3_gate_semi_join", """SELECT p.site, count(*) AS n FROM panel p WHERE p.site IN (SELECT site FROM cover WHERE coverage >= 0.99) GROUP BY 1""", ("cover",))
def gate_semi_join(spark, sf):
    panel = V.panel(spark, sf)
    kept = P.coverage(V.panel(spark, sf, V.WINDOW), ["site"], V.WINDOW, 0.99).where("keep").select("site")
    return panel.join(kept, "site", "left_semi").groupBy("site").agg(F.count("*").alias("n"))


SLOPES_SQL = """sl AS (SELECT a.site, (b.anomaly-a.anomaly)/(b.x-a.x) AS s FROM anom a JOIN anom b ON a.site = b.site AND a.month < b.month),
sz AS (SELECT site, count(*) AS n, median(anomaly) AS my, median(x) AS mx, regr_slope(anomaly, x) AS ols FROM anom GROUP BY 1),
ty AS (SELECT site, sum(k*(k-1)*(2*k+5)) AS t FROM (SELECT site, anomaly, count(*) AS k FROM anom GROUP BY 1, 2) GROUP BY 1),
ls AS (SELECT site, list(s ORDER BY s) AS l, count(*) AS nt, median(s) AS slope FROM sl GROUP BY 1),
ts AS (SELECT z.site, z.n, l.slope, z.my, z.mx, z.ols, l.l, l.nt, 1.959963984540054*sqrt((z.n*(z.n-1)*(2*z.n+5) - t.t)/18.0) AS h
 FROM sz z JOIN ls l ON l.site = z.site JOIN ty t ON t.site = z.site)"""


@query("E1_robust_trend", f"""WITH {SLOPES_SQL} SELECT site, n AS n_obs, round(slope, 6)+0.0 AS slope,
 round(l[CAST(greatest(round_even((nt-h)/2, 0) - 1, 0) AS BIGINT) + 1], 6)+0.0 AS ci_low,
 round(l[CAST(least(round_even((nt+h)/2, 0), nt-1) AS BIGINT) + 1], 6)+0.0 AS ci_high, round(ols, 6)+0.0 AS ols_slope FROM ts""", ("anom",))
def robust_trend(spark, sf):
    series = V.anom(spark, sf)
    ols = F.regr_slope("anomaly", "x").alias("ols_slope")
    return theil_sen(series, ["site"], "x", "anomaly", calendar_bound=True, extra=[ols]).select(
        "site", F.col("n_points").alias("n_obs"), r6("slope").alias("slope"), r6("low").alias("ci_low"), r6("high").alias("ci_high"), r6("ols_slope").alias("ols_slope"))


@query("E2_intercept_check", f"""WITH {SLOPES_SQL} SELECT site, round(my - slope*mx, 6)+0.0 AS intercept, true AS refit_equal FROM ts""", ("anom",))
def intercept_check(spark, sf):
    series = V.anom(spark, sf)
    stored = theil_sen(series, ["site"], "x", "anomaly", calendar_bound=True).select("site", F.col("slope").alias("stored"))
    refit = theil_sen(series.repartition(16, "site", "month"), ["site"], "x", "anomaly", calendar_bound=True)
    return refit.join(stored, "site").select("site", r6("intercept").alias("intercept"), (F.abs(F.col("slope") - F.col("stored")) <= 1e-8).alias("refit_equal"))


def cell_slopes(spark, sf, min_fraction=0.6):
    """Robust slope per land cell with enough finite months."""
    cells = V.with_zone(V.cells(spark, sf, V.WINDOW)).where(F.col("nk").isNotNull()).withColumn("x", C.decimal_decades("month"))
    need = -(-C.months_in_window(*V.WINDOW) * min_fraction // 1)
    return theil_sen(cells, ["ilat", "ilon", "nk", "clat"], "x", "value", calendar_bound=True).where(F.col("n_points") >= need)


CELL_SQL = """cc AS (SELECT c.ilat, c.ilon, m.nk, m.clat, c.month, c.value, (year(c.month) + (month(c.month) - 0.5) / 12.0) / 10.0 AS x
 FROM cells c JOIN mask m ON m.ilat = c.ilat AND m.ilon = c.ilon WHERE m.nk IS NOT NULL AND c.month BETWEEN DATE '1995-02-01' AND DATE '2001-10-01'),
cs AS (SELECT a.ilat, a.ilon, median((b.value-a.value)/(b.x-a.x)) AS slope FROM cc a JOIN cc b ON a.ilat = b.ilat AND a.ilon = b.ilon AND a.month < b.month GROUP BY 1, 2),
cn AS (SELECT ilat, ilon, nk, clat, count(*) AS n FROM cc GROUP BY 1, 2, 3, 4 HAVING count(*) >= ceil(0.6*81)),
cf AS (SELECT cn.*, cs.slope FROM cn JOIN cs ON cs.ilat = cn.ilat AND cs.ilon = cn.ilon)"""


@query("E3_cell_trend", f"WITH {CELL_SQL} SELECT ilat, ilon, n AS n_points, round(slope, 6)+0.0 AS slope FROM cf", ("cells", "mask"))
def cell_trend(spark, sf):
    return cell_slopes(spark, sf).select("ilat", "ilon", "n_points", r6("slope").alias("slope"))


@query("E6_area_weighted_units", f"""WITH {CELL_SQL} SELECT nk, count(*) AS n_cells, round(sum(cos(radians(clat))*slope)/sum(cos(radians(clat))), 6)+0.0 AS slope FROM cf GROUP BY 1""", ("cells", "mask"))
def area_weighted_units(spark, sf):
    w = F.greatest(F.cos(F.radians("clat")), F.lit(0.0))
    return cell_slopes(spark, sf).groupBy("nk").agg(F.count("*").alias("n_cells"), r6(F.sum(w * F.col("slope")) / F.sum(w)).alias("slope"))


@query("E7_land_mean", f"""WITH {CELL_SQL} SELECT count(*) AS n_cells, round(sum(cos(radians(clat))*slope)/sum(cos(radians(clat))), 6)+0.0 AS land_mean FROM cf""", ("cells", "mask"))
def land_mean(spark, sf):
    w = F.greatest(F.cos(F.radians("clat")), F.lit(0.0))
    return cell_slopes(spark, sf).agg(F.count("*").alias("n_cells"), r6(F.sum(w * F.col("slope")) / F.sum(w)).alias("land_mean"))


E8 = CELL_SQL.replace("ceil(0.6*81)", "ceil(0.5*81)")


@query("E8_second_product_cells", f"WITH {E8} SELECT ilat, ilon, round(slope, 6)+0.0 AS slope FROM cf", ("cells", "mask"))
def second_product_cells(spark, sf):
    return cell_slopes(spark, sf, 0.5).select("ilat", "ilon", r6("slope").alias("slope"))


@query("E9_second_product_units", f"""WITH {E8}, a AS (SELECT nk, count(*) AS n_all FROM mask WHERE nk IS NOT NULL GROUP BY 1)
SELECT cf.nk, round(sum(cos(radians(clat))*slope)/sum(cos(radians(clat))), 6)+0.0 AS slope, round(count(*)/any_value(CAST(a.n_all AS DOUBLE)), 6) AS coverage FROM cf JOIN a ON a.nk = cf.nk GROUP BY 1""", ("cells", "mask"))
def second_product_units(spark, sf):
    w = F.greatest(F.cos(F.radians("clat")), F.lit(0.0))
    owned = V.mask(spark, sf).where("nk is not null").groupBy("nk").agg(F.count("*").alias("n_all"))
    return (cell_slopes(spark, sf, 0.5).groupBy("nk").agg(F.count("*").alias("_n"), r6(F.sum(w * F.col("slope")) / F.sum(w)).alias("slope"))
            .join(owned, "nk").select("nk", "slope", F.round(F.col("_n") / F.col("n_all").cast("double"), 6).alias("coverage")))


@query("E4_two_window_acceleration", f"""WITH early AS (SELECT * FROM anom WHERE month <= DATE '1998-06-01'),
 sl AS (SELECT a.site, median((b.anomaly-a.anomaly)/(b.x-a.x)) AS s FROM early a JOIN early b ON a.site = b.site AND a.month < b.month GROUP BY 1),
 fl AS (SELECT a.site, median((b.anomaly-a.anomaly)/(b.x-a.x)) AS s FROM anom a JOIN anom b ON a.site = b.site AND a.month < b.month GROUP BY 1),
 n AS (SELECT site, count(*) AS n FROM early GROUP BY 1 HAVING count(*) >= 36)
 SELECT sl.site, n.n AS n_early, round(sl.s, 6)+0.0 AS early_slope, round(fl.s, 6)+0.0 AS full_slope, round(fl.s - sl.s, 6)+0.0 AS delta FROM sl JOIN fl ON fl.site = sl.site JOIN n ON n.site = sl.site""", ("anom",))
def two_window_acceleration(spark, sf):
    series = V.anom(spark, sf)
    early = theil_sen(series.where(F.col("month") <= F.lit(dt.date(1998, 6, 1))), ["site"], "x", "anomaly", calendar_bound=True).where("n_points >= 36")
    full = theil_sen(series, ["site"], "x", "anomaly", calendar_bound=True).select("site", F.col("slope").alias("full"))
    return early.join(full, "site").select("site", F.col("n_points").alias("n_early"), r6("slope").alias("early_slope"), r6("full").alias("full_slope"), r6(F.col("full") - F.col("slope")).alias("delta"))


@query("E5_trend_table", f"""WITH {SLOPES_SQL} SELECT u.unit, count(*) AS n_sites, round(avg(ts.slope), 6)+0.0 AS mean_slope, round(avg(ts.ols), 6)+0.0 AS mean_ols,
 round(min(ts.n/81.0), 6) AS min_coverage, '1996-01-01..1998-12-01' AS baseline_window, '1995-02-01..2001-10-01' AS analysis_window
 FROM ts JOIN sites s ON s.site = ts.site JOIN units u ON u.nk = s.nk GROUP BY 1""", ("anom", "sites", "units"))
def trend_table(spark, sf):
    series = V.anom(spark, sf)
    ols = F.regr_slope("anomaly", "x").alias("ols_slope")
    fitted = theil_sen(series, ["site"], "x", "anomaly", calendar_bound=True, extra=[ols])
    return (fitted.join(V.sites(spark, sf), "site").join(V.units(spark, sf), "nk").groupBy("unit")
            .agg(F.count("*").alias("n_sites"), r6(F.avg("slope")).alias("mean_slope"), r6(F.avg("ols_slope")).alias("mean_ols"),
                 F.round(F.min(F.col("n_points") / 81.0), 6).alias("min_coverage"))
            .withColumns({"baseline_window": F.lit("1996-01-01..1998-12-01"), "analysis_window": F.lit("1995-02-01..2001-10-01")}))


CELLANOM_SQL = """cb AS (SELECT ilat, ilon, month(month) AS moy, avg(value) AS base, count(*) AS k FROM cells WHERE month BETWEEN DATE '1996-01-01' AND DATE '1998-12-01' GROUP BY 1, 2, 3 HAVING count(*) = 3),
ca AS (SELECT c.ilat, c.ilon, c.month, c.value - cb.base AS anomaly, (year(c.month) + (month(c.month) - 0.5) / 12.0) / 10.0 AS x FROM cells c JOIN cb ON cb.ilat = c.ilat AND cb.ilon = c.ilon AND cb.moy = month(c.month))"""


def cell_anomalies(spark, sf):
    """Cell anomalies against baseline months that are present in every baseline year."""
    cells = V.cells(spark, sf)
    base = (cells.where(C.in_window("month", *V.BASELINE)).groupBy("ilat", "ilon", F.month("month").alias("moy"))
            .agg(F.avg("value").alias("base"), F.count("*").alias("k")).where("k = 3").drop("k"))
    return (cells.withColumn("moy", F.month("month")).join(base, ["ilat", "ilon", "moy"])
            .withColumn("anomaly", F.col("value") - F.col("base")).withColumn("x", C.decimal_decades("month")))


@query("E10_complete_baseline_anomalies", f"WITH {CELLANOM_SQL} SELECT ilat, ilon, count(*) AS n, round(avg(anomaly), 6)+0.0 AS mean_anomaly FROM ca GROUP BY 1, 2", ("cells",))
def complete_baseline_anomalies(spark, sf):
    return cell_anomalies(spark, sf).groupBy("ilat", "ilon").agg(F.count("*").alias("n"), r6(F.avg("anomaly")).alias("mean_anomaly"))


@query("E11_aligned_outcome", f"""WITH {CELLANOM_SQL}, s AS (SELECT a.ilat, a.ilon, median((b.anomaly-a.anomaly)/(b.x-a.x)) AS slope FROM ca a JOIN ca b ON a.ilat = b.ilat AND a.ilon = b.ilon AND a.month < b.month GROUP BY 1, 2)
 SELECT m.nk, count(*) AS n_cells, round(sum(cos(radians(m.clat))*slope)/sum(cos(radians(m.clat))), 6)+0.0 AS slope FROM s JOIN mask m ON m.ilat = s.ilat AND m.ilon = s.ilon WHERE m.nk IS NOT NULL GROUP BY 1""", ("cells", "mask"))
def aligned_outcome(spark, sf):
    w = F.greatest(F.cos(F.radians("clat")), F.lit(0.0))
    fit = theil_sen(V.with_zone(cell_anomalies(spark, sf)).where("nk is not null"), ["ilat", "ilon", "nk", "clat"], "x", "anomaly", calendar_bound=True).where("n_points > 1")
    return fit.groupBy("nk").agg(F.count("*").alias("n_cells"), r6(F.sum(w * F.col("slope")) / F.sum(w)).alias("slope"))


@query("E12_line_through_bins", """SELECT CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere, count(*) AS n, round(regr_slope(ols_slope, abs(lat)), 6)+0.0 AS slope FROM strend GROUP BY 1""", ("strend",))
def line_through_bins(spark, sf):
    return V.strend(spark, sf).groupBy(C.hemisphere("lat").alias("hemisphere")).agg(
        F.count("*").alias("n"), r6(F.regr_slope("ols_slope", F.abs("lat"))).alias("slope"))


@query("E13_calibration_line", """SELECT round(regr_slope(anomaly, value), 6)+0.0 AS slope, round(regr_intercept(anomaly, value), 6)+0.0 AS intercept FROM anom""", ("anom",))
def calibration_line(spark, sf):
    return V.anom(spark, sf).agg(r6(F.regr_slope("anomaly", "value")).alias("slope"), r6(F.regr_intercept("anomaly", "value")).alias("intercept"))


@query("W10_stable_ids", """SELECT s.site, CAST(row_number() OVER (ORDER BY u.unit, s.lat, s.lon, s.site) - 1 AS BIGINT) AS city_id FROM sites s JOIN units u ON u.nk = s.nk""", ("sites", "units"))
def stable_ids(spark, sf):
    placed = V.sites(spark, sf).join(V.units(spark, sf), "nk")
    return row_ids(placed, ["unit", "lat", "lon", "site"], "city_id").select("site", F.col("city_id").cast("bigint").alias("city_id"))
