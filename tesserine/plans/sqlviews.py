"""SQL twins of `tesserine.plans.views` (same names, same columns)."""

from __future__ import annotations

import re

BASELINE_SQL = "month BETWEEN DATE '1996-01-01' AND DATE '1998-12-01'"
WINDOW_SQL = "month BETWEEN DATE '1995-02-01' AND DATE '2001-10-01'"

VIEWS: dict[str, str] = {
    "sites": """SELECT s_suppkey AS site, CAST(s_nationkey AS BIGINT) AS nk,
        CAST((s_suppkey*37 % 171) - 85 AS DOUBLE) AS lat, CAST((s_suppkey*97 % 360) - 180 AS DOUBLE) AS lon,
        s_acctbal AS acct FROM supplier""",
    "units": """SELECT CAST(n_nationkey AS BIGINT) AS nk, n_name AS unit, r_name AS zone
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "panel": """SELECT l_suppkey AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
        CAST(sum(CAST(floor(l_extendedprice*100+0.5) AS BIGINT)) AS DOUBLE)/count(*)/99991.0 AS value,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "clim": f"""SELECT site, CAST(month(month) AS BIGINT) AS moy, avg(value) AS climatology
        FROM panel WHERE {BASELINE_SQL} GROUP BY 1, 2""",
    "cover": f"""SELECT site, count(value) AS n_obs, CAST(81 AS BIGINT) AS n_possible,
        count(value)/81.0 AS coverage, count(value)/81.0 >= 0.9 AS keep
        FROM panel WHERE {WINDOW_SQL} GROUP BY 1""",
    "anom": f"""SELECT p.site, p.month, CAST(month(p.month) AS BIGINT) AS moy, p.value, c.climatology,
        p.value - c.climatology AS anomaly,
        (year(p.month) + (month(p.month) - 0.5) / 12.0) / 10.0 AS x
        FROM panel p JOIN clim c ON p.site = c.site AND month(p.month) = c.moy
        JOIN cover v ON v.site = p.site AND v.keep WHERE p.{WINDOW_SQL}""",
    "trend": """SELECT site, count(*) AS n_obs, regr_slope(anomaly, x) AS ols_slope,
        regr_intercept(anomaly, x) AS ols_intercept FROM anom GROUP BY 1""",
    "strend": "SELECT t.*, s.nk, s.lat, s.lon, s.acct FROM trend t JOIN sites s ON t.site = s.site",
    "emis": """SELECT u.nk, u.unit, p.yr, p.production, c.consumption, q.population FROM
        (SELECT CAST(c_nationkey AS BIGINT) AS nk, year(o_orderdate) AS yr,
            CAST(sum(CAST(floor(o_totalprice*100+0.5) AS BIGINT)) AS DOUBLE)/1e8 AS production
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) p
        JOIN units u ON u.nk = p.nk
        LEFT JOIN (SELECT CAST(s_nationkey AS BIGINT) AS nk, year(l_shipdate) AS yr,
            CAST(sum(CAST(floor(l_extendedprice*100+0.5) AS BIGINT)) AS DOUBLE)/1e8 AS consumption
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) >= 1997 GROUP BY 1, 2) c
        ON c.nk = p.nk AND c.yr = p.yr
        LEFT JOIN (SELECT CAST(c_nationkey AS BIGINT) AS nk, count(*) * 1000 AS population FROM customer GROUP BY 1) q
        ON q.nk = p.nk""",
    "score": """SELECT CAST(c_nationkey AS BIGINT) AS nk,
        CAST(sum(CAST(floor(o_totalprice*100+0.5) AS BIGINT)) AS DOUBLE)/count(*)/1e7 AS vuln,
        count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "wealth": """SELECT CAST(c_nationkey AS BIGINT) AS nk,
        CAST(sum(CAST(floor(c_acctbal*100+0.5) AS BIGINT)) AS DOUBLE)/count(*)/100.0 AS wealth,
        count(*) AS n_customers FROM customer GROUP BY 1""",
    "resp": """SELECT nk, sum(CASE WHEN yr <= 2000 THEN production END) AS cum_production,
        max(CASE WHEN yr = 2000 THEN population END) AS population,
        sum(CASE WHEN yr <= 2000 THEN production END) * 1e6 / max(CASE WHEN yr = 2000 THEN population END) AS resp,
        sum(CASE WHEN yr <= 2000 AND consumption IS NOT NULL THEN consumption END) * 1e6
            / max(CASE WHEN yr = 2000 THEN population END) AS resp_cons,
        sum(CASE WHEN yr <= 2000 AND yr >= 1997 THEN production END) * 1e6
            / max(CASE WHEN yr = 2000 THEN population END) AS resp_win
        FROM emis GROUP BY 1""",
    "natrend": """SELECT nk, count(*) AS n_sites, avg(ols_slope) AS trend, avg(abs(ols_slope)) AS warming,
        avg(lat) AS lat, avg(lon) AS lon, avg(acct) AS elev,
        CASE WHEN sum(greatest(acct, 0)) > 0 THEN sum(greatest(acct, 0) * abs(ols_slope)) / sum(greatest(acct, 0))
             ELSE avg(abs(ols_slope)) END AS warming_people,
        sum(cos(radians(lat)) * abs(ols_slope)) / sum(cos(radians(lat))) AS warming_area
        FROM strend GROUP BY 1""",
    "country": """SELECT u.nk, u.unit, u.zone, t.n_sites, t.trend, t.warming, t.warming_people, t.warming_area,
        t.lat, t.lon, t.elev, r.cum_production, r.population, r.resp, r.resp_cons, r.resp_win, s.vuln, w.wealth
        FROM units u JOIN natrend t ON t.nk = u.nk JOIN resp r ON r.nk = u.nk
        JOIN score s ON s.nk = u.nk JOIN wealth w ON w.nk = u.nk""",
    "cells": """SELECT CAST(l_suppkey % 18 AS BIGINT) AS ilat, CAST(l_partkey % 36 AS BIGINT) AS ilon,
        CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/count(*)/0.99991 AS value, count(*) AS n
        FROM lineitem GROUP BY 1, 2, 3""",
    "mask": """SELECT DISTINCT ilat, ilon, -85.0 + 10.0*ilat AS clat, -175.0 + 10.0*ilon AS clon,
        CASE WHEN (ilat*36 + ilon) % 7 = 0 THEN NULL ELSE (ilat*36 + ilon) % 25 END AS nk FROM cells""",
    "cellfit": """SELECT c.ilat, c.ilon, count(*) AS n_months,
        regr_slope(c.value, (year(c.month) + (month(c.month) - 0.5) / 12.0) / 10.0) AS slope,
        avg(c.value) AS mean_value FROM cells c GROUP BY 1, 2""",
    "zonal": """SELECT m.nk, m.ilat, m.ilon, m.clat, m.clon, f.n_months, f.slope, f.mean_value,
        greatest(cos(radians(m.clat)), 0.0) AS w FROM mask m JOIN cellfit f ON f.ilat = m.ilat AND f.ilon = m.ilon""",
    "days": """SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS mean_value,
        sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) AS n_first,
        count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""",
}


def _needed(name: str, done: list[str]) -> None:
    if name in done:
        return
    for other in VIEWS:
        if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", VIEWS[name]):
            _needed(other, done)
    done.append(name)


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix `body` with the named table expressions and everything they read."""
    order: list[str] = []
    for name in names:
        _needed(name, order)
    body = body.strip()
    if not order:
        return body
    # Materialised: a shared view is evaluated once however often it is read.
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
