"""Bootstrap, jackknife and permutation diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import columns as C
from tesserine.operators import influence as IN
from tesserine.operators import linear as L
from tesserine.operators import ordering as O
from tesserine.operators import resample as RS
from tesserine.operators import spatial as S
from tesserine.operators import stability as ST
from tesserine.plans import spatial_plans as XP
from tesserine.plans import views as V
from tesserine.plans.model_plans import DESIGN, GROUPS, design
from tesserine.plans.registry import query
from tesserine.plans.spatial_plans import DU, nn_sql, unit_points
from tesserine.session import cut_lineage

r6 = C.r6
DRAWS = 2000


def uniform_sql(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 12)) AS UBIGINT)::DOUBLE / 281474976710656.0)"


def draws_sql(src: str, key: str, name: str = "dr", seed: int = 0) -> str:
    """Named table expression (draw, key, times) matching `digest_draws`."""
    u = uniform_sql(f"'{seed}'", "d.draw", "x.i")
    return f"""{name}_x AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS i FROM (SELECT DISTINCT {key} FROM {src})),
 {name} AS (SELECT p.draw, y.{key}, count(*) AS times FROM (SELECT d.draw, CAST(floor({u}*(SELECT count(*) FROM {name}_x)) AS BIGINT) AS pick FROM {name}_x x, (SELECT unnest(range(1, {DRAWS + 1})) AS draw) d) p JOIN {name}_x y ON y.i = p.pick GROUP BY 1, 2)"""


def units(spark, sf):
    return cut_lineage(V.natrend(spark, sf).join(V.units(spark, sf), "nk").select("nk", "zone", "warming", "warming_area", "lat", "lon", "elev"))


@query("B1_unit_draws", f"WITH {draws_sql('natrend', 'nk')} SELECT CAST(draw AS BIGINT) AS draw, nk, times FROM dr", ("natrend",))
def unit_draws(spark, sf):
    return RS.digest_draws(units(spark, sf), "nk", DRAWS, max_rows=V.unit_bound(spark, sf)).select(F.col("draw").cast("bigint").alias("draw"), "nk", "times")


@query("B2_block_draws", f"WITH b AS (SELECT t.nk, u.zone FROM natrend t JOIN units u ON u.nk = t.nk), {draws_sql('b', 'zone')} SELECT CAST(draw AS BIGINT) AS draw, count(*) AS n_units, sum(times)::BIGINT AS n_rows FROM dr JOIN b ON b.zone = dr.zone GROUP BY 1", ("natrend", "units"))
def block_draws(spark, sf):
    d = RS.block_draws(units(spark, sf), "nk", "zone", DRAWS, max_rows=V.unit_bound(spark, sf))
    return d.groupBy(F.col("draw").cast("bigint").alias("draw")).agg(F.count("*").alias("n_units"), F.sum("times").alias("n_rows"))


@query("B1_replayed_draws")
def replayed_draws(spark, sf):
    n = units(spark, sf).count()
    return RS.replayed_draws(spark, n, DRAWS, 0)


def draw_shares(spark, sf):
    """Shares of two single-column groups for every draw, undefined draws kept as NULL."""
    d = design(spark, sf)
    draws = cut_lineage(RS.digest_draws(d, "nk", DRAWS, max_rows=V.unit_bound(spark, sf)))
    return cut_lineage(L.group_shares(draws.join(d.select("nk", "warming", "abs_lat", "wealth"), "nk").select("draw", "times", "warming", "abs_lat", "wealth"),
                                      {"geography": ["abs_lat"], "economy": ["wealth"]}, "warming", by=["draw"], weight=F.col("times")))


def wcorr(a: str, b: str) -> str:
    return f"((sum(t*{a}*{b}) - sum(t*{a})*sum(t*{b})/sum(t))/sqrt((sum(t*{a}*{a}) - sum(t*{a})*sum(t*{a})/sum(t))*(sum(t*{b}*{b}) - sum(t*{b})*sum(t*{b})/sum(t))))"


SHARE_DRAWS = f"""{DESIGN}, {draws_sql('dg', 'nk')}, j AS (SELECT dr.draw, dr.times::DOUBLE AS t, dg.warming - (SELECT avg(warming) FROM dg) AS y, dg.abs_lat - (SELECT avg(abs_lat) FROM dg) AS x, (dg.wealth - (SELECT avg(wealth) FROM dg))/1000 AS a FROM dr JOIN dg ON dg.nk = dr.nk),
 c AS (SELECT draw, {wcorr('y', 'x')} AS yx, {wcorr('y', 'a')} AS ya, {wcorr('x', 'a')} AS xa FROM j GROUP BY 1), q AS (SELECT draw, yx*yx AS r1, ya*ya AS r2, (yx*yx + ya*ya - 2*yx*ya*xa)/(1 - xa*xa) AS r12 FROM c),
 sh AS (SELECT draw, 'geography' AS grp, (r1 + r12 - r2)/2 AS share FROM q UNION ALL SELECT draw, 'economy', (r2 + r12 - r1)/2 FROM q UNION ALL SELECT draw, 'residual', 1 - r12 FROM q)"""


@query("B3_share_bootstrap", f"WITH {SHARE_DRAWS} SELECT CAST(draw AS BIGINT) AS draw, grp AS \"group\", round(share, 6)+0.0 AS share FROM sh", ("country",))
def share_bootstrap(spark, sf):
    return draw_shares(spark, sf).select(F.col("draw").cast("bigint").alias("draw"), "group", r6("share").alias("share"))


@query("B4_percentile_interval", f"WITH {SHARE_DRAWS} SELECT grp AS \"group\", round(quantile_cont(share, 0.025), 6)+0.0 AS ci_low, round(quantile_cont(share, 0.975), 6)+0.0 AS ci_high FROM sh GROUP BY 1", ("country",))
def percentile_interval(spark, sf):
    return RS.percentile_interval(draw_shares(spark, sf), "share", ["group"]).select("group", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query("B5_share_stability", f"WITH {SHARE_DRAWS} SELECT grp AS \"group\", count(*) AS n, round(avg(share), 6)+0.0 AS mean, round(avg(CASE WHEN share > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_positive, round(avg(CASE WHEN share >= (SELECT max(share) FROM sh o WHERE o.draw = sh.draw AND o.grp <> 'residual') - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_largest FROM sh WHERE grp <> 'residual' GROUP BY 1", ("country",))
def share_stability(spark, sf):
    s = draw_shares(spark, sf).where("group <> 'residual'")
    top = s.groupBy("draw").agg(F.max("share").alias("top"))
    return s.join(top, "draw").groupBy("group").agg(
        F.count("*").alias("n"), r6(F.avg("share")).alias("mean"), F.round(F.avg((F.col("share") > 0).cast("double")), 6).alias("p_positive"),
        F.round(F.avg((F.col("share") >= F.col("top") - 1e-12).cast("double")), 6).alias("p_largest"))


def jackknife_shares(spark, sf):
    """Shares with each unit left out: total cross products minus the unit's own, no refit over rows."""
    d = design(spark, sf)
    scaled, _ = L.standardised(d, ["abs_lat", "wealth", "warming"], keep=["nk"])
    scaled = cut_lineage(scaled)
    total = L.gram(scaled, ["abs_lat", "wealth", "warming"]).select(F.struct("n", "g").alias("t")).scalar()
    own = L.gram(scaled, ["abs_lat", "wealth", "warming"], ["nk"])
    left = own.withColumn("_t", total).select("nk", F.zip_with("_t.g", "g", lambda a, b: a - b).alias("g"))

    def solve(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for name, share in L.lmg(L.unpack(r.g, 4), {"geography": [1], "economy": [2]}, 3).items():
                    rows.append((r.nk, name, share))
            yield pd.DataFrame(rows, columns=["nk", "group", "share"])

    full = L.group_shares(d, {"geography": ["abs_lat"], "economy": ["wealth"]}, "warming").select("group", F.col("share").alias("full"))
    return left.mapInPandas(solve, "nk bigint, group string, share double").join(full, "group").withColumn("delta", F.col("share") - F.col("full"))


JACK = f"""{DESIGN}, z AS (SELECT a.nk AS out, b.warming AS y, b.abs_lat AS x, b.wealth AS a FROM dg a JOIN dg b ON a.nk <> b.nk), c AS (SELECT out, corr(y, x) AS yx, corr(y, a) AS ya, corr(x, a) AS xa FROM z GROUP BY 1 UNION ALL SELECT -1, corr(warming, abs_lat), corr(warming, wealth), corr(abs_lat, wealth) FROM dg),
 q AS (SELECT out, yx*yx AS r1, ya*ya AS r2, (yx*yx + ya*ya - 2*yx*ya*xa)/(1 - xa*xa) AS r12 FROM c), sh AS (SELECT out, 'geography' AS grp, (r1 + r12 - r2)/2 AS share FROM q UNION ALL SELECT out, 'economy', (r2 + r12 - r1)/2 FROM q UNION ALL SELECT out, 'residual', 1 - r12 FROM q),
 dl AS (SELECT s.out AS nk, s.grp, s.share - f.share AS delta FROM sh s JOIN sh f ON f.grp = s.grp AND f.out = -1 WHERE s.out <> -1)"""


@query("B6_leave_one_out", f"WITH {JACK}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(abs(delta), 9) DESC, nk) AS rk FROM dl) SELECT grp AS \"group\", nk, rk, round(delta, 6)+0.0 AS delta FROM r WHERE rk <= 10", ("country",))
def leave_one_out(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("group").orderBy(F.round(F.abs("delta"), 9).desc(), "nk")
    return jackknife_shares(spark, sf).withColumn("rk", F.row_number().over(w).cast("bigint")).where("rk <= 10").select("group", "nk", "rk", r6("delta").alias("delta"))


@query("V7_top_influence", f"WITH {JACK}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(abs(delta), 9) DESC, nk) AS rk FROM dl) SELECT grp AS \"group\", u.unit, rk, round(delta, 6)+0.0 AS delta, delta > 0 AS raises FROM r JOIN country u ON u.nk = r.nk WHERE rk <= 5", ("country",))
def top_influence(spark, sf):
    """Bars of the five units whose omission moves each group's share most."""
    names = V.units(spark, sf).select("nk", "unit")
    return leave_one_out(spark, sf).where("rk <= 5").join(names, "nk").select("group", "unit", "rk", "delta", (F.col("delta") > 0).alias("raises"))


@query("B7_stability_summary")
def stability_summary(spark, sf):
    d = design(spark, sf)
    _, scaled, _, point = ST.prepared(d, "nk", GROUPS, ["warming"])
    draws = ST.both_draws(d, "nk", "zone", DRAWS, 0, 0, V.unit_bound(spark, sf))
    ci = RS.percentile_interval(ST.drawn_shares(scaled, draws, "nk", GROUPS), "share", ["group", "kind"])
    units_ci = F.col("kind") == "unit_draws"
    both = ci.groupBy("group").agg(*[F.max(F.when(at, F.col(c))).alias(name + c) for at, name in ((units_ci, ""), (~units_ci, "block_")) for c in ("ci_low", "ci_high")],
                                   F.max(F.when(units_ci, F.col("n_valid"))).alias("n_valid"), F.max(F.when(~units_ci, F.col("n_valid"))).alias("n_valid_blocks"))
    return point.join(both, "group").select(
        "group", r6("point").alias("point"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "n_valid",
        r6("block_ci_low").alias("block_ci_low"), r6("block_ci_high").alias("block_ci_high"), "n_valid_blocks")


def _residual_sql(o: str) -> str:
    """Moran's I of the residuals of one outcome on two columns, with its label permutations."""
    nn = nn_sql(8, "d", f"nn_{o}")
    return f"""f_{o} AS (SELECT avg({o}) AS my, avg(abs_lat) AS mx, avg(wealth) AS ma, covar_pop({o}, abs_lat) AS cx, covar_pop({o}, wealth) AS ca, var_pop(abs_lat) AS vx, var_pop(wealth) AS va, covar_pop(abs_lat, wealth) AS xa FROM dg),
 r_{o} AS (SELECT nk, {o} - my - (cx*va - ca*xa)/(vx*va - xa*xa)*(abs_lat - mx) - (ca*vx - cx*xa)/(vx*va - xa*xa)*(wealth - ma) AS z FROM dg, f_{o}),
 {nn}, e_{o} AS (SELECT i, j, 1.0/count(*) OVER (PARTITION BY i) AS w FROM nn_{o}),
 x_{o} AS (SELECT nk, z, row_number() OVER (ORDER BY nk) AS pos FROM r_{o}),
 p_{o} AS (SELECT d.draw, a.nk, row_number() OVER (PARTITION BY d.draw ORDER BY md5('0|' || d.draw || '|' || a.nk)) AS pos FROM r_{o} a, (SELECT unnest(range(1, 200)) AS draw) d),
 z_{o} AS (SELECT p.draw, p.nk, x.z FROM p_{o} p JOIN x_{o} x ON x.pos = p.pos UNION ALL SELECT 0, nk, z FROM r_{o}),
 s_{o} AS (SELECT a.draw, (SELECT count(*) FROM r_{o})/(SELECT sum(w) FROM e_{o})*sum(e.w*a.z*b.z)/(SELECT sum(z*z) FROM r_{o}) AS s FROM e_{o} e JOIN z_{o} a ON a.nk = e.i JOIN z_{o} b ON b.nk = e.j AND b.draw = a.draw GROUP BY 1),
 m_{o} AS (SELECT '{o}' AS outcome, unnest(['morans_i', 'p_value', 'n', 'k_neighbors', 'n_permutations']) AS item, unnest([(SELECT s FROM s_{o} WHERE draw = 0),
   ((SELECT count(*) FROM s_{o} WHERE draw > 0 AND abs(s) >= (SELECT abs(s) FROM s_{o} WHERE draw = 0) - 1e-12) + 1)/200.0, (SELECT count(*) FROM dg), 8, 199]) AS value)"""


def _shares_sql(src: str, keys: str, name: str, w: str = "1.0") -> str:
    """Shares of two single-column groups per key, from weighted correlations of rows (keys, y, x, a)."""
    def c(a, b):
        return f"((sum(t*{a}*{b}) - sum(t*{a})*sum(t*{b})/sum(t))/sqrt((sum(t*{a}*{a}) - sum(t*{a})*sum(t*{a})/sum(t))*(sum(t*{b}*{b}) - sum(t*{b})*sum(t*{b})/sum(t))))"
    return f"""{name}_c AS (SELECT {keys}, {c('y', 'x')} AS yx, {c('y', 'a')} AS ya, {c('x', 'a')} AS xa FROM (SELECT *, {w} AS t FROM {src}) GROUP BY ALL),
 {name}_q AS (SELECT {keys}, yx*yx AS r1, ya*ya AS r2, CASE WHEN abs(xa) > 1 - 1e-9 THEN yx*yx ELSE (yx*yx + ya*ya - 2*yx*ya*xa)/(1 - xa*xa) END AS r12 FROM {name}_c),
 {name} AS (SELECT {keys}, 'geography' AS grp, (r1 + r12 - r2)/2 AS share FROM {name}_q UNION ALL SELECT {keys}, 'economy', (r2 + r12 - r1)/2 FROM {name}_q UNION ALL SELECT {keys}, 'residual', 1 - r12 FROM {name}_q)"""


PAIR = {"geography": ["abs_lat"], "economy": ["wealth"]}
STABILITY = f"""{DESIGN}, {draws_sql('dg', 'nk')}, {draws_sql('dg', 'zone', 'bk', 1)}, {DU.replace('natrend', 'dg')},
 ys AS (SELECT 'warming' AS outcome, nk, zone, warming - avg(warming) OVER () AS y, abs_lat - avg(abs_lat) OVER () AS x, (wealth - avg(wealth) OVER ())/1000 AS a FROM dg
   UNION ALL SELECT 'warming_area', nk, zone, warming_area - avg(warming_area) OVER (), abs_lat - avg(abs_lat) OVER (), (wealth - avg(wealth) OVER ())/1000 FROM dg),
 dj AS (SELECT 'unit_draws' AS kind, dr.draw, outcome, times::DOUBLE AS times, y, x, a FROM dr JOIN ys USING (nk) UNION ALL SELECT 'block_draws', bk.draw, outcome, times::DOUBLE, y, x, a FROM bk JOIN ys USING (zone)),
 {_shares_sql('dj', 'outcome, kind, draw', 'sh', 'times')}, {_shares_sql('ys', 'outcome', 'pt')},
 lo AS (SELECT a.nk AS out, b.y, b.x, b.a FROM ys a JOIN ys b ON a.nk <> b.nk AND a.outcome = 'warming' AND b.outcome = 'warming'), {_shares_sql('lo', 'out', 'ls')},
 ld AS (SELECT outcome, kind, draw, CASE WHEN max(share) FILTER (grp = 'geography') >= max(share) FILTER (grp = 'economy') THEN 'geography' ELSE 'economy' END AS lead FROM sh GROUP BY 1, 2, 3),
 st AS (SELECT sh.outcome, sh.kind, sh.grp, any_value(pt.share) AS point, avg(sh.share) AS mean, stddev_samp(sh.share) AS std, quantile_cont(sh.share, 0.025) AS ci_low, quantile_cont(sh.share, 0.975) AS ci_high,
   CASE WHEN sh.grp <> 'residual' THEN avg((lead = sh.grp)::INT) END AS p_largest, CASE WHEN sh.grp <> 'residual' THEN avg((sh.share > 0)::INT) END AS p_positive, {DRAWS}.0 - count(sh.share) AS n_failed
   FROM sh JOIN ld USING (outcome, kind, draw) JOIN pt ON pt.outcome = sh.outcome AND pt.grp = sh.grp GROUP BY 1, 2, 3),
 sl AS (SELECT kind AS block, outcome, grp, unnest(['point', 'mean', 'std', 'ci_low', 'ci_high', 'p_largest', 'p_positive', 'n_failed']) AS item, unnest([point, mean, std, ci_low, ci_high, p_largest, p_positive, n_failed]) AS value FROM st),
 fl AS (SELECT 'influence' AS block, 'warming' AS outcome, ls.grp, CAST(out AS VARCHAR) AS item, pt.share - ls.share AS value, row_number() OVER (PARTITION BY ls.grp ORDER BY round(abs(pt.share - ls.share), 9) DESC, out) AS rank
   FROM ls JOIN pt ON pt.grp = ls.grp AND pt.outcome = 'warming' WHERE ls.grp <> 'residual'), {_residual_sql('warming')}, {_residual_sql('warming_area')}"""


@query("B7_stability_blocks", f"""WITH {STABILITY} SELECT block, outcome, grp AS "group", item, 0 AS rank, round(value, 6)+0.0 AS value FROM sl WHERE value IS NOT NULL
 UNION ALL SELECT block, outcome, grp, item, rank::INT, round(value, 6)+0.0 FROM fl WHERE rank <= 10
 UNION ALL SELECT 'residual_spatial', outcome, '', item, 0, round(value, 6)+0.0 FROM (SELECT * FROM m_warming UNION ALL SELECT * FROM m_warming_area)""", ("country",))
def stability_blocks(spark, sf):
    """All blocks of the summary for the main outcome and the area-weighted one; influence for the main one."""
    d = design(spark, sf)
    blocks = ST.stability_blocks(d, d.select("nk", "lat", "lon"), "nk", "zone", PAIR, ["warming", "warming_area"], DRAWS, max_rows=V.unit_bound(spark, sf))
    return blocks.select("block", "outcome", "group", "item", F.coalesce("rank", F.lit(0)).alias("rank"), r6("value").alias("value"))


@query("B8_draw_diagnostics", f"WITH {draws_sql('natrend', 'nk')} SELECT CAST(draw AS BIGINT) AS draw, count(*) AS n_distinct, round(sum(times)*sum(times)*1.0/sum(times*times), 6) AS ess FROM dr GROUP BY 1", ("natrend",))
def draw_diagnostics(spark, sf):
    d = RS.digest_draws(units(spark, sf), "nk", DRAWS, max_rows=V.unit_bound(spark, sf))
    return RS.effective_size(d).select(F.col("draw").cast("bigint").alias("draw"), "n_distinct", F.round("ess", 6).alias("ess"))


@query("B9_block_equivalence", f"WITH b AS (SELECT t.nk, u.zone FROM natrend t JOIN units u ON u.nk = t.nk), {draws_sql('b', 'zone')} SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, count(*) AS n_rows FROM dr JOIN b ON b.zone = dr.zone", ("natrend", "units"))
def block_equivalence(spark, sf):
    u, n = units(spark, sf), V.unit_bound(spark, sf)
    first = cut_lineage(RS.block_draws(u, "nk", "zone", DRAWS, max_rows=n))
    second = cut_lineage(RS.block_draws(u.where("warming is not null").repartition(5), "nk", "zone", DRAWS, max_rows=n))
    def size(df, name):
        return df.agg(F.count("*").alias(name), F.lit(1).alias("_k"))
    return size(first.exceptAll(second), "only_first").join(size(second.exceptAll(first), "only_second"), "_k").join(size(first, "n_rows"), "_k").drop("_k")


@query("B10_evaluated_draws", f"WITH {draws_sql('natrend', 'nk')}, e AS (SELECT draw, CASE WHEN count(*) < 15 THEN NULL ELSE sum(times*warming)/sum(times) END AS v FROM dr JOIN natrend t ON t.nk = dr.nk GROUP BY 1) SELECT CASE WHEN v IS NULL THEN 'undefined' ELSE 'ok' END AS status, count(*) AS n, round(avg(v), 6) AS mean FROM e GROUP BY 1", ("natrend",))
def evaluated_draws(spark, sf):
    u = units(spark, sf)
    d = RS.digest_draws(u, "nk", DRAWS, max_rows=V.unit_bound(spark, sf)).join(u, "nk")
    e = d.groupBy("draw").agg((F.sum(F.col("times") * F.col("warming")) / F.sum("times")).alias("v"), F.count("*").alias("k")).withColumn("v", F.when(F.col("k") >= 15, F.col("v")))
    return e.groupBy(F.when(F.col("v").isNull(), "undefined").otherwise("ok").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("B11_population_audit", "SELECT nk, yr, CASE WHEN consumption IS NULL THEN 'consumption' ELSE '' END AS missing, consumption IS NOT NULL AS complete FROM emis", ("emis",))
def population_audit(spark, sf):
    e = V.emis(spark, sf)
    cols = ["production", "consumption", "population"]
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in cols]), lambda v: v.isNotNull()), ",")
    return e.select("nk", "yr", missing.alias("missing"), (missing == "").alias("complete"))


def rank_draws(spark, sf):
    """Rank correlation per unit draw; a draw whose values are constant stays with NULL."""
    u = units(spark, sf).select("nk", F.col("warming").alias("a"), F.col("elev").alias("b"))
    d = cut_lineage(RS.digest_draws(u, "nk", DRAWS, max_rows=V.unit_bound(spark, sf)).join(u, "nk"))
    # Average rank of a value among the drawn multiset: rows below plus the middle of its own copies.
    ra = O.value_positions(d.select("draw", "a", "times"), "a", {"m": F.col("times")}, by=["draw"], max_rows=V.unit_bound(spark, sf)).select("draw", "a", (F.col("cum_m") - F.col("m") + (F.col("m") + 1) / 2.0).alias("ra"))
    rb = O.value_positions(d.select("draw", "b", "times"), "b", {"m": F.col("times")}, by=["draw"], max_rows=V.unit_bound(spark, sf)).select("draw", "b", (F.col("cum_m") - F.col("m") + (F.col("m") + 1) / 2.0).alias("rb"))
    ranked = d.join(ra, ["draw", "a"]).join(rb, ["draw", "b"])
    return ranked.groupBy("draw").agg(RS.weighted_corr(F.col("ra"), F.col("rb"), F.col("times").cast("double")).alias("rho"))


RANK_DRAWS = f"""{draws_sql('natrend', 'nk')}, j AS (SELECT dr.draw, t.warming AS a, t.elev AS b, unnest(range(times)) AS c FROM dr JOIN natrend t ON t.nk = dr.nk), k AS (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY a) + (count(*) OVER (PARTITION BY draw, a) - 1)/2.0 AS ra, rank() OVER (PARTITION BY draw ORDER BY b) + (count(*) OVER (PARTITION BY draw, b) - 1)/2.0 AS rb FROM j), rr AS (SELECT draw, corr(ra, rb) AS rho FROM k GROUP BY 1)"""


@query("B12_rank_bootstrap", f"WITH {RANK_DRAWS} SELECT CAST(draw AS BIGINT) AS draw, round(rho, 6)+0.0 AS rho FROM rr", ("natrend",))
def rank_bootstrap(spark, sf):
    return rank_draws(spark, sf).select(F.col("draw").cast("bigint").alias("draw"), r6("rho").alias("rho"))


@query("B12_rank_interval", f"WITH {RANK_DRAWS} SELECT count(*) AS n_valid, round(quantile_cont(rho, 0.025), 6)+0.0 AS ci_low, round(quantile_cont(rho, 0.975), 6)+0.0 AS ci_high FROM rr", ("natrend",))
def rank_interval(spark, sf):
    return RS.percentile_interval(rank_draws(spark, sf), "rho").select("n_valid", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query("B13_paired_rmse_difference", f"WITH {draws_sql('natrend', 'nk')}, p AS (SELECT draw, sqrt(sum(times*trend*trend)/sum(times)) - sqrt(sum(times*warming*warming)/sum(times)) AS d FROM dr JOIN natrend t ON t.nk = dr.nk GROUP BY 1) SELECT round(quantile_cont(d, 0.025), 6)+0.0 AS ci_low, round(quantile_cont(d, 0.975), 6)+0.0 AS ci_high FROM p", ("natrend",))
def paired_rmse_difference(spark, sf):
    u = cut_lineage(V.natrend(spark, sf).select("nk", "trend", "warming"))
    d = RS.digest_draws(u, "nk", DRAWS, max_rows=V.unit_bound(spark, sf)).join(u, "nk")
    def rmse(c):
        return F.sqrt(F.sum(F.col("times") * F.col(c) * F.col(c)) / F.sum("times"))
    return RS.percentile_interval(d.groupBy("draw").agg((rmse("trend") - rmse("warming")).alias("d")), "d").select(r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query("B14_rank_flags", f"WITH {SHARE_DRAWS} SELECT CAST(draw AS BIGINT) AS draw, arg_max(grp, share) AS largest_named, max(share) > 0.5 AS dominant FROM sh WHERE grp <> 'residual' GROUP BY 1", ("country",))
def rank_flags(spark, sf):
    s = draw_shares(spark, sf).where("group <> 'residual'")
    return s.groupBy(F.col("draw").cast("bigint").alias("draw")).agg(F.max_by("group", "share").alias("largest_named"), (F.max("share") > 0.5).alias("dominant"))


@query("B15_bootstrap_summary", f"WITH {SHARE_DRAWS}, f AS (SELECT draw, max(CASE WHEN grp = 'economy' THEN share END) >= max(CASE WHEN grp = 'geography' THEN share END) AS flip FROM sh GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE flip) AS n_flip, count(*) FILTER (WHERE flip)*20 > count(*) AS material FROM f", ("country",))
def bootstrap_summary(spark, sf):
    f = draw_shares(spark, sf).groupBy("draw").agg(
        (F.max(F.when(F.col("group") == "economy", F.col("share"))) >= F.max(F.when(F.col("group") == "geography", F.col("share")))).alias("flip"))
    return f.agg(F.count("*").alias("n"), F.count_if("flip").alias("n_flip"), (F.count_if("flip") * 20 > F.count("*")).alias("material"))


@query("B16_moran_jackknife", f"""WITH {DU}, o AS (SELECT nk AS out FROM natrend), nb AS (SELECT o.out, d.i, d.j, row_number() OVER (PARTITION BY o.out, d.i ORDER BY round(d.km, 4), d.j) AS rk FROM o JOIN d ON d.i <> o.out AND d.j <> o.out),
 z AS (SELECT o.out, t.nk, t.warming - avg(t.warming) OVER (PARTITION BY o.out) AS z FROM o JOIN natrend t ON t.nk <> o.out), zz AS (SELECT out, sum(z*z) AS q FROM z GROUP BY 1)
 SELECT nb.out AS nk, round(sum(a.z*b.z)/8/any_value(zz.q), 6)+0.0 AS moran FROM nb JOIN z a ON a.out = nb.out AND a.nk = nb.i JOIN z b ON b.out = nb.out AND b.nk = nb.j JOIN zz ON zz.out = nb.out WHERE rk <= 8 GROUP BY 1""", ("natrend",))
def moran_jackknife(spark, sf):
    p = unit_points(spark, sf)
    return IN.moran_without(p, "nk", "warming", IN.leave_each_out(p, "nk")).select(F.col("scenario").alias("nk"), r6("moran").alias("moran"))


DROP_SIZES = [5, 10, 15, 20, 30]
SITE_LISA = (f"{XP.dist_sql('strend', 'site', 'd')}, {XP.KNN_W}, z AS (SELECT site, ols_slope - avg(ols_slope) OVER () AS z FROM strend), "
             + f"{XP.LISA.replace('nk', 'site')}, {XP.lisa_p_sql('site')}")
_WITHOUT = """keep AS (SELECT sc.scenario, t.site, t.v FROM sc, (SELECT site, ols_slope AS v FROM strend) t WHERE NOT EXISTS (SELECT 1 FROM drops x WHERE x.scenario = sc.scenario AND x.site = t.site)),
 kz AS (SELECT scenario, site, v - avg(v) OVER (PARTITION BY scenario) AS z, count(*) OVER (PARTITION BY scenario) AS n FROM keep),
 kd AS (SELECT a.scenario, d.i, d.j, a.z*b.z AS zz, row_number() OVER (PARTITION BY a.scenario, d.i ORDER BY round(d.km, 4), d.j) AS rk FROM kz a JOIN d ON d.i = a.site JOIN kz b ON b.scenario = a.scenario AND b.site = d.j),
 kq AS (SELECT scenario, any_value(n) AS n, sum(z*z) AS q FROM kz GROUP BY 1),
 km AS (SELECT scenario, any_value(n) AS n, sum(zz)/least(8, any_value(n) - 1)/any_value(q) AS moran FROM kd JOIN kq USING (scenario) WHERE rk <= 8 GROUP BY 1)"""


@query("B16_moran_drops", f"""WITH {SITE_LISA}, rk AS (SELECT site, row_number() OVER (ORDER BY abs(z) DESC, site) AS rk FROM z),
 drops AS (SELECT 'drop_top_' || s AS scenario, site FROM rk, (SELECT unnest({DROP_SIZES}) AS s) WHERE rk <= s
   UNION ALL SELECT 'drop_cluster_' || label, site FROM ll WHERE label IN ('HH', 'LL') UNION ALL SELECT 'drop_both_clusters', site FROM ll WHERE label IN ('HH', 'LL')),
 sc AS (SELECT DISTINCT scenario FROM drops UNION ALL SELECT 'full_sample'), {_WITHOUT}
 SELECT scenario, n, round(moran, 6)+0.0 AS moran FROM km""", ("strend",))
def moran_drops(spark, sf):
    p = XP.site_values(spark, sf)
    edges = cut_lineage(S.knn_weights(p, "site", 8))
    labels = S.local_moran_p(p, edges, "site", "v", XP.LOCAL_DRAWS)
    drops = IN.largest_first(p, "site", "v", DROP_SIZES).unionByName(IN.label_clusters(labels, "site"))
    full = S.moran(p, edges, "site", "v").select(F.lit("full_sample").alias("scenario"), F.col("statistic").alias("moran")).withColumn("n", p.agg(F.count("*")).scalar())
    left = IN.moran_without(p, "site", "v", drops).select("scenario", "moran", "n")
    return left.unionByName(full).select("scenario", F.col("n").cast("bigint").alias("n"), r6("moran").alias("moran"))


@query("B16_jackknife_leaders", f"""WITH {XP.dist_sql('strend', 'site', 'd')}, drops AS (SELECT CAST(site AS VARCHAR) AS scenario, site FROM strend),
 sc AS (SELECT scenario FROM drops UNION ALL SELECT 'full_sample'), {_WITHOUT}, f AS (SELECT moran AS m FROM km WHERE scenario = 'full_sample'),
 g AS (SELECT CAST(scenario AS BIGINT) AS site, m - moran AS delta FROM km, f WHERE scenario <> 'full_sample')
 SELECT site, round(delta, 6)+0.0 AS delta FROM g ORDER BY abs(round(delta, 9)) DESC, site LIMIT 10""", ("strend",))
def jackknife_leaders(spark, sf):
    p = XP.site_values(spark, sf)
    full = S.moran(p, S.knn_weights(p, "site", 8), "site", "v").select("statistic").scalar()
    left = IN.moran_without(p, "site", "v", IN.leave_each_out(p, "site")).where("moran is not null")
    delta = left.select(F.col("scenario").cast("bigint").alias("site"), (full - F.col("moran")).alias("d"))
    return delta.orderBy(F.desc(F.abs(F.round("d", 9))), "site").limit(10).select("site", r6("d").alias("delta"))
