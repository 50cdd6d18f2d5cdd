"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tesserine.plans import catalog  # noqa: E402
from tesserine.plans.registry import QUERIES  # noqa: E402
from tesserine.session import build_session, ship_package  # noqa: E402

#: Ingest, panel, trends, inequality, coupling, strata, zones, space, models, resampling, series.
HEADLINE = (
    "S2_ingest", "A1_climatology", "W8_anomalies", "E1_robust_trend", "E5_trend_table", "E3_cell_trend", "A23_overlap_agreement",
    "A5_cumulative_per_capita", "A29_gini", "A32_index_bundle", "C1_coupling_summary", "C14_direct_verdict", "A37_zone_geometry",
    "J11_nearest_neighbours", "P3_moran_centroid_knn", "P11_correlogram", "P22_interpolation_cv", "P30_scorecard", "M8_group_shares",
    "M13_influence", "B3_share_bootstrap", "B7_stability_summary", "P34_sem_fit", "P39_protocol_runs", "G11_rolling_origin",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    catalog.load()
    ship_package(spark)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
