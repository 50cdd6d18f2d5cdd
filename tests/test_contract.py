"""Registered queries: names, SQL twins and agreement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF
from tools.check_oracles import TABLES, canonical

SAMPLE = ("S2_ingest", "F1_parse_coordinate", "A1_climatology", "W8_anomalies", "E1_robust_trend", "A23_overlap_agreement", "J19_vintage_comparison",
          "J11_nearest_neighbours", "A37_zone_geometry", "C1_coupling_table", "M8_group_shares", "B1_unit_draws", "P11_correlogram", "W12_whitening", "Q12_evidence_digests")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert len(queries) > 250 and set(oracles) <= set(queries)
    assert len(oracles) / len(queries) > 0.85


def test_entry(spark):
    df = contract.entry(spark)
    assert "mean_slope" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_agrees_with_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
