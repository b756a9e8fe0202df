"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from oracles.reports import statements
from tests.compare import differences, duck
from tradeweave.operators import cohorts
from tradeweave.registry import all_queries
from tradeweave.sources.sample import sample_star

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()
ORACLES = statements()

# reports over all five clusters' tables run the whole k search; tests/test_clusters.py
# checks them on planted clusters instead
SEARCHED = {
    "kmeans_k_search",
    "kmeans_segments",
    "export_clusters",
    "cluster_summary",
    "segment_profile",
    "segment_revenue_share",
    "segment_box_stats",
    "segment_points",
}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == SEARCHED


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_counts_by_offset_are_the_wide_grid(spark):
    star = sample_star(spark, FOLDER)
    grid = cohorts.retention_counts(star).collect()
    offsets = sorted({r["months_since_first"] for r in grid})
    wide = cohorts.widen(cohorts.retention_counts(star), "active_customers", offsets).collect()
    rows = {r["cohort_month"]: r["counts"] for r in cohorts.counts_by_offset(star).collect()}
    assert {r["cohort_month"]: ",".join(str(r[f"month_{o}"]) for o in offsets) for r in wide} == rows


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "order_month" and df.count() > 0
