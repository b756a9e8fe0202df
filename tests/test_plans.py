"""What Spark plans for the reports, and that settings do not change their answers."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oracles.reports import statements
from tests.compare import differences, duck
from tradeweave.operators import correlation, overview, revenue, sellers
from tradeweave.registry import all_queries
from tradeweave.sources.sample import sample_star
from tradeweave.sources.warehouse import read_star, write_star

FOLDER = "/root/testdata/sf0.001"
ORACLES = statements()


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_without_broadcast(spark, no_broadcast, adaptive, name):
    """The joins that large tables take, with and without adaptive execution."""
    assert differences(all_queries()[name](spark, FOLDER), duck(FOLDER), ORACLES[name]) == []


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    write_star(sample_star(spark, FOLDER), str(tmp_path / "star"))
    return read_star(spark, str(tmp_path / "star"))


@pytest.mark.parametrize("report", [sellers.top_products, sellers.seller_state_summary, overview.top_categories])
def test_items_are_dealt_once(spark, stored, report):
    """The sums per order and the join on the order share the exchange of the items."""
    finer = re.compile(r"Exchange hashpartitioning\(order_id#\d+, (seller_id|product_id|category)#")
    assert not finer.search(planned(report(stored)))


def test_items_are_expanded_for_two_counts_only(spark, stored):
    """Orders and customers are counted from sums per order, not from items."""
    (expand,) = [x for x in planned(overview.baseline_kpis(stored)).splitlines() if "Expand" in x]
    assert "product_id" in expand and "seller_id" in expand
    assert "customer_id" not in expand and "order_id" not in expand


def test_filters_on_orders_skip_row_groups(spark, stored):
    plan = planned(stored["fact_order_items"].where("order_id = '7'"))
    assert "PushedFilters: [IsNotNull(order_id), EqualTo(order_id,7)]" in plan


def test_stored_facts_are_dealt_and_in_order(spark, stored):
    """An order lies in one file, and a file's row groups hold ranges of orders."""
    rows = stored["fact_order_items"].selectExpr("order_id", "input_file_name() AS file", "_metadata.row_index AS place")
    assert rows.groupBy("order_id").agg(F.count_distinct("file").alias("files")).where("files > 1").collect() == []
    in_file = Window.partitionBy("file").orderBy("place")
    before = rows.withColumn("before", F.lag("order_id").over(in_file)).where("before > order_id")
    assert before.collect() == []


def test_loading_twice_replaces(spark, tmp_path):
    star, folder = sample_star(spark, FOLDER), str(tmp_path / "twice")
    write_star(star, folder)
    write_star(star, folder)
    assert read_star(spark, folder)["dim_sellers"].count() == star["dim_sellers"].count()


def test_building_a_report_runs_nothing_over_rows(spark, stored):
    """Joins are planned without counting or sampling their sides."""
    spark.sparkContext.setJobGroup("building", "building reports")
    try:
        for report in (overview.baseline_kpis, overview.top_categories, revenue.pareto_abc, sellers.category_matrix):
            report(stored)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_correlations_do_not_depend_on_partitions(spark):
    """Sums are exact, so the order in which partitions are added changes no digit."""
    found = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append(correlation.pearson_matrix(sample_star(spark, FOLDER)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1]
