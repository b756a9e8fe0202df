"""Reports over an empty star keep their columns and do not fail."""

import pytest

from tradeweave import registry
from tradeweave.plans.star import Star
from tradeweave.schemas import STAR

# one row of totals, or one per weekday, whatever the input
ROWS = {
    "surrogate_keys": 2,
    "baseline_kpis": 1,
    "rfm_profile": 1,
    "order_heatmap": 7,
    "cohort_insights": 1,
    "state_concentration": 1,
    "welch_late_vs_ontime": 1,
    "spearman_freight_review": 1,
    "pearson_weight_delivery": 1,
    "hypothesis_summary": 3,
    "weight_delivery_regression": 100,
    "mart_revenue_overview": 1,
    "mart_delivery": 1,
    "mart_product_seller": 1,
    "pearson_matrix": 36,
    "spearman_matrix": 36,
}
REPORTS = list(registry.STAR_REPORTS)


@pytest.fixture(scope="module")
def empty(spark):
    frames = {t: spark.createDataFrame([], schema) for t, schema in STAR.items()}
    return Star({t: lambda df=df: df for t, df in frames.items()})


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__name__)
def test_empty(empty, report):
    df = report(empty)
    assert df.columns and len(df.collect()) == ROWS.get(report.__name__, 0)
