"""Hand-made rows for the rules that are easy to get wrong."""

import math
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions import buckets, stats
from tradeweave.functions.dates import as_moment, elapsed_days, month_index, month_of
from tradeweave.functions.rounding import mean_money, percent, ratio
from tradeweave.functions.text import title_case
from tradeweave.operators import cleaning, quality
from tradeweave.schemas import STAR


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_elapsed_days_round_down(spark):
    rows = [
        (datetime(2020, 1, 2), datetime(2020, 1, 1)),
        (datetime(2020, 1, 1, 23, 59, 59), datetime(2020, 1, 1)),
        (datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 0, 1)),
        (datetime(2020, 1, 1), datetime(2020, 1, 2)),
        (datetime(2020, 1, 1), datetime(2020, 1, 2, 0, 0, 1)),
        (None, datetime(2020, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "later timestamp_ntz, earlier timestamp_ntz")
    found = [r[0] for r in df.select(elapsed_days("later", "earlier")).collect()]
    assert found == [1, 0, -1, -1, -2, None]


def test_moments_from_text(spark):
    df = spark.createDataFrame([("2018-01-31 10:00:00",), ("soon",), (None,)], "v string")
    found = [r[0] for r in df.select(as_moment(df, "v")).collect()]
    assert found == [datetime(2018, 1, 31, 10), None, None]
    months = df.select(as_moment(df, "v").alias("m")).select(month_of("m"))
    assert months.first()[0] == "2018-01"
    assert column(spark, ["2018-01", "2017-12"], "string", month_index("v")) == [24217, 24216]


def test_title_case_matches_python(spark):
    texts = ["d'oeste", "mogi-guacu", "são paulo", "2nd street", "  SP ", "x9y", ""]
    found = column(spark, texts, "string", title_case("v"))
    assert found == [t.strip().title() for t in texts]
    assert column(spark, [None], "string", title_case("v")) == [None]


@pytest.mark.parametrize(
    "num, den, places, expected",
    [(201, 200, 2, "1.01"), (-201, 200, 2, "-1.01"), (1, 3, 4, "0.3333"), (5, 2, 0, "3"),
     (-1, 2, 0, "-1"), (10**30, 10**29, 2, "10.00")],
)
def test_ratio_rounds_half_away_from_zero(spark, num, den, places, expected):
    value = spark.range(1).select(ratio(F.lit(Decimal(num)), F.lit(Decimal(den)), places, signed=num < 0))
    assert value.first()[0] == Decimal(expected)


def test_ratio_by_zero_is_null(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(0), 2), percent(F.lit(1), F.lit(8)), mean_money(F.lit(1001), F.lit(2))
    ).first()
    assert tuple(row) == (None, Decimal("12.50"), Decimal("5.01"))


def test_installment_buckets(spark):
    counts = [0, None, 1, 3, 4, 6, 7, 10, 11]
    found = column(spark, counts, "int", buckets.installment_bucket(F.col("v")))
    names = [n for _, n in L.INSTALLMENT_BUCKETS]
    assert found == [
        L.INSTALLMENT_REST, L.INSTALLMENT_REST, names[0], names[1], names[2], names[2],
        names[3], names[3], L.INSTALLMENT_REST,
    ]


def test_delivery_buckets_differ_at_minus_five(spark):
    days = [-1000, -999, -6, -5, -1, 0, 1, 9, 10, 999, 1000, None]
    b = [*(name for _, name in L.DELIVERY_BUCKETS), L.DELIVERY_REST]
    assert column(spark, days, "int", buckets.delivery_bucket(F.col("v"))) == [
        b[4], b[4], b[4], b[3], b[3], b[2], b[1], b[1], b[0], b[0], b[0], b[4],
    ]
    c = [n for _, _, n in L.DELIVERY_CUTS]
    assert column(spark, days, "int", buckets.delivery_cut(F.col("v"))) == [
        None, None, c[0], c[0], c[1], c[2], c[3], c[3], c[4], c[4], None, None,
    ]


def test_weight_buckets(spark):
    found = column(spark, [500, 501, 2000, 5000, 5001], "int", buckets.weight_bucket(F.col("v")))
    w = [n for _, n in L.WEIGHT_BUCKETS]
    assert found == [w[0], w[1], w[1], w[2], L.WEIGHT_REST]


def test_segment_order_matters(spark):
    df = spark.createDataFrame(
        [(5, 4, 4), (5, 4, 3), (4, 2, 5), (3, 3, 3), (3, 2, 5), (3, 5, 2), (2, 3, 1), (1, 2, 3), (1, 1, 1)],
        "r int, f int, m int",
    )
    found = [r[0] for r in df.select(buckets.segment_of(F.col("r"), F.col("f"), F.col("m"))).collect()]
    assert found == [
        L.CHAMPIONS, L.LOYAL, L.NEW, L.POTENTIAL, L.NEED_ATTENTION, L.NEED_ATTENTION,
        L.AT_RISK, L.CANT_LOSE, L.LOST,
    ]


@pytest.mark.parametrize(
    "t, df, p",
    [(2.0, 10, 0.0733880), (12.7062047, 1, 0.05), (0.0, 5, 1.0), (3.5, 47.3, 0.0010254),
     (1.959963985, 1e9, 0.05), (1.959963985, 1e12, 0.05), (float("inf"), 3, 0.0)],
)
def test_t_distribution(spark, t, df, p):
    assert p_values(spark, [(t, df)]) == [pytest.approx(p, abs=1e-6)]


def p_values(spark, tests):
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(tests)], "i int, t double, df double")
    p = stats.t_test_p(F.col("t"), F.col("df"))
    return [r["p"] for r in df.coalesce(1).select("i", p.alias("p")).orderBy("i").collect()]


NODES = np.polynomial.legendre.leggauss(300)


def plain_p(t, df):
    """By integrating the density, the tail folded onto an interval."""
    angle, weight = NODES
    low = math.atan(abs(t) / math.sqrt(df))
    at = low + (math.pi / 2 - low) * (angle + 1) / 2
    log_constant = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return 2 * float((weight * np.exp(log_constant + (df - 1) * np.log(np.cos(at)))).sum()) * (math.pi / 2 - low) / 2


def test_t_distribution_against_an_integral(spark):
    tests = [(t, df) for t in (0.01, 0.7, 2.0, 3.99, 4.0, 6.0, 25.0, -2.5) for df in (1, 2, 3.5, 10, 300, 5000)]
    for (t, df), p in zip(tests, p_values(spark, tests), strict=True):
        assert p == pytest.approx(plain_p(t, df), rel=1e-8, abs=1e-13), (t, df)


def test_t_distribution_nears_the_normal_one(spark):
    tests = [(t, df) for t in (0.001, 0.7, 2.0, 3.9, 4.1, 6.0) for df in (9.9e5, 1e7, 1e9, 1e11)]
    for (t, df), p in zip(tests, p_values(spark, tests), strict=True):
        assert p == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-4 if df > 1e6 else 1e-2), (t, df)
    (below, above) = p_values(spark, [(3.0, 1e6), (3.0, 1e6 + 1)])  # where the way changes
    assert below == pytest.approx(above, rel=1e-8)


def test_p_value_without_convergence_is_unknown(spark, monkeypatch):
    monkeypatch.setattr(stats, "CONVERGED", -1.0)
    assert p_values(spark, [(2.0, 10)]) == [None]


def test_p_value_of_nothing(spark):
    nan = float("nan")
    assert p_values(spark, [(nan, 3), (2.0, nan), (2.0, 0), (2.0, -1)]) == [None] * 4


def test_significance_marks(spark):
    p = [0.0005, 0.001, 0.02, 0.05, None]
    found = column(spark, p, "double", stats.significance_label(F.col("v")))
    marks = [m for _, m in L.SIGNIFICANCE_MARKS]
    assert found == [marks[0], marks[1], marks[2], L.NOT_SIGNIFICANT, None]
    assert column(spark, [0.04, 0.05], "double", stats.decision(F.col("v"))) == [
        L.REJECT, L.FAIL_TO_REJECT,
    ]


def test_keep_first_by_place_in_file(spark):
    rows = [("a", 3, "late"), ("a", 1, "first"), ("b", 2, "only"), ("a", 2, "mid")]
    df = spark.createDataFrame(rows, "k string, ingest_id int, v string").repartition(4)
    kept = cleaning.keep_first(df, "k")
    assert sorted(r["v"] for r in kept.collect()) == ["first", "only"]
    # copies are dropped before the shuffle
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_clean_orders(spark):
    rows = [
        ("o1", "c", "delivered", "2018-01-01 12:00:00", "bad", None, "2018-01-05 00:00:01", "2018-01-05"),
        ("o2", "c", "delivered", "2018-01-01 12:00:00", None, None, "2018-01-05 00:00:00", "2018-01-05"),
        ("o3", "c", "shipped", "2018-01-01 12:00:00", None, None, None, "2018-01-05"),
        ("o1", "c", "canceled", "2017-01-01 12:00:00", None, None, None, None),
    ]
    names = [f.name for f in STAR["fact_orders"].fields][:8]
    raw = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)], ", ".join(f"{n} string" for n in names) + ", ingest_id int"
    )
    found = {r["order_id"]: r for r in cleaning.clean_orders(raw).collect()}
    assert found["o1"]["order_approved_at"] is None
    assert (found["o1"]["delivery_delta_days"], found["o1"]["is_late_delivery"]) == (-1, 1)
    assert (found["o2"]["delivery_delta_days"], found["o2"]["is_late_delivery"]) == (0, 0)
    assert (found["o3"]["delivery_days_actual"], found["o3"]["is_late_delivery"]) == (None, 0)
    assert found["o1"]["order_month"] == "2018-01"


def test_clean_geolocation(spark):
    rows = [
        (0, "z", Decimal("1.0"), Decimal("5.0"), None, "sp"),
        (1, "z", Decimal("2.0"), Decimal("6.0"), "são paulo", "rj"),
        (2, "z", Decimal("4.0"), Decimal("7.000001"), "x", "sp"),
        (3, "z", Decimal("9.0"), None, "x", "sp"),
        (4, None, Decimal("9.0"), None, "x", "sp"),
    ]
    raw = spark.createDataFrame(
        rows,
        "ingest_id int, geolocation_zip_code_prefix string, geolocation_lat decimal(20,15), "
        "geolocation_lng decimal(20,15), geolocation_city string, geolocation_state string",
    )
    (row,) = cleaning.clean_geolocation(raw).collect()
    assert tuple(row) == ("z", Decimal("3.000000"), Decimal("6.000000"), "São Paulo", "SP")


def test_clean_items_payments_reviews(spark):
    items = spark.createDataFrame(
        [("o", 1, "p", "s", "2018-01-01", Decimal("1.00"), Decimal("0.50")),
         ("o", 2, "p", "s", None, Decimal("0.00"), Decimal("0.50")),
         ("o", 3, "p", "s", None, None, Decimal("0.50"))],
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "shipping_limit_date string, price decimal(12,2), freight_value decimal(12,2)",
    )
    (item,) = cleaning.clean_order_items(items).collect()
    assert item["total_value"] == Decimal("1.50")
    reviews = spark.createDataFrame(
        [(0, "r1", "o", 5, None, None, "2018-01-01", "x"), (1, "r1", "o", 1, "t", "m", None, None),
         (2, "r2", "o", 6, None, None, None, None), (3, "r3", "o", None, None, None, None, None)],
        "ingest_id int, review_id string, order_id string, review_score int, "
        "review_comment_title string, review_comment_message string, "
        "review_creation_date string, review_answer_timestamp string",
    )
    (review,) = cleaning.clean_reviews(reviews).collect()
    assert review["review_score"] == 5 and review["review_comment_title"] == ""
    assert review["review_creation_date"].date() == date(2018, 1, 1)
    assert review["review_answer_timestamp"] is None


def test_broken_keys_are_found(spark):
    frames = {t: spark.createDataFrame([], STAR[t]) for t in STAR}
    orders = frames["fact_orders"]
    two = spark.createDataFrame([("o", "ghost"), ("o", None), (None, "c")], "order_id string, customer_id string")
    frames["fact_orders"] = orders.select("order_id", "customer_id").unionByName(two)
    keys = {r["table"]: r for r in quality.pk_duplicates(frames).collect()}
    assert tuple(keys["fact_orders"])[1:] == (1, 1, 1)
    links = {(r["table"], r["column"]): r for r in quality.fk_orphans(frames).collect()}
    assert links[("fact_orders", "customer_id")]["orphan_rows"] == 2
