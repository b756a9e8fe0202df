"""Customer value: recency/frequency/monetary scores, segments, retention, lifetime value."""

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.buckets import pick, segment_of
from tradeweave.functions.dates import month_index
from tradeweave.functions.rounding import cents, mean_money, percent, ratio
from tradeweave.plans.grains import delivered, person_sales, rows
from tradeweave.plans.ordering import tiled, tiled_each
from tradeweave.plans.star import Star


NEVER = Decimal(10) ** 30  # sorts people without any dated order last


def rfm_metrics(star: Star) -> DataFrame:
    """Per person: days since the last order (against the newest order of any status),
    number of orders, and spend."""
    newest = star.orders.agg(F.max("order_purchase_timestamp").alias("newest"))
    return (
        person_sales(star)
        .crossJoin(F.broadcast(newest))  # one row
        .select(
            "customer_unique_id",
            F.datediff("newest", "last_order").alias("recency_days"),
            F.col("orders").alias("frequency"),
            F.col("revenue").alias("monetary"),
        )
    )


def rfm_scores(star: Star, tiles: int = 5) -> DataFrame:
    """Three 1-5 scores per person, their code, total and segment name.

    Equal values are ordered by person id, so a score never depends on the run.
    """
    longest_first = F.coalesce(-F.col("recency_days").cast("decimal(38,2)"), F.lit(NEVER))
    scored = tiled_each(
        rfm_metrics(star),
        "customer_unique_id",
        tiles,
        {"r_score": longest_first, "f_score": F.col("frequency"), "m_score": F.col("monetary")},
    )
    scores = [F.col(name) for name in ("r_score", "f_score", "m_score")]
    return scored.withColumns(
        {
            "rfm_segment_code": F.concat(*scores),
            "rfm_total": sum(scores[1:], scores[0]),
            "customer_segment": segment_of(*scores),
        }
    ).orderBy(F.desc("rfm_total"), "customer_unique_id")


def segment_sums(scored: DataFrame) -> DataFrame:
    """One row per segment of ``rfm_scores`` with unrounded sums."""
    return scored.groupBy("customer_segment").agg(
        rows().alias("customer_count"),
        F.sum("monetary").alias("total_revenue"),
        F.count("monetary").alias("spenders"),
        F.sum("recency_days").alias("recency"),
        F.count("recency_days").alias("dated"),
        F.sum("frequency").alias("orders"),
    )


def rfm_segment_summary(star: Star) -> DataFrame:
    everyone = Window.partitionBy()  # over one row per segment
    return (
        segment_sums(rfm_scores(star))
        .select(
            "customer_segment",
            "customer_count",
            percent("customer_count", F.sum("customer_count").over(everyone)).alias(
                "pct_of_customers"
            ),
            "total_revenue",
            percent(
                cents("total_revenue"), cents(F.sum("total_revenue").over(everyone))
            ).alias("revenue_share_pct"),
            ratio("recency", "dated", 0).alias("avg_recency"),
            ratio("orders", "customer_count", 1).alias("avg_frequency"),
            mean_money(cents("total_revenue"), "spenders").alias("avg_monetary"),
        )
        .orderBy(F.desc("total_revenue"), "customer_segment")
    )


def person_months(star: Star) -> DataFrame:
    """Per person, the set of months with a delivered order; bounded by the calendar."""
    per_account = (
        delivered(star.orders)
        .groupBy("customer_id")
        .agg(F.collect_set("order_month").alias("months"))
    )
    return (
        per_account.join(star.customers.select("customer_id", "customer_unique_id"), "customer_id")
        .select("customer_unique_id", F.explode("months").alias("month"))
        .groupBy("customer_unique_id")
        .agg(F.collect_set("month").alias("months"))
    )


def cohort_activity(star: Star) -> DataFrame:
    """Active people per cohort (month of first order) and months since then."""
    return (
        person_months(star)
        .select(F.array_min("months").alias("cohort_month"), F.explode("months").alias("month"))
        .select(
            "cohort_month",
            (month_index("month") - month_index("cohort_month")).alias("months_since_first"),
        )
        .groupBy("cohort_month", "months_since_first")
        .agg(rows().alias("active_customers"))
    )


def cohort_retention(star: Star) -> DataFrame:
    """Activity with the cohort's size and the share still active, in long form."""
    in_cohort = Window.partitionBy("cohort_month").orderBy("months_since_first")
    return (
        cohort_activity(star)
        .withColumn("cohort_size", F.first_value("active_customers").over(in_cohort))
        .withColumn("retention_pct", percent("active_customers", "cohort_size"))
        .orderBy("cohort_month", "months_since_first")
    )


def customer_clv(star: Star) -> DataFrame:
    """Lifetime value per person with a five-step tier; ``avg_order_value`` is per item."""
    value = person_sales(star).select(
        "customer_unique_id",
        F.col("orders").alias("total_orders"),
        F.col("revenue").alias("total_revenue"),
        mean_money(cents("revenue"), "valued").alias("avg_order_value"),
        F.datediff("last_order", "first_order").alias("customer_lifespan_days"),
        "first_order",
        "last_order",
    )
    return (
        tiled(value, "clv_tier", 5, F.asc("total_revenue"), F.asc("customer_unique_id"))
        .withColumn("clv_label", pick(F.col("clv_tier"), L.CLV_TIERS))
        .orderBy(F.desc("total_revenue"), "customer_unique_id")
    )
