"""Baseline figures: totals, status and score splits, monthly volume, top lists."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.rounding import cents, mean_money, percent, ratio
from tradeweave.plans.grains import (
    account_sales,
    category_sales,
    delivered,
    order_sales,
    rows,
    state_deliveries,
)
from tradeweave.plans.star import Star


def baseline_kpis(star: Star) -> DataFrame:
    """Distinct orders, accounts, products and sellers, revenue and its means; one row."""
    per_order = order_sales(star).agg(
        rows().alias("total_orders"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.sum("revenue").alias("total_revenue"),
        F.coalesce(F.sum("valued"), F.lit(0)).alias("valued"),
    )
    kept = delivered(star.orders).select("order_id")
    sold = star.order_items.select("order_id", "product_id", "seller_id")
    per_kind = sold.join(kept, "order_id", "left_semi").agg(
        F.count_distinct("product_id").alias("total_products"),
        F.count_distinct("seller_id").alias("total_sellers"),
    )
    return (
        per_order.crossJoin(F.broadcast(per_kind))  # one row each
        .select(
            "total_orders",
            "total_customers",
            "total_products",
            "total_sellers",
            "total_revenue",
            "valued",
        )
        .withColumns(
            {
                "avg_item_value": mean_money(cents("total_revenue"), "valued"),
                "avg_order_value": mean_money(cents("total_revenue"), "total_orders"),
            }
        )
        .drop("valued")
    )


def _split(counts: DataFrame, name: str) -> DataFrame:
    """Adds each row's percentage of the total; ``counts`` has one row per status or score."""
    return counts.withColumn("pct", percent(name, F.sum(name).over(Window.partitionBy())))


def order_status_distribution(star: Star) -> DataFrame:
    counts = star.orders.groupBy("order_status").agg(rows().alias("order_count"))
    return _split(counts, "order_count").orderBy(F.desc("order_count"), "order_status")


def monthly_order_volume(star: Star) -> DataFrame:
    return (
        delivered(star.orders)
        .groupBy("order_month")
        .agg(rows().alias("orders"), F.count_distinct("customer_id").alias("customers"))
        .orderBy("order_month")
    )


def revenue_by_state(star: Star, top: int = 10) -> DataFrame:
    return (
        account_sales(star)
        .groupBy("customer_state")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("valued").alias("valued"),
        )
        .orderBy(F.desc("total_revenue"), "customer_state")
        .limit(top)
        .withColumn("avg_item_value", mean_money(cents("total_revenue"), "valued"))
        .drop("valued")
    )


def top_categories(star: Star, top: int = 10) -> DataFrame:
    return (
        category_sales(star)
        .orderBy(F.desc("revenue"), "category")
        .limit(top)
        .select(
            "category",
            F.col("orders").alias("order_count"),
            F.col("items").alias("items_sold"),
            F.col("revenue").alias("total_revenue"),
            mean_money(cents("price"), "items").alias("avg_price"),
        )
    )


def payment_type_distribution(star: Star) -> DataFrame:
    sums = star.payments.groupBy("payment_type").agg(
        rows().alias("payment_count"),
        F.sum("payment_value").alias("total_value"),
        F.sum("payment_installments").alias("installments"),
        F.count("payment_installments").alias("planned"),
    )
    return (
        _split(sums, "payment_count")
        .withColumns(
            {
                "avg_value": mean_money(cents("total_value"), "payment_count"),
                "avg_installments": ratio("installments", "planned", 1),
            }
        )
        .drop("installments", "planned")
        .orderBy(F.desc("payment_count"), "payment_type")
    )


def review_score_distribution(star: Star) -> DataFrame:
    counts = star.reviews.groupBy("review_score").agg(rows().alias("review_count"))
    return _split(counts, "review_count").orderBy("review_score")


def slowest_states(star: Star, top: int = 10) -> DataFrame:
    """States with the longest mean delivery; the sort key is the mean to one decimal."""
    return (
        state_deliveries(star)
        .select(
            "customer_state",
            "deliveries",
            ratio("days", "deliveries", 1).alias("avg_delivery_days"),
            ratio("promised", "promises", 1).alias("avg_estimated_days"),
            ratio("early", "compared", 1, signed=True).alias("avg_delta_days"),
            percent("late", "deliveries").alias("late_pct"),
        )
        .orderBy(F.desc("avg_delivery_days"), "customer_state")
        .limit(top)
    )
