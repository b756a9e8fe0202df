"""Dashboard tables, each composed from the reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.rounding import cents, mean_money, percent, ratio
from tradeweave.operators import delivery, overview, sellers
from tradeweave.operators.customers import rfm_scores, segment_sums
from tradeweave.plans.grains import category_sales, delivered, order_sales, rows, state_deliveries
from tradeweave.plans.ordering import durable
from tradeweave.plans.star import Star


def mart_revenue_overview(star: Star, top: int = 10) -> DataFrame:
    """Revenue, orders and order value in total and for the leading categories."""
    total = order_sales(star).agg(
        rows().alias("orders"), F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue")
    ).select(F.lit("total").alias("section"), F.lit("all").alias("name"), "orders", "revenue")
    leading = (
        category_sales(star)
        .orderBy(F.desc("revenue"), "category")
        .limit(top)
        .select(F.lit("category").alias("section"), F.col("category").alias("name"), "orders", "revenue")
    )
    return (
        total.unionByName(leading)
        .withColumn("avg_order_value", mean_money(cents("revenue"), "orders"))
        .orderBy(F.desc("section"), F.desc("revenue"), "name")
    )


def mart_customer_segments(star: Star) -> DataFrame:
    """Segments by share of customers and revenue, and against everyone else."""
    sums = durable(segment_sums(rfm_scores(star)))  # one row per segment
    totals = sums.agg(
        F.sum("customer_count").alias("all_customers"),
        F.sum("total_revenue").alias("all_revenue"),
        F.sum("orders").alias("all_orders"),
    )
    joined = sums.crossJoin(F.broadcast(totals))  # one row
    others = F.col("all_customers") - F.col("customer_count")
    return joined.select(
        "customer_segment",
        "customer_count",
        percent("customer_count", "all_customers").alias("customer_pct"),
        F.col("total_revenue").alias("revenue"),
        percent(cents("total_revenue"), cents("all_revenue")).alias("revenue_pct"),
        ratio("orders", "customer_count", 2).alias("avg_orders"),
        ratio(F.col("all_orders") - F.col("orders"), others, 2).alias("rest_avg_orders"),
        mean_money(cents("total_revenue"), "customer_count").alias("avg_spend"),
        mean_money(cents(F.col("all_revenue") - F.col("total_revenue")), others).alias(
            "rest_avg_spend"
        ),
    ).orderBy(F.desc("revenue"), "customer_segment")


def mart_delivery(star: Star) -> DataFrame:
    """Delivery days and punctuality overall and by state, and scores by delivery speed."""
    states = state_deliveries(star).select(
        F.lit("state").alias("section"),
        F.col("customer_state").alias("name"),
        "deliveries",
        "days",
        "late",
    )
    overall = (
        delivered(star.orders)
        .filter(F.col("delivery_days_actual").isNotNull())
        .agg(
            rows().alias("deliveries"),
            F.sum("delivery_days_actual").alias("days"),
            F.sum("is_late_delivery").alias("late"),
        )
        .select(F.lit("overall").alias("section"), F.lit("all").alias("name"), "*")
    )
    timed = states.unionByName(overall).select(
        "section",
        "name",
        "deliveries",
        ratio("days", "deliveries", 1).alias("avg_delivery_days"),
        percent("late", "deliveries").alias("late_pct"),
        percent(F.col("deliveries") - F.col("late"), "deliveries").alias("on_time_pct"),
    )
    scored = delivery.delivery_review_buckets(star).select(
        F.lit("speed").alias("section"),
        F.col("delivery_bucket").alias("name"),
        F.col("order_count").alias("deliveries"),
        F.col("avg_review_score").alias("avg_review"),
    )
    return timed.unionByName(scored, allowMissingColumns=True).orderBy("section", "name")


def mart_product_seller(star: Star, leaders: int = 5) -> DataFrame:
    """The market in one row (sellers, leading sellers' share, prices) and its categories."""
    per_seller = durable(sellers.seller_sums(star))
    best = per_seller.orderBy(F.desc("revenue"), "seller_id").limit(leaders)
    market = (
        per_seller.agg(
            rows().alias("sellers"),
            *[
                F.sum(n).alias(n)
                for n in ("items", "revenue", "price", "freight", "freighted", "score", "scored")
            ],
        )
        .crossJoin(F.broadcast(best.agg(F.sum("revenue").alias("leaders_revenue"))))  # one row
        .select(
            F.lit("market").alias("section"),
            F.lit("all").alias("name"),
            "sellers",
            "revenue",
            percent(cents("leaders_revenue"), cents("revenue")).alias("leaders_share_pct"),
            mean_money(cents("price"), "items").alias("avg_price"),
            mean_money(cents("freight"), "freighted").alias("avg_freight"),
            ratio("score", "scored", 2).alias("avg_review"),
        )
    )
    categories = sellers.category_matrix(star).select(
        F.lit("category").alias("section"),
        F.col("category").alias("name"),
        F.col("total_revenue").alias("revenue"),
        "avg_price",
        "avg_freight",
        "avg_review",
    )
    return market.unionByName(categories, allowMissingColumns=True).orderBy(
        F.desc("section"), F.desc("revenue"), "name"
    )


def state_concentration(star: Star, top: int = 10) -> DataFrame:
    """The leading state's revenue against the rest of the top states; one row."""
    states = overview.revenue_by_state(star, top)
    # at most ``top`` rows
    sums = states.agg(
        F.max_by("customer_state", "total_revenue").alias("leading_state"),
        F.max("total_revenue").alias("leading_revenue"),
        F.sum("total_revenue").alias("all_revenue"),
    )
    rest = F.col("all_revenue") - F.col("leading_revenue")
    return sums.select(
        "leading_state",
        "leading_revenue",
        rest.alias("rest_revenue"),
        percent(cents("leading_revenue"), cents(rest)).alias("leading_vs_rest_pct"),
    )
