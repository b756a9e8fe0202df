"""Delivery performance: by state, against reviews, over time, by weight, by seller."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.buckets import delivery_bucket, pick, weight_bucket
from tradeweave.functions.rounding import cents, mean_money, percent, ratio
from tradeweave.plans.grains import (
    account_states,
    delivered,
    item_sums,
    items_by_order,
    reviewed_orders,
    reviewed_sums,
    rows,
    state_deliveries,
)
from tradeweave.plans.ordering import durable, ntile_at
from tradeweave.plans.star import Star


def delivery_sla_by_state(star: Star) -> DataFrame:
    on_time = F.col("deliveries") - F.col("late")
    return (
        state_deliveries(star)
        .select(
            "customer_state",
            F.col("deliveries").alias("total_deliveries"),
            ratio("days", "deliveries", 1).alias("avg_delivery_days"),
            ratio("promised", "promises", 1).alias("avg_estimated_days"),
            ratio("early", "compared", 1, signed=True).alias("avg_delta_days"),
            "min_days",
            "max_days",
            F.col("late").alias("late_deliveries"),
            percent("late", "deliveries").alias("late_delivery_pct"),
            percent(on_time, "deliveries").alias("on_time_pct"),
        )
        .orderBy(F.desc("late_delivery_pct"), "customer_state")
    )


def delivery_review_buckets(star: Star) -> DataFrame:
    """Review scores by how early or late the order arrived."""
    timed = delivered(star.orders).filter(F.col("delivery_delta_days").isNotNull())
    score = F.col("review_score")
    scores = star.reviews.groupBy("order_id").agg(
        rows().alias("reviews"),
        F.sum("review_score").alias("score"),
        F.count("review_score").alias("scored"),
        F.count_if(score == 5).alias("five_star"),
        F.count_if(score == 4).alias("four_star"),
        F.count_if(score <= 2).alias("bad_reviews"),
    )
    return (
        timed.join(scores, "order_id")
        .groupBy(delivery_bucket(F.col("delivery_delta_days")).alias("delivery_bucket"))
        .agg(
            F.sum("reviews").alias("order_count"),
            F.sum("score").alias("score"),
            F.sum("scored").alias("scored"),
            *[F.sum(n).alias(n) for n in ("five_star", "four_star", "bad_reviews")],
        )
        .select(
            "delivery_bucket",
            "order_count",
            ratio("score", "scored", 2).alias("avg_review_score"),
            "five_star",
            "four_star",
            "bad_reviews",
            percent("bad_reviews", "order_count").alias("bad_review_pct"),
        )
        .orderBy("delivery_bucket")
    )


def monthly_delivery_trend(star: Star) -> DataFrame:
    """Monthly mean delivery days and whether the mean, to one decimal, got better."""
    in_time = Window.orderBy("order_month")  # one row per month
    now, before = F.col("avg_delivery_days"), F.col("prev_month_avg_days")
    return (
        delivered(star.orders)
        .filter(F.col("delivery_days_actual").isNotNull())
        .groupBy("order_month")
        .agg(
            rows().alias("total_deliveries"),
            F.sum("delivery_days_actual").alias("days"),
            F.sum("is_late_delivery").alias("late_count"),
        )
        .select(
            "order_month",
            "total_deliveries",
            ratio("days", "total_deliveries", 1).alias("avg_delivery_days"),
            "late_count",
            percent("late_count", "total_deliveries").alias("late_pct"),
        )
        .withColumn("prev_month_avg_days", F.lag("avg_delivery_days").over(in_time))
        .withColumns(
            {
                "delivery_time_change": now - before,
                "trend": F.when(now < before, L.IMPROVING)
                .when(now > before, L.WORSENING)
                .otherwise(L.STABLE),
            }
        )
        .orderBy("order_month")
    )


def freight_by_state_weight(star: Star) -> DataFrame:
    """Freight by customer state and parcel weight; the ratio is mean over mean."""
    weights = star.products.filter(F.col("product_weight_g").isNotNull()).select(
        "product_id", weight_bucket(F.col("product_weight_g")).alias("weight_bucket")
    )
    lines = (
        items_by_order(star).join(weights, "product_id")
        .groupBy("order_id", "weight_bucket")
        .agg(*item_sums())
    )
    timed = (
        delivered(star.orders)
        .filter(F.col("delivery_days_actual").isNotNull())
        .select("order_id", "customer_id", "delivery_days_actual")
    )
    sums = ("items", "price", "freight", "freighted", "days")
    per_account = (
        lines.join(timed, "order_id")
        .withColumn("days", F.col("items") * F.col("delivery_days_actual"))
        .groupBy("customer_id", "weight_bucket")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )
    return (
        per_account.join(account_states(star), "customer_id")
        .groupBy("customer_state", "weight_bucket")
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select(
            "customer_state",
            "weight_bucket",
            F.col("items").alias("item_count"),
            mean_money(cents("freight"), "freighted").alias("avg_freight"),
            mean_money(cents("price"), "items").alias("avg_price"),
            percent(
                cents("freight") * F.col("items"), cents("price") * F.col("freighted")
            ).alias("freight_as_pct_of_price"),
            ratio("days", "items", 1).alias("avg_delivery_days"),
        )
        .orderBy("customer_state", "weight_bucket")
    )


def seller_reliability(
    star: Star, min_orders: int = 10, top: int = 50, *, dedupe_reviews: bool = False
) -> DataFrame:
    """Sellers with the fewest late items first, ties by review mean, then by id.

    Only the first ``top`` rows are ranked: their rank and quartile depend on the rows
    before them and on the number of sellers, both known without sorting all sellers.
    """
    timed = reviewed_orders(star, dedupe_reviews=dedupe_reviews).filter(
        F.col("delivery_days_actual").isNotNull()
    )
    lines = items_by_order(star).groupBy("order_id", "seller_id").agg(*item_sums())
    sums = reviewed_sums(lines, timed, "seller_id").filter(F.col("orders") >= min_orders)
    sellers = durable(
        sums.join(star.sellers, "seller_id").select(
            "seller_id",
            "seller_city",
            "seller_state",
            F.col("orders").alias("total_orders"),
            ratio("days", "timed", 1).alias("avg_delivery_days"),
            F.col("late").alias("late_deliveries"),
            percent("late", "orders").alias("late_pct"),
            ratio("score", "scored", 2).alias("avg_review"),
        )
    )
    order = [F.asc("late_pct"), F.desc("avg_review")]
    best = sellers.orderBy(*order, "seller_id").limit(top)
    n = sellers.agg(rows().alias("n"))
    place = F.row_number().over(Window.orderBy(*order, "seller_id"))
    return (
        best.crossJoin(F.broadcast(n))  # one row
        .withColumns(
            {
                "reliability_rank": F.dense_rank().over(Window.orderBy(*order)),
                "reliability_quartile": ntile_at(place, F.col("n"), 4),
            }
        )
        .withColumn("reliability_tier", pick(F.col("reliability_quartile"), L.RELIABILITY_TIERS))
        .drop("n")
        .orderBy("reliability_rank", "seller_id")
    )
