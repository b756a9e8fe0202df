"""The tables behind the exploratory charts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.rounding import percent, ratio
from tradeweave.operators import overview
from tradeweave.plans.boxes import box_stats
from tradeweave.plans.grains import account_states, category_sales, delivered, order_sales, rows
from tradeweave.plans.star import Star


def monthly_revenue(star: Star) -> DataFrame:
    return (
        order_sales(star)
        .groupBy("order_month")
        .agg(rows().alias("total_orders"), F.sum("revenue").alias("revenue"))
        .orderBy("order_month")
    )


def order_status_counts(star: Star) -> DataFrame:
    return overview.order_status_distribution(star).select("order_status", "order_count")


def top_categories_revenue(star: Star, top: int = 10) -> DataFrame:
    return (
        category_sales(star)
        .filter(F.col("category").isNotNull())
        .orderBy(F.desc("revenue"), "category")
        .limit(top)
        .select("category", "revenue")
    )


def payment_type_share(star: Star) -> DataFrame:
    """Payments per type, their share to one decimal, and the number of all payments."""
    total = F.sum("payment_count").over(Window.partitionBy())  # over one row per type
    return (
        star.payments.groupBy("payment_type")
        .agg(rows().alias("payment_count"))
        .withColumns({"pct": percent("payment_count", total, 1), "all_payments": total})
        .orderBy(F.desc("payment_count"), "payment_type")
    )


def review_score_mean(star: Star) -> DataFrame:
    """Reviews per score, their share, and the mean over all reviews."""
    everything = Window.partitionBy()  # over one row per score
    n = F.sum("review_count").over(everything)
    weighted = F.sum(F.col("review_score") * F.col("review_count")).over(everything)
    return (
        star.reviews.groupBy("review_score")
        .agg(rows().alias("review_count"))
        .withColumns({"pct": percent("review_count", n, 1), "mean_score": ratio(weighted, n, 2)})
        .orderBy("review_score")
    )


def delivery_box_by_state(star: Star, top: int = 10, max_days: int = 60) -> DataFrame:
    """Box-plot figures of delivery days for the states with most deliveries."""
    per_account = (
        delivered(star.orders)
        .filter(F.col("delivery_days_actual").between(0, max_days))
        .groupBy("customer_id", "delivery_days_actual")
        .agg(rows().alias("rows"))
    )
    # at most (max_days + 1) rows per state from here on
    counts = (
        per_account.join(account_states(star), "customer_id")
        .groupBy("customer_state", "delivery_days_actual")
        .agg(F.sum("rows").alias("rows"))
    )
    in_state = Window.partitionBy("customer_state")
    volume = counts.withColumn("volume", F.sum("rows").over(in_state))
    by_volume = Window.orderBy(F.desc("volume"), "customer_state")
    kept = volume.withColumn("place", F.dense_rank().over(by_volume)).filter(F.col("place") <= top)
    kept = kept.select("customer_state", "delivery_days_actual", "rows")
    overall = kept.agg(
        F.percentile("delivery_days_actual", F.lit(0.5), F.col("rows")).alias("overall_median")
    )
    return (
        box_stats(kept, ["customer_state"], "delivery_days_actual", "rows")
        .crossJoin(F.broadcast(overall))  # one row
        .orderBy(F.desc("median"), "customer_state")
    )


def state_revenue_top10(star: Star, top: int = 10) -> DataFrame:
    return overview.revenue_by_state(star, top).select(
        "customer_state",
        F.col("total_revenue").alias("revenue"),
        F.col("total_orders").alias("orders"),
    )


def order_heatmap(star: Star) -> DataFrame:
    """Delivered orders by weekday (rows, Monday first) and hour (24 columns)."""
    moment = F.col("order_purchase_timestamp")
    hours = [f"hour_{h}" for h in range(24)]
    counted = (
        delivered(star.orders)
        .filter(moment.isNotNull())
        .select(
            F.weekday(moment).alias("day_num"),
            F.concat(F.lit("hour_"), F.hour(moment)).alias("hour"),
        )
        .groupBy("day_num")
        .pivot("hour", hours)
        .count()
    )
    names = F.array(*[F.lit(day) for day in L.WEEKDAYS])
    days = star.orders.sparkSession.range(7).select(
        F.col("id").cast("int").alias("day_num"),
        F.element_at(names, (F.col("id") + 1).cast("int")).alias("day_name"),
    )
    return (
        days.join(F.broadcast(counted), "day_num", "left")  # seven rows
        .fillna(0, hours)
        .orderBy("day_num")
        .select("day_name", *hours)
    )
