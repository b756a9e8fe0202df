"""Revenue over time, by category, by payment plan and by spender."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.buckets import installment_bucket, pick
from tradeweave.functions.rounding import cents, mean_money, percent
from tradeweave.plans.grains import category_sales, delivered, order_sales, person_sales, rows
from tradeweave.plans.ordering import tiled
from tradeweave.plans.star import Star


def revenue_waterfall(star: Star) -> DataFrame:
    """Monthly revenue with running total and month-on-month growth.

    The windows have no partition key but run over one row per month.
    """
    months = (
        order_sales(star)
        .groupBy("order_month")
        .agg(
            rows().alias("total_orders"),
            F.sum("revenue").alias("monthly_revenue"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
    )
    in_time = Window.orderBy("order_month")
    previous = F.col("prev_month_revenue")
    return (
        months.withColumns(
            {
                "avg_order_value": mean_money(cents("monthly_revenue"), "total_orders"),
                "running_total_revenue": F.sum("monthly_revenue").over(in_time),
                "prev_month_revenue": F.lag("monthly_revenue").over(in_time),
            }
        )
        .withColumn(
            "mom_growth_pct",
            percent(cents(F.col("monthly_revenue") - previous), cents(previous), signed=True),
        )
        .orderBy("order_month")
    )


def pareto_abc(star: Star) -> DataFrame:
    """Categories by revenue with cumulative share and ABC class; one row per category."""
    by_revenue = Window.orderBy(F.desc("revenue"))
    total = F.sum("revenue").over(Window.partitionBy())
    reached = F.col("cumulative_pct")
    return (
        category_sales(star)
        .filter(F.col("category").isNotNull())
        .select(
            "category",
            "revenue",
            F.col("orders").alias("order_count"),
            F.col("items").alias("items_sold"),
            percent(cents("revenue"), cents(total)).alias("revenue_pct"),
            percent(cents(F.sum("revenue").over(by_revenue)), cents(total)).alias("cumulative_pct"),
            F.row_number().over(Window.orderBy(F.desc("revenue"), "category")).alias("rank_num"),
        )
        .withColumn(
            "abc_class",
            F.when(reached <= L.ABC_A_LIMIT, L.ABC_A)
            .when(reached <= L.ABC_B_LIMIT, L.ABC_B)
            .otherwise(L.ABC_C),
        )
        .orderBy("rank_num")
    )


def payment_installment_analysis(star: Star) -> DataFrame:
    """Payments of delivered orders by type and installment plan."""
    plan = installment_bucket(F.col("payment_installments")).alias("installment_bucket")
    per_order = star.payments.repartition("order_id").groupBy("order_id", "payment_type", plan).agg(
        rows().alias("payments"), F.sum("payment_value").alias("value")
    )
    plans = (
        per_order.join(delivered(star.orders).select("order_id"), "order_id")
        .groupBy("payment_type", "installment_bucket")
        .agg(
            rows().alias("order_count"),
            F.sum("payments").alias("payments"),
            F.sum("value").alias("total_payment_value"),
        )
    )
    return (
        plans.withColumns(
            {
                "avg_payment_value": mean_money(cents("total_payment_value"), "payments"),
                "pct_of_orders": percent(
                    "order_count", F.sum("order_count").over(Window.partitionBy())
                ),
            }
        )
        .drop("payments")
        .orderBy("payment_type", F.desc("avg_payment_value"), "installment_bucket")
    )


def daily_revenue_ma7(star: Star, days: int = 7) -> DataFrame:
    """Daily revenue with a moving mean over the last ``days`` rows (days without sales
    are not rows) and a running total; the windows run over one row per day."""
    daily = (
        order_sales(star)
        .groupBy(F.to_date("order_purchase_timestamp").alias("order_date"))
        .agg(rows().alias("daily_orders"), F.sum("revenue").alias("daily_revenue"))
    )
    in_time = Window.orderBy("order_date")
    recent = in_time.rowsBetween(1 - days, 0)
    return daily.withColumns(
        {
            f"moving_avg_{days}d": mean_money(
                cents(F.sum("daily_revenue").over(recent)), F.count("daily_revenue").over(recent)
            ),
            "cumulative_revenue": F.sum("daily_revenue").over(in_time),
        }
    ).orderBy("order_date")


def revenue_concentration(star: Star) -> DataFrame:
    """People in five equal groups by spend, and what each group brings in."""
    spend = person_sales(star).select(
        "customer_unique_id", F.col("revenue").alias("total_spend")
    )
    fifths = tiled(
        spend, "spend_quintile", 5, F.desc("total_spend"), F.asc("customer_unique_id")
    )
    return (
        fifths.groupBy("spend_quintile")
        .agg(
            rows().alias("customer_count"),
            F.sum("total_spend").alias("segment_revenue"),
            F.count("total_spend").alias("spenders"),
        )
        .select(
            "spend_quintile",
            pick(F.col("spend_quintile"), L.SPEND_QUINTILES).alias("segment"),
            "customer_count",
            "segment_revenue",
            mean_money(cents("segment_revenue"), "spenders").alias("avg_spend"),
            percent(
                cents("segment_revenue"),
                cents(F.sum("segment_revenue").over(Window.partitionBy())),
            ).alias("revenue_share_pct"),
        )
        .orderBy("spend_quintile")
    )
