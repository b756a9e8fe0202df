"""Common grains: facts summed to the key of the next join before they are joined.

A hot product, seller or customer shrinks to one row per order or task before anything is
shuffled by it, and the joins that follow are one row to one row.  Counting distinct orders
then is counting rows.  Joins of detail rows are left to Spark, which broadcasts small sides
and, with adaptive execution, splits the partitions of hot keys.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.plans.star import Star


def rows() -> Column:
    return F.count(F.lit(1))


def delivered(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("order_status") == L.DELIVERED)


def item_sums() -> list[Column]:
    """Whole-cent sums over order items; ``valued``/``freighted`` count the non-null ones."""
    return [
        rows().alias("items"),
        F.sum("total_value").alias("revenue"),
        F.count("total_value").alias("valued"),
        F.sum("price").alias("price"),
        F.sum("freight_value").alias("freight"),
        F.count("freight_value").alias("freighted"),
    ]


def items_by_order(star: Star) -> DataFrame:
    """Order items dealt by order: sums per order and more, and joins on the order, all use this
    one exchange.  (order, seller) is nearly unique, so summing before it would save little.
    Bucketed items are dealt already."""
    return star.order_items if star.dealt else star.order_items.repartition("order_id")


def order_sales(star: Star) -> DataFrame:
    """One row per delivered order that has items, with its item sums."""
    per_order = star.order_items.groupBy("order_id").agg(*item_sums())
    return delivered(star.orders).join(per_order, "order_id")


def account_sales(star: Star) -> DataFrame:
    """One row per buying account with city, state and person."""
    bought = "order_purchase_timestamp"
    per_account = (
        order_sales(star)
        .groupBy("customer_id")
        .agg(
            rows().alias("orders"),
            F.sum("items").alias("items"),
            F.sum("revenue").alias("revenue"),
            F.sum("valued").alias("valued"),
            F.min(bought).alias("first_order"),
            F.max(bought).alias("last_order"),
        )
    )
    return per_account.join(star.customers, "customer_id")


def person_sales(star: Star) -> DataFrame:
    """One row per person, who may own several accounts."""
    return (
        account_sales(star)
        .groupBy("customer_unique_id")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("valued").alias("valued"),
            F.min("first_order").alias("first_order"),
            F.max("last_order").alias("last_order"),
        )
    )


def product_categories(star: Star) -> DataFrame:
    return star.products.select("product_id", F.col("product_category_english").alias("category"))


def category_lines(star: Star) -> DataFrame:
    """One row per (order, category) of delivered orders with item sums."""
    kept = delivered(star.orders).select("order_id")
    lines = items_by_order(star).join(kept, "order_id", "left_semi")
    return (
        lines.join(product_categories(star), "product_id")
        .groupBy("order_id", "category")
        .agg(*item_sums())
    )


def category_sales(star: Star) -> DataFrame:
    """One row per category over delivered orders."""
    return (
        category_lines(star)
        .groupBy("category")
        .agg(
            rows().alias("orders"),
            F.sum("items").alias("items"),
            F.sum("revenue").alias("revenue"),
            F.sum("price").alias("price"),
        )
    )


def review_sums(star: Star, *, dedupe_reviews: bool = False) -> DataFrame:
    """Reviews per order: ``fan`` rows, and the scores' count, sum and number of bad ones.

    With ``dedupe_reviews`` an order counts once however often it was reviewed; its scores
    are still averaged over all its reviews.
    """
    return star.reviews.groupBy("order_id").agg(
        (F.lit(1).cast("long") if dedupe_reviews else rows()).alias("fan"),
        F.sum("review_score").alias("score"),
        F.count("review_score").alias("scored"),
        F.count_if(F.col("review_score") <= 2).alias("bad"),
    )


def reviewed_orders(star: Star, *, dedupe_reviews: bool = False) -> DataFrame:
    """Delivered orders with their review sums; an order without reviews has ``fan`` 1.

    Joining items to reviews repeats each item once per review.  ``fan`` carries that
    multiplicity as a weight instead, so no rows are multiplied.
    """
    sums = review_sums(star, dedupe_reviews=dedupe_reviews)
    none = {"fan": 1, "score": 0, "scored": 0, "bad": 0}
    return (
        delivered(star.orders)
        .select("order_id", "delivery_days_actual", "is_late_delivery")
        .join(sums, "order_id", "left")
        .fillna(none)
    )


def reviewed_sums(
    lines: DataFrame,
    orders: DataFrame,
    *keys: str,
    orders_counted: Column | None = None,
    more: Sequence[Column] = (),
) -> DataFrame:
    """Item-by-review sums per key from (order, key) lines, weighting rows by ``fan``.

    ``lines`` holds one row per order and key set with the sums of ``item_sums``; lines
    finer than the keys need a distinct count as ``orders_counted``.
    """
    fan, items = F.col("fan"), F.col("items")
    return (
        lines.join(orders, "order_id")
        .groupBy(*keys)
        .agg(
            (rows() if orders_counted is None else orders_counted).alias("orders"),
            F.sum(items * fan).alias("items"),
            F.sum(F.col("revenue") * fan).alias("revenue"),
            F.sum(F.col("price") * fan).alias("price"),
            F.sum(F.col("freight") * fan).alias("freight"),
            F.sum(F.col("freighted") * fan).alias("freighted"),
            F.sum(items * F.col("score")).alias("score"),
            F.sum(items * F.col("scored")).alias("scored"),
            F.sum(items * F.col("bad")).alias("bad"),
            F.sum(items * fan * F.col("is_late_delivery")).alias("late"),
            F.sum(items * fan * F.col("delivery_days_actual")).alias("days"),
            F.sum(F.when(F.col("delivery_days_actual").isNotNull(), items * fan)).alias("timed"),
            *more,
        )
    )


def account_states(star: Star) -> DataFrame:
    return star.customers.select("customer_id", "customer_state")


def account_deliveries(star: Star) -> DataFrame:
    """Timed deliveries per account, joined to its state."""
    days, promised, early = (
        "delivery_days_actual",
        "delivery_days_estimated",
        "delivery_delta_days",
    )
    per_account = (
        delivered(star.orders)
        .filter(F.col(days).isNotNull())
        .groupBy("customer_id")
        .agg(
            rows().alias("deliveries"),
            F.sum(days).alias("days"),
            F.sum(promised).alias("promised"),
            F.count(promised).alias("promises"),
            F.sum(early).alias("early"),
            F.count(early).alias("compared"),
            F.min(days).alias("min_days"),
            F.max(days).alias("max_days"),
            F.sum("is_late_delivery").alias("late"),
        )
    )
    return per_account.join(account_states(star), "customer_id")


def state_deliveries(star: Star) -> DataFrame:
    """The same sums per customer state."""
    return (
        account_deliveries(star)
        .groupBy("customer_state")
        .agg(
            *[
                F.sum(name).alias(name)
                for name in ("deliveries", "days", "promised", "promises", "early", "compared", "late")
            ],
            F.min("min_days").alias("min_days"),
            F.max("max_days").alias("max_days"),
        )
    )

