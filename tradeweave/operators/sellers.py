"""Sellers, categories, baskets and products."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.rounding import cents, mean_money, percent, ratio
from tradeweave.plans.grains import (
    category_lines,
    delivered,
    item_sums,
    items_by_order,
    product_categories,
    reviewed_orders,
    reviewed_sums,
    rows,
)
from tradeweave.plans.ordering import ntile_at, standing
from tradeweave.plans.star import Star


def seller_sums(star: Star, *, dedupe_reviews: bool = False) -> DataFrame:
    """Item-by-review sums of delivered orders per seller, with city and state."""
    lines = items_by_order(star).groupBy("order_id", "seller_id").agg(*item_sums())
    orders = reviewed_orders(star, dedupe_reviews=dedupe_reviews)
    return reviewed_sums(lines, orders, "seller_id").join(star.sellers, "seller_id")


def seller_performance(star: Star, *, dedupe_reviews: bool = False) -> DataFrame:
    """All sellers by revenue: rank, decile, share and running revenue.

    Tiles, ranks and running sums come from one order; sellers with equal revenue share the latter.
    """
    sellers = seller_sums(star, dedupe_reviews=dedupe_reviews).select(
        "seller_id",
        "seller_city",
        "seller_state",
        F.col("orders").alias("total_orders"),
        F.col("items").alias("total_items_sold"),
        F.col("revenue").alias("total_revenue"),
        mean_money(cents("price"), "items").alias("avg_item_price"),
        mean_money(cents("freight"), "freighted").alias("avg_freight"),
        ratio("score", "scored", 2).alias("avg_review_score"),
        F.col("bad").alias("bad_reviews"),
    )
    placed = standing(sellers, "total_revenue", "seller_id")
    return placed.select(
        *sellers.columns,
        ntile_at(F.col("position"), F.col("n"), 10).alias("revenue_decile"),
        F.col("dense_rank").alias("revenue_rank"),
        F.col("running").alias("cumulative_revenue"),
        percent(cents("total_revenue"), cents("everything"), 4).alias("revenue_share_pct"),
        percent(cents("running"), cents("everything")).alias("cumulative_revenue_pct"),
    ).orderBy(F.desc("total_revenue"), "seller_id")


def category_matrix(star: Star, *, dedupe_reviews: bool = False) -> DataFrame:
    """Categories with three ranks, each over unrounded figures; one row per category."""
    orders = reviewed_orders(star, dedupe_reviews=dedupe_reviews)
    # one division of whole numbers: equal means stay equal, different ones stay apart
    mean_score = F.when(F.col("scored") > 0, F.col("score").cast("double") / F.col("scored"))
    return (
        reviewed_sums(category_lines(star), orders, "category")
        .filter(F.col("category").isNotNull())
        .select(
            "category",
            F.col("orders").alias("order_count"),
            F.col("items").alias("items_sold"),
            F.col("revenue").alias("total_revenue"),
            mean_money(cents("price"), "items").alias("avg_price"),
            mean_money(cents("freight"), "freighted").alias("avg_freight"),
            ratio("score", "scored", 2).alias("avg_review"),
            ratio("days", "timed", 1).alias("avg_delivery_days"),
            percent("late", "items").alias("late_delivery_pct"),
            F.dense_rank().over(Window.orderBy(F.desc("revenue"))).alias("revenue_rank"),
            F.dense_rank().over(Window.orderBy(mean_score.desc())).alias("satisfaction_rank"),
            F.dense_rank().over(Window.orderBy(F.desc("orders"))).alias("volume_rank"),
        )
        .orderBy(F.desc("total_revenue"), "category")
    )


def basket_pairs(star: Star, min_orders: int = 20, top: int = 20) -> DataFrame:
    """Categories bought together, over orders of every status.

    Orders are first reduced to their distinct category sets and the sets are counted;
    pairs are formed once per distinct set and weighted by its count, instead of once per
    order.  Pairing a category with itself gives its number of orders in the same pass.
    """
    lines = star.order_items.select("order_id", "product_id")
    baskets = (
        lines.join(product_categories(star), "product_id")
        .filter(F.col("category").isNotNull())
        .groupBy("order_id")
        .agg(F.sort_array(F.collect_set("category")).alias("basket"))
        .groupBy("basket")
        .agg(rows().alias("orders"))
    )
    # one category after another, each with itself and those behind it: rows, not a list of all pairs
    firsts = baskets.select("orders", "basket", F.posexplode("basket").alias("place", "a"))
    behind = F.slice("basket", F.col("place") + 1, F.size("basket"))
    pairs = (
        firsts.select("orders", "a", F.explode(behind).alias("b")).groupBy("a", "b").agg(F.sum("orders").alias("orders"))
    )
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("orders"))).over(Window.partitionBy("a"))
    return (
        pairs.withColumn("orders_a", own)
        .filter((F.col("a") < F.col("b")) & (F.col("orders") >= min_orders))
        .orderBy(F.desc("orders"), "a", "b")
        .limit(top)
        .select(
            F.col("a").alias("category_a"),
            F.col("b").alias("category_b"),
            F.col("orders").alias("co_occurrence_count"),
            percent("orders", "orders_a").alias("pct_of_category_a_orders"),
        )
    )


def seller_state_summary(star: Star, *, dedupe_reviews: bool = False) -> DataFrame:
    """Sellers, orders and revenue per seller state; one row per state."""
    states = star.sellers.select("seller_id", "seller_state")
    added = ("items", "revenue", "score", "scored", "days", "timed")
    sums = seller_sums(star, dedupe_reviews=dedupe_reviews).groupBy("seller_state").agg(
        rows().alias("sellers"), *[F.sum(name).alias(name) for name in added]
    )
    # an order counts once in a state, however many of its sellers are there
    kept = delivered(star.orders).select("order_id")
    sold = items_by_order(star).join(kept, "order_id", "left_semi").join(states, "seller_id")
    counted = sold.groupBy("order_id", "seller_state").agg(rows().alias("lines")).groupBy("seller_state").agg(rows().alias("orders"))
    # the states of both, null ones too
    sums = sums.join(counted.withColumnRenamed("seller_state", "state"), F.col("seller_state").eqNullSafe(F.col("state")))
    return sums.select(
        "seller_state",
        F.col("sellers").alias("seller_count"),
        F.col("orders").alias("total_orders"),
        F.col("revenue").alias("total_revenue"),
        mean_money(cents("revenue"), "sellers").alias("revenue_per_seller"),
        ratio("score", "scored", 2).alias("avg_review"),
        ratio("days", "timed", 1).alias("avg_delivery_days"),
        F.dense_rank().over(Window.orderBy(F.desc("revenue"))).alias("state_rank"),
    ).orderBy(F.desc("total_revenue"), "seller_state")


def top_products(star: Star, top: int = 30, *, dedupe_reviews: bool = False) -> DataFrame:
    """Products with the highest revenue; only the kept rows are ranked."""
    lines = items_by_order(star).groupBy("order_id", "product_id").agg(*item_sums())
    orders = reviewed_orders(star, dedupe_reviews=dedupe_reviews)
    return (
        reviewed_sums(lines, orders, "product_id").join(product_categories(star), "product_id")
        .orderBy(F.desc("revenue"), "product_id")
        .limit(top)
        .select(
            "product_id",
            "category",
            F.col("orders").alias("times_ordered"),
            F.col("items").alias("total_units_sold"),
            F.col("revenue").alias("total_revenue"),
            mean_money(cents("price"), "items").alias("avg_price"),
            ratio("score", "scored", 2).alias("avg_review"),
            F.dense_rank().over(Window.orderBy(F.desc("revenue"))).alias("product_rank"),
        )
        .orderBy(F.desc("total_revenue"), "product_id")
    )
