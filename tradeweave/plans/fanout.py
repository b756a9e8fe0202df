"""Sums over the item-by-review rows of each order, without forming those rows.

The analysis looks at every pairing of an order's items with its reviews.  A figure over
those pairings is a product of a sum over items and a sum over reviews, so items and
reviews are summed per order first and an order with very many of both stays one row.
All values are whole numbers (days, grams, cents, scores) held as decimals without places, so
sums are exact up to 38 digits and independent of row order; more raise an error.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.stats import scatter
from tradeweave.plans.grains import delivered, rows
from tradeweave.plans.star import Star

ORDER, ITEM, REVIEW = "order", "item", "review"

LEVELS = {
    "delivery_days_actual": ORDER,
    "delivery_delta_days": ORDER,
    "freight_value": ITEM,
    "price": ITEM,
    "review_score": REVIEW,
    "product_weight_g": ITEM,
}
MONEY = ("freight_value", "price")
MAX_DAYS = 60
WHOLE = "decimal(18,0)"


def analysis_orders(star: Star, max_days: int = MAX_DAYS) -> DataFrame:
    """Delivered orders of known customers that took between 0 and ``max_days`` days."""
    timely = delivered(star.orders).filter(
        F.col("delivery_days_actual").between(0, max_days)
    )
    known = star.customers.select("customer_id")
    return timely.join(known, "customer_id", "left_semi")


@dataclass(frozen=True)
class Levels:
    """Orders, items and reviews with the variables complete at their own level."""

    orders: DataFrame
    items: DataFrame
    reviews: DataFrame
    variables: tuple[str, ...]

    def frame(self, level: str) -> DataFrame:
        return {ORDER: self.orders, ITEM: self.items, REVIEW: self.reviews}[level]

    def at(self, level: str) -> list[str]:
        return [v for v in self.variables if LEVELS[v] == level]


@dataclass(frozen=True)
class Sources:
    """The narrow frames that levels are made of: orders, items with their product's weight, reviews."""

    orders: DataFrame
    items: DataFrame
    reviews: DataFrame


def sources(star: Star) -> Sources:
    weights = star.products.select("product_id", "product_weight_g")
    names = {level: [v for v in LEVELS if LEVELS[v] == level] for level in (ORDER, ITEM, REVIEW)}
    return Sources(
        analysis_orders(star).select("order_id", "is_late_delivery", *names[ORDER]),
        star.order_items.join(weights, "product_id").select("order_id", *names[ITEM]),
        star.reviews.select("order_id", *names[REVIEW]),
    )


def levels(star: Star | Sources, *variables: str) -> Levels:
    base = star if isinstance(star, Sources) else sources(star)

    def whole(name: str) -> Column:
        column = F.col(name) * 100 if name in MONEY else F.col(name)
        return column.cast(WHOLE).alias(name)

    def complete(df: DataFrame, level: str, *keep: str) -> DataFrame:
        names = [v for v in variables if LEVELS[v] == level]
        chosen = df.select("order_id", *keep, *[whole(n) for n in names])
        return chosen.dropna(subset=names) if names else chosen

    return Levels(
        complete(base.orders, ORDER, "is_late_delivery"),
        complete(base.items, ITEM),
        complete(base.reviews, REVIEW),
        tuple(variables),
    )


def pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def per_order(lv: Levels) -> DataFrame:
    """One row per order: item count ``k``, review count ``r``, sums and product sums."""

    def summed(level: str, count: str) -> DataFrame:
        names = lv.at(level)
        return lv.frame(level).groupBy("order_id").agg(
            rows().alias(count),
            *[F.sum(a).alias(f"s_{a}") for a in names],
            *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs(names)],
            *[F.max(a).alias(f"max_{a}") for a in names],
        )

    return lv.orders.join(summed(ITEM, "k"), "order_id").join(summed(REVIEW, "r"), "order_id")


def pair_sums(lv: Levels) -> list[Column]:
    """Aggregates over ``per_order`` rows: ``n``, ``x_<v>`` and ``x_<v>_<w>``."""
    k, r = F.col("k").cast(WHOLE), F.col("r").cast(WHOLE)
    times = {ORDER: k * r, ITEM: r, REVIEW: k}

    def total(a: str) -> Column:
        return F.col(a if LEVELS[a] == ORDER else f"s_{a}")

    def product(a: str, b: str) -> Column:
        one, other = LEVELS[a], LEVELS[b]
        if one == other:
            own = F.col(a) * F.col(b) if one == ORDER else F.col(f"s_{a}_{b}")
            return own * times[one]
        result = total(a) * total(b)
        # a level neither value belongs to repeats the product once per row it has
        for level, count in ((ITEM, k), (REVIEW, r)):
            if level not in (one, other):
                result = result * count
        return result

    names = list(lv.variables)
    return [
        F.sum(F.col("k") * F.col("r")).alias("n"),
        *[F.sum(total(a) * times[LEVELS[a]]).alias(f"x_{a}") for a in names],
        *[F.sum(product(a, b)).alias(f"x_{a}_{b}") for a, b in pairs(names)],
    ]


def scatters(lv: Levels) -> DataFrame:
    """One row with ``n`` and ``v_<a>_<b>``, deviations of every pair of variables."""
    sums = per_order(lv).agg(*pair_sums(lv))
    return sums.select(
        "*",
        *[
            scatter(F.col("n"), F.col(f"x_{a}"), F.col(f"x_{b}"), F.col(f"x_{a}_{b}")).alias(
                f"v_{a}_{b}"
            )
            for a, b in pairs(list(lv.variables))
        ],
    )
