"""Delivery, price, weight and satisfaction: correlations and significance tests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.buckets import delivery_cut
from tradeweave.functions.rounding import ratio
from tradeweave.functions.stats import (
    correlation,
    correlation_t,
    decision,
    effect_size,
    scatter,
    significance_label,
    t_test_p,
)
from tradeweave.plans.boxes import box_stats
from tradeweave.plans.fanout import (
    ITEM,
    LEVELS,
    ORDER,
    REVIEW,
    WHOLE,
    Levels,
    Sources,
    analysis_orders,
    levels,
    pair_sums,
    pairs,
    per_order,
    scatters,
    sources,
)
from tradeweave.plans.grains import account_states, rows
from tradeweave.plans.ordering import durable, running, sized
from tradeweave.plans.star import Star

VARIABLES = tuple(LEVELS)

def analysis_base(star: Star) -> DataFrame:
    """One row per item and review of an analysed order."""
    products = star.products.select(
        "product_id", "product_weight_g", F.col("product_category_english").alias("category")
    )
    orders = analysis_orders(star).join(account_states(star), "customer_id")
    scores = star.reviews.select("order_id", "review_id", "review_score")
    return (
        _item_rows(star, products, orders, scores)
        .select(
            "order_id",
            "delivery_days_actual",
            "delivery_days_estimated",
            "delivery_delta_days",
            "is_late_delivery",
            "review_score",
            "price",
            "freight_value",
            "total_value",
            "product_weight_g",
            "category",
            "customer_state",
        )
    )


def _item_rows(
    star: Star, products: DataFrame, orders: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Items with their product, order and every review of the order."""
    items = star.order_items.join(products, "product_id")
    return items.join(orders, "order_id").join(reviews, "order_id")


def _corr(a: str, b: str) -> Column:
    return correlation(F.col(f"v_{a}_{a}"), F.col(f"v_{b}_{b}"), F.col(f"v_{a}_{b}"))


def _matrix(lv: Levels) -> DataFrame:
    """All ordered pairs of variables with their correlation, from one aggregation."""

    def cell(x: str, y: str, r: Column) -> Column:
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), r.alias("r"))

    found = pairs(list(lv.variables))
    named = scatters(lv).select(*[_corr(a, b).alias(f"r_{a}_{b}") for a, b in found])
    cells = []
    for a, b in found:
        r = F.col(f"r_{a}_{b}")
        cells += [cell(a, b, r)] if a == b else [cell(a, b, r), cell(b, a, r)]
    return named.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def pearson_matrix(star: Star) -> DataFrame:
    return _matrix(levels(star, *VARIABLES)).orderBy("x", "y")


def spearman_matrix(star: Star) -> DataFrame:
    return _matrix(ranked(levels(star, *VARIABLES))).orderBy("x", "y")


def ranked(lv: Levels) -> Levels:
    """The same levels with every value replaced by twice its average rank.

    Ranks are over the item-by-review rows; twice an average rank is a whole number.  The
    table of distinct values is ranked in one distributed order and joined back; as it is stored with
    its size, Spark broadcasts the ranks of days, scores and the like instead of shuffling facts by value.
    """
    k = lv.items.groupBy("order_id").agg(rows().alias("k"))
    r = lv.reviews.groupBy("order_id").agg(rows().alias("r"))
    # one narrow row per order, needed by all three levels below
    paired = durable(lv.orders.join(k, "order_id").join(r, "order_id"))
    counts = paired.select("order_id", "k", "r")

    def weighed(df: DataFrame, names: list[str], weight: Column) -> DataFrame:
        pairs = [F.struct(F.lit(n).alias("variable"), F.col(n).alias("value")) for n in names]
        return df.select(F.explode(F.array(*pairs)).alias("v"), weight.alias("weight")).select(
            "v.variable", "v.value", "weight"
        )

    parts = []
    if names := lv.at(ORDER):
        parts.append(weighed(paired, names, F.col("k") * F.col("r")))
    for level, weight in ((ITEM, "r"), (REVIEW, "k")):
        if names := lv.at(level):
            counted = lv.frame(level).join(counts, "order_id")
            parts.append(weighed(counted, names, F.col(weight)))
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.unionByName(part)
    values = seen.groupBy("variable", "value").agg(F.sum("weight").alias("rows"))
    placed = running(values, ["variable", "value"], {"before": "rows"})
    starts = placed.groupBy("variable").agg(F.min("before").alias("start"))
    ranks = sized(
        placed.join(F.broadcast(starts), "variable").select(  # one row per variable
            "variable",
            "value",
            ((F.col("before") - F.col("start")) * 2 + F.col("rows") + 1)
            .cast(WHOLE)
            .alias("rank"),
        ),
        "variable",
    )

    def replace(source: Levels, level: str) -> DataFrame:
        df = source.frame(level)
        for name in lv.at(level):
            table = ranks.filter(F.col("variable") == name).select(
                F.col("value").alias(name), F.col("rank").alias(f"{name}_rank")
            )
            df = df.join(table, name).drop(name).withColumnRenamed(f"{name}_rank", name)
        return df

    found = Levels(paired.drop("k", "r"), lv.items, lv.reviews, lv.variables)
    return Levels(*[replace(found, level) for level in (ORDER, ITEM, REVIEW)], lv.variables)


def welch_late_vs_ontime(star: Star | Sources) -> DataFrame:
    """Welch's t-test of review scores, on-time against late; one row."""
    lv = levels(star, "review_score")
    groups = per_order(lv).groupBy("is_late_delivery").agg(*pair_sums(lv))
    columns = ("n", "x_review_score", "x_review_score_review_score")

    def side(late: int, name: str) -> list[Column]:
        mine = F.col("is_late_delivery") == late
        return [
            F.coalesce(F.max(F.when(mine, F.col(c))), F.lit(0)).cast("double").alias(f"{name}_{s}")
            for c, s in zip(columns, ("n", "sum", "squares"))
        ]

    both = groups.agg(*side(0, "ontime"), *side(1, "late"))
    for name in ("ontime", "late"):
        n, total, squares = (F.col(f"{name}_{s}") for s in ("n", "sum", "squares"))
        some = F.when(n > 0, n)
        more = F.when(n > 1, n - 1)
        both = both.withColumns(
            {
                f"{name}_mean": total / some,
                f"{name}_var": (squares - total * total / some) / more,
            }
        )
    v0, v1 = F.col("ontime_var") / F.col("ontime_n"), F.col("late_var") / F.col("late_n")
    apart = F.col("ontime_mean") - F.col("late_mean")
    pooled = F.sqrt((F.col("ontime_var") + F.col("late_var")) / 2)
    spread = F.when(v0 + v1 > 0, v0 + v1)
    freedom = spread * spread / (
        v0 * v0 / (F.col("ontime_n") - 1) + v1 * v1 / (F.col("late_n") - 1)
    )
    tested = both.withColumns(
        {
            "t_stat": apart / F.sqrt(spread),
            "df": freedom,
            "cohens_d": apart / F.when(pooled > 0, pooled),
        }
    ).withColumn("p_value", t_test_p(F.col("t_stat"), F.col("df")))
    return tested.select(
        F.col("ontime_n").cast("long").alias("ontime_n"),
        "ontime_mean",
        F.sqrt("ontime_var").alias("ontime_std"),
        F.col("late_n").cast("long").alias("late_n"),
        "late_mean",
        F.sqrt("late_var").alias("late_std"),
        "t_stat",
        "df",
        "p_value",
        significance_label(F.col("p_value")).alias("significance"),
        "cohens_d",
        effect_size(F.col("cohens_d")).alias("effect"),
        decision(F.col("p_value")).alias("decision"),
    )


def _correlation_test(lv: Levels) -> DataFrame:
    a, b = lv.variables
    tested = scatters(lv).select(
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), _corr(a, b).alias("r")
    ).withColumns({"t_stat": correlation_t(F.col("r"), F.col("n")), "df": F.col("n") - 2})
    return tested.withColumn("p_value", t_test_p(F.col("t_stat"), F.col("df").cast("double"))).withColumns(
        {
            "significance": significance_label(F.col("p_value")),
            "decision": decision(F.col("p_value")),
        }
    )


def spearman_freight_review(star: Star | Sources) -> DataFrame:
    """Rank correlation of freight and review score with its p-value; one row."""
    return _correlation_test(ranked(levels(star, "freight_value", "review_score")))


def pearson_weight_delivery(star: Star | Sources) -> DataFrame:
    """Correlation of product weight and delivery days with its p-value; one row."""
    return _correlation_test(levels(star, "product_weight_g", "delivery_days_actual"))


def weight_delivery_regression(star: Star, points: int = 100) -> DataFrame:
    """Least-squares line of delivery days on kilograms, at evenly spaced weights from 0."""
    lv = levels(star, "product_weight_g", "delivery_days_actual")
    w, d = "product_weight_g", "delivery_days_actual"
    sums = per_order(lv).agg(*pair_sums(lv), F.max(f"max_{w}").alias("heaviest"))
    n, x, y = (F.col(c).cast("double") for c in ("n", f"x_{w}", f"x_{d}"))
    spread = scatter(F.col("n"), F.col(f"x_{w}"), F.col(f"x_{w}"), F.col(f"x_{w}_{w}"))
    shared = scatter(F.col("n"), F.col(f"x_{w}"), F.col(f"x_{d}"), F.col(f"x_{w}_{d}"))
    per_gram = shared / F.when(spread > 0, spread)
    line = sums.select(
        (per_gram * 1000).alias("slope"),
        (y / n - per_gram * (x / n)).alias("intercept"),
        (F.col("heaviest").cast("double") / 1000).alias("max_kg"),
    )
    kilos = F.col("point") * (F.col("max_kg") / (points - 1))
    return (
        line.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .select(
            "point",
            kilos.alias("weight_kg"),
            (F.col("intercept") + F.col("slope") * kilos).alias("delivery_days"),
            "slope",
            "intercept",
        )
        .orderBy("point")
    )


SPREAD = 2654435761  # an odd multiplier near 2**32 over the golden ratio


def scatter_sample(star: Star, size: int = 5000) -> DataFrame:
    """A repeatable uniform sample of (weight, days) over the item-by-review rows.

    The rows, in the order of order, item and review, are cut into ``size`` stretches as even as can be,
    and one is drawn from each, or all if there are no more than ``size``. Which orders they fall into
    follows from the orders' numbers of items and reviews, so only drawn rows are formed.
    """
    weights = star.products.where("product_weight_g IS NOT NULL").select("product_id", "product_weight_g")
    items = star.order_items.join(weights, "product_id").select(
        "order_id", "order_item_id", "product_id", "product_weight_g"
    )
    k = items.groupBy("order_id").agg(rows().alias("k"))
    r = star.reviews.groupBy("order_id").agg(rows().alias("r"))
    orders = analysis_orders(star).select("order_id", "delivery_days_actual").join(k, "order_id").join(r, "order_id")
    placed = running(orders.withColumn("fan", F.col("k") * F.col("r")), ["order_id"], {"start": "fan"})
    drawn = _drawn_places(placed, size)
    of_drawn = items.join(F.broadcast(drawn.select("order_id").distinct()), "order_id", "left_semi")  # at most ``size``
    in_order = Window.partitionBy("order_id").orderBy("order_item_id", "product_id")
    numbered_items = of_drawn.withColumn("item", F.row_number().over(in_order) - 1)
    return (
        F.broadcast(drawn.withColumn("item", F.call_function("div", F.col("place"), F.col("r"))))
        .join(numbered_items, ["order_id", "item"])
        .select((F.col("product_weight_g") / 1000).alias("weight_kg"), "delivery_days_actual")
    )


def _drawn_places(placed: DataFrame, size: int) -> DataFrame:
    """The orders (order_id, start, fan, ...) that hold drawn rows, with each one's place among theirs."""
    everything = placed.agg(F.sum("fan").alias("total"))

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    total, end, count = F.col("total"), F.col("start") + F.col("fan"), F.lit(size).cast("long")
    low = F.greatest(div(F.col("start") * count, total) - 1, F.lit(0))
    high = F.least(div(end * count, total), count - 1)
    first, after = div(F.col("stretch") * total, count), div((F.col("stretch") + 1) * total, count)
    place = first + F.pmod(F.col("stretch") * SPREAD % (1 << 32), after - first)
    return (
        placed.crossJoin(F.broadcast(everything))  # one row
        .withColumn("stretch", F.explode(F.sequence(low, high)))
        .where(after > first)
        .withColumn("place", place - F.col("start"))
        .where((F.col("place") >= 0) & (F.col("place") < F.col("fan")))
    )


def _score_counts(star: Star, group: Column, name: str) -> DataFrame:
    """Item-by-review rows per group and review score: at most five rows per group."""
    lv = levels(star, "review_score")
    orders = analysis_orders(star).select("order_id", group.alias(name))
    k = lv.items.groupBy("order_id").agg(rows().alias("k"))
    scores = lv.reviews.groupBy("order_id", "review_score").agg(rows().alias("r"))
    return (
        orders.join(k, "order_id")
        .join(scores, "order_id")
        .groupBy(name, F.col("review_score").cast("int").alias("review_score"))
        .agg(F.sum(F.col("k") * F.col("r")).alias("rows"))
    )


def delivery_bucket_review_stats(star: Star) -> DataFrame:
    """Mean and box figures of review scores per right-closed delivery bucket."""
    group = delivery_cut(F.col("delivery_delta_days"))
    counts = _score_counts(star, group, "delivery_bucket").filter(
        F.col("delivery_bucket").isNotNull()
    )
    means = counts.groupBy("delivery_bucket").agg(
        F.sum("rows").alias("total"), F.sum(F.col("rows") * F.col("review_score")).alias("score")
    )
    names = F.array(*[F.lit(name) for _, _, name in L.DELIVERY_CUTS])
    return (
        box_stats(counts, ["delivery_bucket"], "review_score", "rows")
        .join(means, "delivery_bucket")
        .withColumn("mean_score", ratio("score", "total", 2))
        .drop("score", "total")
        .orderBy(F.array_position(names, F.col("delivery_bucket")))
    )


def review_histogram(star: Star, bins: int = 5) -> DataFrame:
    """Density of review scores in equal bins between each group's own extremes."""
    late = F.when(F.col("is_late_delivery") == 1, "Late").otherwise("On Time")
    counts = _score_counts(star, late, "delivery")
    ends = counts.groupBy("delivery").agg(
        F.min("review_score").cast("double").alias("low"),
        F.max("review_score").cast("double").alias("high"),
        F.sum("rows").alias("n"),
    )
    flat = F.col("low") == F.col("high")
    ends = ends.select(
        "delivery",
        "n",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    ).withColumn("width", (F.col("high") - F.col("low")) / bins)
    place = F.floor((F.col("review_score") - F.col("low")) / F.col("width"))
    filled = (
        counts.join(ends, "delivery")
        .groupBy("delivery", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("rows").alias("rows"))
    )
    return (
        ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .join(filled, ["delivery", "bin"], "left")
        .select(
            "delivery",
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            (F.coalesce("rows", F.lit(0)) / (F.col("n") * F.col("width"))).alias("density"),
        )
        .orderBy("delivery", "bin")
    )


def hypothesis_summary(star: Star) -> DataFrame:
    """The three tests side by side, all from one stored set of narrow orders, items and reviews."""
    base = sources(star)
    star = Sources(*[durable(df) for df in (base.orders, base.items, base.reviews)])
    welch = welch_late_vs_ontime(star).select(
        F.lit("late delivery vs review score").alias("test"),
        F.lit("Welch's t-test").alias("method"),
        F.col("t_stat").alias("statistic"),
        "p_value",
        F.col("cohens_d").alias("effect"),
        "significance",
        "decision",
    )

    def correlated(df: DataFrame, test: str, method: str) -> DataFrame:
        return df.select(
            F.lit(test).alias("test"),
            F.lit(method).alias("method"),
            F.col("r").alias("statistic"),
            "p_value",
            F.col("r").alias("effect"),
            "significance",
            "decision",
        )

    return welch.unionByName(
        correlated(
            spearman_freight_review(star), "freight value vs review score", "Spearman correlation"
        )
    ).unionByName(
        correlated(
            pearson_weight_delivery(star), "product weight vs delivery time", "Pearson correlation"
        )
    )
