"""Cohort retention: one row per order, dense matrices, curves and headline figures."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.rounding import ratio
from tradeweave.operators.customers import cohort_activity
from tradeweave.plans.grains import delivered, rows
from tradeweave.plans.star import Star


def cohort_orders(star: Star) -> DataFrame:
    """Every delivered order with its buyer and the buyer's first month."""
    accounts = star.customers.select("customer_id", "customer_unique_id")
    sold = delivered(star.orders).select("order_id", "customer_id", "order_month")
    # first months are summed up per account before accounts meet their person
    firsts = (
        sold.groupBy("customer_id")
        .agg(F.min("order_month").alias("first"))
        .transform(lambda df: df.join(accounts, "customer_id"))
        .groupBy("customer_unique_id")
        .agg(F.min("first").alias("cohort_month"))
    )
    owned = sold.join(accounts, "customer_id")
    return (
        owned.join(firsts, "customer_unique_id")
        .select("customer_unique_id", "cohort_month", "order_month")
    )


def retention_grid(star: Star) -> DataFrame:
    """Cohort x offset with size and activity, zero where a cohort was not active.

    One row per cohort expanded to every offset seen anywhere: months times months.
    """
    activity = cohort_activity(star)
    per_cohort = activity.groupBy("cohort_month").agg(
        F.max(F.when(F.col("months_since_first") == 0, F.col("active_customers"))).alias(
            "cohort_size"
        ),
        F.map_from_entries(
            F.collect_list(F.struct("months_since_first", "active_customers"))
        ).alias("active"),
    )
    everywhere = F.collect_list(F.map_keys("active")).over(Window.partitionBy())
    offset = F.col("months_since_first")
    return (
        per_cohort.withColumn("offsets", F.array_distinct(F.flatten(everywhere)))
        .withColumn("months_since_first", F.explode("offsets"))
        .select(
            "cohort_month",
            "cohort_size",
            "months_since_first",
            F.coalesce(F.try_element_at("active", offset), F.lit(0)).alias("active_customers"),
        )
    )


def retention_counts(star: Star) -> DataFrame:
    """Active people per cohort and offset, zero-filled, in long form (see ``widen``)."""
    return (
        retention_grid(star)
        .select("cohort_month", "months_since_first", "active_customers")
        .orderBy("cohort_month", "months_since_first")
    )


def counts_by_offset(star: Star) -> DataFrame:
    """One row per cohort: its active people at every offset, joined by commas in the order of offsets.

    The offsets are those that occur anywhere, months since the first order, so a list is short.
    """
    counted = F.struct("months_since_first", "active_customers")
    return (
        retention_grid(star)
        .groupBy("cohort_month")
        .agg(F.sort_array(F.collect_list(counted)).alias("grid"))
        .select(
            "cohort_month",
            F.array_join(F.transform("grid", lambda g: g["active_customers"].cast("string")), ",").alias("counts"),
        )
        .orderBy("cohort_month")
    )


def retention_matrix(star: Star) -> DataFrame:
    """The same grid as a percentage of the cohort's size, unrounded."""
    share = F.col("active_customers").cast("double") / F.col("cohort_size") * 100
    return (
        retention_grid(star)
        .select("cohort_month", "months_since_first", share.alias("retention_pct"))
        .orderBy("cohort_month", "months_since_first")
    )


def widen(grid: DataFrame, value: str, offsets: Sequence[int]) -> DataFrame:
    """One row per cohort, one column ``month_<offset>`` per offset, zero-filled."""
    names = [f"month_{o}" for o in offsets]
    return (
        grid.withColumn("month", F.concat(F.lit("month_"), "months_since_first"))
        .groupBy("cohort_month")
        .pivot("month", names)
        .agg(F.first(value))
        .fillna(0, names)
        .orderBy("cohort_month")
    )


def retention_heatmap(star: Star, max_offset: int = 12, min_size: int = 50) -> DataFrame:
    """Retention of the larger cohorts over the first year, to one decimal, zeros blank."""
    offsets = range(max_offset + 1)
    shown = retention_grid(star).filter(
        (F.col("cohort_size") >= min_size) & (F.col("months_since_first") <= max_offset)
    )
    pct = ratio("active_customers", "cohort_size", 1, shift=2)
    names = [f"month_{o}" for o in offsets]
    return (
        shown.withColumns(
            {
                "pct": F.when(pct != 0, pct),
                "month": F.concat(F.lit("month_"), "months_since_first"),
            }
        )
        .groupBy("cohort_month", "cohort_size")
        .pivot("month", names)
        .agg(F.first("pct"))
        .orderBy("cohort_month")
    )


def cohort_sizes(star: Star) -> DataFrame:
    return (
        cohort_activity(star)
        .filter(F.col("months_since_first") == 0)
        .select("cohort_month", F.col("active_customers").alias("customers"))
        .orderBy("cohort_month")
    )


def retention_curve(
    star: Star, max_offset: int | None = 12, *, observed_only: bool = False
) -> DataFrame:
    """Mean retention per offset.

    By default over all cohorts, so a month a cohort has not reached counts as 0;
    ``observed_only`` averages over the cohorts active in that month.
    """
    share = F.col("active_customers") * F.lit(100) / F.col("cohort_size")
    grid = retention_grid(star)
    if max_offset is not None:
        grid = grid.filter(F.col("months_since_first") <= max_offset)
    if observed_only:
        grid = grid.filter(F.col("active_customers") > 0)
    return (
        grid.groupBy("months_since_first")
        .agg(F.round(F.avg(share.cast("double")), 6).alias("avg_retention_pct"))
        .orderBy("months_since_first")
    )


def cohort_insights(star: Star) -> DataFrame:
    """People, cohorts, the largest and smallest cohort (earliest on ties), and the mean
    retention after 1, 3 and 6 months; one row."""
    sizes = cohort_sizes(star)
    earliest = F.struct(F.col("customers"), -_month_number("cohort_month"))
    latest = F.struct(F.col("customers"), _month_number("cohort_month"))
    heads = sizes.agg(
        F.coalesce(F.sum("customers"), F.lit(0)).alias("total_customers"),
        rows().alias("cohorts"),
        F.max_by("cohort_month", earliest).alias("largest_cohort"),
        F.max("customers").alias("largest_size"),
        F.min_by("cohort_month", latest).alias("smallest_cohort"),
        F.min("customers").alias("smallest_size"),
    )
    curve = retention_curve(star)

    def after(month: int):
        mean = F.max(F.when(F.col("months_since_first") == month, F.col("avg_retention_pct")))
        return F.coalesce(mean, F.lit(0.0)).alias(f"month_{month}_retention")

    return heads.crossJoin(F.broadcast(curve.agg(after(1), after(3), after(6))))  # one row


def _month_number(name: str):
    return F.replace(name, F.lit("-")).cast("int")
