"""Exact quantiles of groups of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.plans.ordering import running


def grouped_quantiles(
    counts: DataFrame, groups: list[str], value: str, weight: str, fractions: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group from distinct (group, value, weight) rows.

    No group is gathered in one task: places come from one global order over all groups.
    """
    placed = running(counts, [*groups, value], {"before": weight})
    spans = placed.groupBy(*groups).agg(
        F.min("before").alias("group_start"), F.sum(weight).alias("group_n")
    )
    keyed = placed.join(spans, groups)
    first = F.col("before") - F.col("group_start")
    keyed = keyed.withColumns({"first": first, "last": first + F.col(weight) - 1})

    def at(place: Column) -> Column:
        inside = (F.col("first") <= place) & (place <= F.col("last"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    picks = []
    for name, fraction in fractions.items():
        exact = (F.col("group_n") - 1) * F.lit(fraction)
        picks += [at(F.floor(exact)).alias(f"{name}_lo"), at(F.ceil(exact)).alias(f"{name}_hi")]
    picked = keyed.groupBy(*groups, "group_n").agg(*picks)
    blended = []
    for name, fraction in fractions.items():
        exact = (F.col("group_n") - 1) * F.lit(fraction)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        blended.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return picked.select(*groups, F.col("group_n").alias("n"), *blended)
