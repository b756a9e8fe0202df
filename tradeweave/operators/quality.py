"""Checks on loaded tables: counts, keys, references and cleaning figures."""

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.rounding import cents, mean_money, ratio
from tradeweave.plans.grains import rows
from tradeweave.plans.ordering import counted, numbered
from tradeweave.schemas import FOREIGN_KEYS, PRIMARY_KEYS, STAR, SURROGATE_KEYS


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    return _union(
        [
            tables[table].agg(rows().alias(name)).select(F.lit(table).alias("table"), name)
            for table in STAR
        ]
    )


def verify_load(expected: Mapping[str, int] | Mapping[str, DataFrame], stored: Mapping[str, DataFrame]) -> DataFrame:
    """Rows expected and found per star table; what is expected comes as counts, as a load returns
    them, or as tables to be counted."""
    actual = _counts(stored, "actual_rows")
    if all(isinstance(n, int) for n in expected.values()):
        known = actual.sparkSession.createDataFrame(list(expected.items()), "table string, expected_rows long")
    else:
        known = _counts(expected, "expected_rows")
    return (
        known.join(actual, "table")
        .withColumn("ok", (F.col("expected_rows") == F.col("actual_rows")).cast("int"))
        .withColumn("all_ok", F.expr("min(ok) over ()"))
        .orderBy("table")
    )


def pk_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: keys found more than once, the rows beyond the first, and null keys."""
    found = []
    for table, key in PRIMARY_KEYS.items():
        if key not in tables[table].columns:  # items and payments stored without numbers
            continue
        copies = tables[table].groupBy(F.col(key).alias("key")).agg(rows().alias("copies"))
        known = F.col("key").isNotNull()
        repeated = known & (F.col("copies") > 1)
        found.append(
            copies.agg(
                F.count_if(repeated).alias("duplicate_keys"),
                F.coalesce(
                    F.sum(F.when(repeated, F.col("copies") - 1)), F.lit(0)
                ).alias("extra_rows"),
                F.coalesce(F.sum(F.when(~known, F.col("copies"))), F.lit(0)).alias("null_keys"),
            ).select(F.lit(table).alias("table"), "duplicate_keys", "extra_rows", "null_keys")
        )
    return _union(found).orderBy("table")


def fk_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per reference: child rows, and distinct child keys, without a parent."""
    found = []
    for child, column, parent in FOREIGN_KEYS:
        used = (
            tables[child]
            .filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("key"))
            .agg(rows().alias("uses"))
        )
        known = tables[parent].select(F.col(PRIMARY_KEYS[parent]).alias("key"))
        found.append(
            used.join(known, "key", "left_anti")
            .agg(rows().alias("orphan_keys"), F.coalesce(F.sum("uses"), F.lit(0)).alias("orphan_rows"))
            .select(
                F.lit(child).alias("table"),
                F.lit(column).alias("column"),
                F.lit(parent).alias("parent"),
                "orphan_keys",
                "orphan_rows",
            )
        )
    return _union(found).orderBy("table", "column")


def with_surrogate_key(df: DataFrame, table: str) -> DataFrame:
    """Numbers the rows of a table without a natural key from 1, as they lie."""
    return counted(df, SURROGATE_KEYS[table])


def numbered_rows(df: DataFrame, table: str) -> DataFrame:
    """Every row of a table without a natural key, numbered from 1 in the order of its columns, nulls last.

    The order takes in every column, so only identical rows could swap numbers; their place of arrival
    still tells them apart and lets many copies spread over tasks.
    """
    arriving = df.withColumn("arrival", F.monotonically_increasing_id())
    columns = [F.asc_nulls_last(f.name) for f in STAR[table].fields]
    ordered = numbered(arriving, *columns, F.asc("arrival"))
    return ordered.withColumnRenamed("position", SURROGATE_KEYS[table]).drop("n", "arrival")


def surrogate_keys(star: Mapping[str, DataFrame]) -> DataFrame:
    """Every order item with its number."""
    return numbered_rows(star["fact_order_items"], "fact_order_items")


def surrogate_key_figures(star: Mapping[str, DataFrame]) -> DataFrame:
    """Per numbered table: rows, smallest, largest and distinct numbers, and a sum of a value."""
    values = {"fact_order_items": "total_value", "fact_payments": "payment_value"}
    found = []
    for table, key in SURROGATE_KEYS.items():
        one = with_surrogate_key(star[table], table).groupBy(key).agg(rows().alias("copies"), F.sum(values[table]).alias("value"))
        found.append(
            one.agg(
                F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
                F.min(key).alias("lowest"),
                F.max(key).alias("highest"),
                rows().alias("numbers"),
                F.sum("value").alias("value"),
            ).select(F.lit(table).alias("table"), "*")
        )
    return _union(found).orderBy("table")


# what is looked at while a star is written: raw table or star table -> aggregates


def raw_figures() -> dict[str, dict[str, Column]]:
    kept = F.coalesce(F.col("price") > 0, F.lit(False))
    return {"geolocation": {"rows": rows()}, "order_items": {"rows": rows(), "removed": F.count_if(~kept)}}


def star_figures() -> dict[str, dict[str, Column]]:
    return {
        "fact_orders": {"delivered": F.count_if(F.col("order_status") == "delivered"), "late": F.sum("is_late_delivery")},
        "fact_order_items": {"value": F.sum("total_value"), "valued": F.count("total_value")},
        "fact_reviews": {"score": F.sum("review_score"), "scored": F.count("review_score")},
    }


def cleaning_report(raw: Mapping[str, Mapping], figures: Mapping[str, Mapping], stored: Mapping[str, DataFrame]) -> DataFrame:
    """What cleaning kept and found, as (table, metric, value) rows.

    ``raw`` and ``figures`` are what ``raw_figures`` and ``star_figures`` gave while the star was
    written; only the two counts of distinct names are read from the stored star.
    """
    spark = stored["dim_products"].sparkSession
    items, reviews = figures["fact_order_items"], figures["fact_reviews"]
    cells: list[tuple[str, str, Column]] = [(table, "rows", F.lit(figures[table]["rows"])) for table in STAR]
    cells += [
        ("dim_geolocation", "raw_rows", F.lit(raw["geolocation"]["rows"])),
        ("fact_orders", "delivered", F.lit(figures["fact_orders"]["delivered"] or 0)),
        ("fact_orders", "late", F.lit(figures["fact_orders"]["late"])),
        ("fact_order_items", "removed", F.lit(raw["order_items"]["removed"] or 0)),
        ("fact_order_items", "mean_total_value", mean_money(cents(F.lit(items["value"]).cast("decimal(38,2)")), F.lit(items["valued"] or 0))),
        ("fact_reviews", "mean_score", ratio(F.lit(reviews["score"]).cast("long"), F.lit(reviews["scored"] or 0), 2)),
    ]

    def cell(table: str, metric: str, value: Column) -> Column:
        return F.struct(F.lit(table).alias("table"), F.lit(metric).alias("metric"), value.cast("decimal(20,2)").alias("value"))

    seen = spark.range(1).select(F.explode(F.array(*[cell(*c) for c in cells])).alias("m")).select("m.*")
    names = stored["dim_products"].agg(F.count_distinct("product_category_english").alias("n"))
    kinds = stored["fact_payments"].agg(F.count_distinct("payment_type").alias("n"))
    counts = [df.select(cell(t, m, F.col("n")).alias("m")).select("m.*") for df, t, m in ((names, "dim_products", "categories"), (kinds, "fact_payments", "types"))]
    return _union([seen, *counts]).orderBy("table", "metric")
