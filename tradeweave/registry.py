"""Every report under its name, over a folder of sample tables."""

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeweave.operators import (
    clusters,
    cohorts,
    correlation,
    customers,
    delivery,
    exploration,
    marts,
    overview,
    quality,
    revenue,
    sellers,
)
from tradeweave.plans.ordering import checkpoint_folder
from tradeweave.plans.star import Star, Tables, star_from_raw
from tradeweave.sources import files
from tradeweave.sources.checked import append_checked
from tradeweave.sources.sample import sample_raw, sample_star
from tradeweave.sources.warehouse import (
    CLUSTERS,
    catalog_star,
    observed,
    read_clusters,
    read_star,
    save_clusters,
    save_star,
    write_star,
)
from tradeweave.sources.warehouse import export_clusters as export

Report = Callable[[Star], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]

STAR_REPORTS: tuple[Report, ...] = (
    overview.baseline_kpis,
    overview.order_status_distribution,
    overview.monthly_order_volume,
    overview.revenue_by_state,
    overview.top_categories,
    overview.payment_type_distribution,
    overview.review_score_distribution,
    overview.slowest_states,
    revenue.revenue_waterfall,
    revenue.pareto_abc,
    revenue.payment_installment_analysis,
    revenue.daily_revenue_ma7,
    revenue.revenue_concentration,
    customers.rfm_scores,
    customers.rfm_segment_summary,
    customers.cohort_retention,
    customers.customer_clv,
    delivery.delivery_sla_by_state,
    delivery.delivery_review_buckets,
    delivery.monthly_delivery_trend,
    delivery.freight_by_state_weight,
    delivery.seller_reliability,
    sellers.seller_performance,
    sellers.category_matrix,
    sellers.basket_pairs,
    sellers.seller_state_summary,
    sellers.top_products,
    exploration.monthly_revenue,
    exploration.order_status_counts,
    exploration.top_categories_revenue,
    exploration.payment_type_share,
    exploration.review_score_mean,
    exploration.delivery_box_by_state,
    exploration.state_revenue_top10,
    exploration.order_heatmap,
    clusters.rfm_base,
    clusters.rfm_profile,
    clusters.rfm_features,
    correlation.analysis_base,
    correlation.pearson_matrix,
    correlation.spearman_matrix,
    correlation.welch_late_vs_ontime,
    correlation.spearman_freight_review,
    correlation.pearson_weight_delivery,
    correlation.weight_delivery_regression,
    correlation.scatter_sample,
    correlation.delivery_bucket_review_stats,
    correlation.review_histogram,
    correlation.hypothesis_summary,
    cohorts.cohort_orders,
    cohorts.retention_counts,
    cohorts.retention_matrix,
    cohorts.retention_heatmap,
    cohorts.cohort_sizes,
    cohorts.retention_curve,
    cohorts.cohort_insights,
    marts.mart_revenue_overview,
    marts.mart_customer_segments,
    marts.mart_delivery,
    marts.mart_product_seller,
    marts.state_concentration,
)

CLUSTER_REPORTS = (
    clusters.cluster_summary,
    clusters.segment_profile,
    clusters.segment_revenue_share,
    clusters.segment_box_stats,
    clusters.segment_points,
)

CLEAN_TABLES = {
    "clean_customers": "dim_customers",
    "clean_products": "dim_products",
    "clean_sellers": "dim_sellers",
    "clean_geolocation": "dim_geolocation",
    "clean_orders": "fact_orders",
    "clean_order_items": "fact_order_items",
    "clean_payments": "fact_payments",
    "clean_reviews": "fact_reviews",
}

# decimals kept of doubles when comparing with another engine; 8 unless named
DIGITS = {
    "rfm_features": {"recency_log": 6, "frequency_log": 6, "monetary_log": 6},
    "retention_matrix": {"retention_pct": 6},
    "welch_late_vs_ontime": {"t_stat": 6, "df": 4},
    "spearman_freight_review": {"t_stat": 6},
    "pearson_weight_delivery": {"t_stat": 6},
    "hypothesis_summary": {"statistic": 6},
}


def portable(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Types every engine and client agrees on: long, double, text."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            column = column.cast("int").cast("long")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, (digits or {}).get(field.name, 8))
        elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _on_star(report: Report) -> Query:
    name = report.__name__

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return portable(report(sample_star(spark, folder)), DIGITS.get(name))

    return run


def _search(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores and assignment of the search, from the catalog tables that the first caller stores for
    a folder of samples."""
    name = f"{CLUSTERS}_{zlib.crc32(folder.encode()):08x}"
    if not spark.catalog.tableExists(name):  # the assignment is stored last
        scores, clustered = clusters.search(sample_star(spark, folder))
        save_clusters(scores, clustered, name, _fresh(spark, "clusters"))
    return files.scan_table(spark, f"{name}_scores"), files.scan_table(spark, name)


def kmeans_k_search(spark: SparkSession, folder: str) -> DataFrame:
    return portable(_search(spark, folder)[0].orderBy("k"))


def kmeans_segments(spark: SparkSession, folder: str) -> DataFrame:
    return portable(_search(spark, folder)[1])


def _on_clusters(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: portable(report(_search(spark, folder)[1]))


def _clean(table: str) -> Query:
    return lambda spark, folder: portable(sample_star(spark, folder)[table])


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def verify_load(spark: SparkSession, folder: str) -> DataFrame:
    """Stores the star in a fresh shared folder and compares row counts, those expected as seen while
    writing."""
    target = _fresh(spark, "star")
    figures = write_star(sample_star(spark, folder), target)
    return portable(quality.verify_load({t: f["rows"] for t, f in figures.items()}, read_star(spark, target)))


def load_raw(spark: SparkSession, folder: str) -> DataFrame:
    """All nine raw tables through CSV files, cleaned, up to the monthly revenue report."""
    paths = files.write_csv(sample_raw(spark, folder), _fresh(spark, "csv"))
    star = star_from_raw(files.load_raw(spark, paths))
    return portable(revenue.revenue_waterfall(star))


def export_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster assignment as read back from its stored table."""
    target = _fresh(spark, "clusters")
    export(_search(spark, folder)[1], target)
    return portable(read_clusters(spark, target))


def pk_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Key check on the raw tables, where copies still exist."""
    raw, star = sample_raw(spark, folder), sample_star(spark, folder)
    zipped = raw["geolocation"].withColumnRenamed(
        "geolocation_zip_code_prefix", "geolocation_zip_prefix"
    )
    tables = Tables(
        {
            "dim_customers": lambda: raw["customers"],
            "dim_products": lambda: raw["products"],
            "dim_sellers": lambda: raw["sellers"],
            "dim_geolocation": lambda: zipped,
            "fact_orders": lambda: raw["orders"],
            "fact_reviews": lambda: raw["reviews"],
            "fact_order_items": lambda: quality.with_surrogate_key(star.order_items, "fact_order_items"),
            "fact_payments": lambda: quality.with_surrogate_key(star.payments, "fact_payments"),
        }
    )
    return portable(quality.pk_duplicates(tables))


def surrogate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Every order item with its number, in the order of its columns."""
    return portable(quality.surrogate_keys(sample_star(spark, folder)))


def surrogate_key_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, numbers and values of both numbered tables, numbered as they lie."""
    return portable(quality.surrogate_key_figures(sample_star(spark, folder)))


def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return portable(quality.fk_orphans(sample_star(spark, folder)))


def cleaning_report(spark: SparkSession, folder: str) -> DataFrame:
    """Loads the raw tables into a fresh shared folder; each is read once."""
    raw, seen = dict(sample_raw(spark, folder)), {}
    for name, wanted in quality.raw_figures().items():
        raw[name], seen[name] = observed(raw[name], wanted)
    target = _fresh(spark, "star")
    figures = write_star(star_from_raw(raw), target, watched=quality.star_figures())
    return portable(quality.cleaning_report({name: one() for name, one in seen.items()}, figures, read_star(spark, target)))


def retention_counts_wide(spark: SparkSession, folder: str) -> DataFrame:
    """A row per cohort; its counts at every offset that occurs, as text in the order of offsets.

    ``cohorts.widen`` gives a column to each offset instead, whose number depends on the data.
    """
    return portable(cohorts.counts_by_offset(sample_star(spark, folder)))


def stored_revenue_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return portable(revenue.revenue_waterfall(_stored(spark, folder)))


def stored_seller_performance(spark: SparkSession, folder: str) -> DataFrame:
    return portable(sellers.seller_performance(_stored(spark, folder)))


def _catalog(spark: SparkSession, folder: str) -> str:
    """The prefix of the star's bucketed catalog tables, which the first caller saves for a folder of
    samples."""
    prefix = f"star_{zlib.crc32(folder.encode()):08x}_"
    if not spark.catalog.tableExists(f"{prefix}fact_reviews"):  # saved last
        save_star(sample_star(spark, folder), prefix, _fresh(spark, "buckets"))
    return prefix


def bucketed_revenue_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return portable(revenue.revenue_waterfall(catalog_star(spark, _catalog(spark, folder))))


def bucketed_seller_performance(spark: SparkSession, folder: str) -> DataFrame:
    return portable(sellers.seller_performance(catalog_star(spark, _catalog(spark, folder))))


def sql_monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly revenue as a statement over catalog tables, as a reader without this library
    would ask for it."""
    prefix = _catalog(spark, folder)
    return portable(files.scan_sql(spark, MONTHLY_REVENUE.format(prefix=prefix)))


MONTHLY_REVENUE = """
SELECT o.order_month, count(DISTINCT o.order_id) AS total_orders, sum(i.total_value) AS revenue
FROM {prefix}fact_orders AS o JOIN {prefix}fact_order_items AS i ON i.order_id = o.order_id
WHERE o.order_status = 'delivered'
GROUP BY o.order_month
ORDER BY o.order_month
"""


def append_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rejects of a load onto the stored star, with planted copies and references to nothing."""
    target = _fresh(spark, "star")
    write_star(sample_star(spark, folder), target)
    found = append_checked(_planted(sample_star(spark, folder)), target, bits=1 << 23)
    return portable(found.groupBy("table", "reason").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys")))


def _planted(star: Star) -> Star:
    """Customers and orders that are stored already, new orders (some twice, some of nobody) and their
    items (some of no product) and reviews."""

    def key(name: str) -> Column:
        return F.col(name).cast("long")

    def renamed(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumns({n: F.concat(F.lit("N"), n) for n in names})

    again = star.orders.where(key("order_id") % 10 == 0)
    new = star.orders.where(key("order_id") % 10 == 1)
    nobody = F.when(key("order_id") % 3 == 0, F.lit("nobody")).otherwise(F.col("customer_id"))
    twice = F.explode(F.when(key("order_id") % 50 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    orders = again.unionByName(renamed(new.withColumn("customer_id", nobody).withColumn("copy", twice).drop("copy"), "order_id"))
    ghost = F.when(F.col("order_item_id") == 2, F.lit("ghost")).otherwise(F.col("product_id"))
    items = star.order_items.where(key("order_id") % 10 == 1).withColumn("product_id", ghost)
    reviews = star.reviews.where(key("order_id") % 10 == 1)
    frames = {name: df.limit(0) for name, df in star.items()} | {
        "dim_customers": star.customers.where(key("customer_id") % 10 == 0),
        "fact_orders": orders,
        "fact_order_items": renamed(items, "order_id"),
        "fact_reviews": renamed(reviews, "order_id", "review_id"),
    }
    return Star({name: lambda df=df: df for name, df in frames.items()})


def _stored(spark: SparkSession, folder: str) -> Star:
    """The star as written to a fresh shared folder and read back."""
    target = _fresh(spark, "star")
    write_star(sample_star(spark, folder), target)
    return read_star(spark, target)


def retention_curve_observed(spark: SparkSession, folder: str) -> DataFrame:
    star = sample_star(spark, folder)
    return portable(cohorts.retention_curve(star, None, observed_only=True))


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: _clean(table) for name, table in CLEAN_TABLES.items()}
    found |= {report.__name__: _on_star(report) for report in STAR_REPORTS}
    found |= {report.__name__: _on_clusters(report) for report in CLUSTER_REPORTS}
    extra = (
        kmeans_k_search,
        kmeans_segments,
        export_clusters,
        load_raw,
        verify_load,
        surrogate_keys,
        surrogate_key_figures,
        pk_duplicates,
        fk_orphans,
        cleaning_report,
        retention_counts_wide,
        stored_revenue_waterfall,
        stored_seller_performance,
        bucketed_revenue_waterfall,
        bucketed_seller_performance,
        sql_monthly_revenue,
        append_rejects,
        retention_curve_observed,
    )
    return found | {query.__name__: query for query in extra}
