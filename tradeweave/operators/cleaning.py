"""Raw tables to star tables.

Raw frames carry ``ingest_id``, the place of a row in its file, so that "keep the first"
means the same row on every run.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave.functions.dates import as_moment, elapsed_days, month_of
from tradeweave.functions.rounding import ratio
from tradeweave.functions.text import title_case
from tradeweave.plans.quantiles import grouped_quantiles
from tradeweave.schemas import STAR


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's own columns, in order and with its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STAR[table].fields])


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """First row per key in file order.

    The ``= 1`` filter lets Spark drop all but one row per key before the shuffle
    (WindowGroupLimit), so a key with very many copies does not pile up in one task.
    """
    place = Window.partitionBy(key).orderBy("ingest_id")
    return df.withColumn("copy", F.row_number().over(place)).filter("copy = 1").drop("copy")


def clean_customers(raw: DataFrame) -> DataFrame:
    return conform(
        keep_first(raw, "customer_id").withColumns(
            {
                "customer_zip_prefix": F.col("customer_zip_code_prefix"),
                "customer_city": title_case("customer_city"),
                "customer_state": title_case("customer_state"),
            }
        ),
        "dim_customers",
    )


def clean_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with English categories; a category without translation becomes 'other'."""
    names = translation.select("product_category_name", "product_category_name_english")
    named = keep_first(raw, "product_id").join(names, "product_category_name", "left")
    return conform(
        named.withColumnsRenamed(
            {
                "product_category_name": "product_category",
                "product_name_lenght": "product_name_length",
                "product_description_lenght": "product_description_length",
            }
        ).withColumn(
            "product_category_english",
            F.coalesce("product_category_name_english", F.lit(L.OTHER_CATEGORY)),
        ),
        "dim_products",
    )


def clean_sellers(raw: DataFrame) -> DataFrame:
    return conform(
        keep_first(raw, "seller_id").withColumns(
            {
                "seller_zip_prefix": F.col("seller_zip_code_prefix"),
                "seller_city": title_case("seller_city"),
                "seller_state": title_case("seller_state"),
            }
        ),
        "dim_sellers",
    )


def clean_geolocation(raw: DataFrame) -> DataFrame:
    """One row per zip prefix: median coordinates, first known city and state."""
    zipped = raw.withColumnRenamed("geolocation_zip_code_prefix", "geolocation_zip_prefix").filter(
        F.col("geolocation_zip_prefix").isNotNull()
    )

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("ingest_id"))).alias(name)

    places = zipped.groupBy("geolocation_zip_prefix").agg(
        first_known("geolocation_city"), first_known("geolocation_state")
    )
    medians = _medians(zipped, "geolocation_zip_prefix", ["geolocation_lat", "geolocation_lng"])
    return conform(
        places.join(medians, "geolocation_zip_prefix", "left").withColumns(
            {
                "geolocation_city": title_case("geolocation_city"),
                "geolocation_state": F.upper(F.trim("geolocation_state")),
            }
        ),
        "dim_geolocation",
    )


def _medians(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """Exact medians of several axes per key, to 6 decimals, over one shared ordering.

    Works in whole millionths; twice the median is then whole and rounds exactly.
    """
    points = df.select(
        key,
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("deg")) for a in axes])
        ).alias("p"),
    ).select(key, "p.axis", F.round(F.col("p.deg") * 1_000_000).cast("long").alias("micro"))
    counts = (
        points.filter(F.col("micro").isNotNull())
        .groupBy(key, "axis", "micro")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    middles = grouped_quantiles(counts, [key, "axis"], "micro", "rows", {"middle": 0.5})
    doubled = F.round(F.col("middle") * 2).cast("long")
    return middles.groupBy(key).agg(
        *[
            F.max(F.when(F.col("axis") == a, ratio(doubled, F.lit(2_000_000), 6, signed=True))).alias(a)
            for a in axes
        ]
    )


def clean_orders(raw: DataFrame) -> DataFrame:
    """Orders with delivery days, days early (+) or late (-), late flag and month."""
    moments = [f.name for f in STAR["fact_orders"].fields if f.dataType.typeName() == "timestamp_ntz"]
    orders = keep_first(raw, "order_id")
    orders = orders.withColumns({name: as_moment(orders, name) for name in moments})
    bought, delivered, promised = (
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    return conform(
        orders.withColumns(
            {
                "delivery_days_actual": elapsed_days(delivered, bought),
                "delivery_days_estimated": elapsed_days(promised, bought),
                "delivery_delta_days": elapsed_days(promised, delivered),
                "is_late_delivery": F.coalesce(
                    (F.col(delivered) > F.col(promised)).cast("int"), F.lit(0)
                ),
                "order_month": month_of(bought),
            }
        ),
        "fact_orders",
    )


def clean_order_items(raw: DataFrame) -> DataFrame:
    return conform(
        raw.filter(F.col("price") > 0).withColumns(
            {
                "total_value": F.col("price") + F.col("freight_value"),
                "shipping_limit_date": as_moment(raw, "shipping_limit_date"),
            }
        ),
        "fact_order_items",
    )


def clean_payments(raw: DataFrame) -> DataFrame:
    return conform(raw.filter(F.col("payment_value") > 0), "fact_payments")


def clean_reviews(raw: DataFrame) -> DataFrame:
    reviews = keep_first(raw, "review_id").filter(F.col("review_score").between(1, 5))
    return conform(
        reviews.fillna("", ["review_comment_title", "review_comment_message"]).withColumns(
            {
                name: as_moment(reviews, name)
                for name in ("review_creation_date", "review_answer_timestamp")
            }
        ),
        "fact_reviews",
    )
