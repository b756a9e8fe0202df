"""Raw marketplace tables derived from the order-book sample tables.

Maps ``customer orders lineitem part supplier nation region`` onto the nine raw inputs
with whole-number arithmetic only, adding the flaws cleaning has to handle: duplicate
reviews, scores out of range, worthless payments, free items and untranslated categories.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.plans.star import Star, Tables, star_from_raw

# Order priority -> status of an order still in progress / payment type
OPEN_STATUS = {"1-URGENT": "canceled", "2-HIGH": "invoiced", "3-MEDIUM": "processing"}
OPEN_STATUS_REST = "shipped"
PAYMENT_TYPES = {
    "1-URGENT": "credit_card",
    "2-HIGH": "boleto",
    "3-MEDIUM": "voucher",
    "4-NOT SPECIFIED": "debit_card",
}
PAYMENT_TYPE_REST = "not_defined"


def _text(column: Column) -> Column:
    return column.cast("string")


def _hundredths(name: str) -> Column:
    """A double with two decimals as a whole number; far cheaper than a cast to decimal."""
    return F.rint(F.col(name) * 100).cast("long")


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(12,0)") * F.lit(Decimal("0.01"))).cast("decimal(12,2)")


def _lookup(key: Column, names: dict[str, str], rest: str) -> Column:
    chain = F
    for value, name in names.items():
        chain = chain.when(key == value, F.lit(name))
    return chain.otherwise(F.lit(rest))


def _plus_seconds(moment: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return moment + F.make_dt_interval(secs=seconds)


class SampleTables:
    """The sample folder's Parquet tables, one method per raw input."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("ingest_id"),
                _text(key).alias("customer_id"),
                _text(F.floor(key / 2)).alias("customer_unique_id"),
                _text(key % 100).alias("customer_zip_code_prefix"),
                F.col("c_mktsegment").alias("customer_city"),
                F.col("n_name").alias("customer_state"),
            )
        )

    def sellers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("ingest_id"),
                _text(key).alias("seller_id"),
                _text(key % 100).alias("seller_zip_code_prefix"),
                F.col("r_name").alias("seller_city"),
                F.col("n_name").alias("seller_state"),
            )
        )

    def products(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        return self.read("part").select(
            key.alias("ingest_id"),
            _text(key).alias("product_id"),
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            (F.length("p_name") * 10).alias("product_description_lenght"),
            (size % 6 + 1).alias("product_photos_qty"),
            F.when(key % 50 != 0, size * 200).alias("product_weight_g"),
            size.cast("decimal(10,2)").alias("product_length_cm"),
            size.cast("decimal(10,2)").alias("product_height_cm"),
            size.cast("decimal(10,2)").alias("product_width_cm"),
        )

    def category_translation(self) -> DataFrame:
        names = self.read("part").select("p_name").filter(~F.col("p_name").startswith("red "))
        return names.distinct().select(
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("product_category_name"),
            F.col("p_name").alias("product_category_name_english"),
        )

    def geolocation(self) -> DataFrame:
        balance = _money(_hundredths("c_acctbal"))
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("ingest_id"),
                _text(F.col("c_custkey") % 100).alias("geolocation_zip_code_prefix"),
                (balance / 100).cast("decimal(10,6)").alias("geolocation_lat"),
                (-balance / 50).cast("decimal(10,6)").alias("geolocation_lng"),
                F.col("c_mktsegment").alias("geolocation_city"),
                F.col("n_name").alias("geolocation_state"),
            )
        )

    def _order_facts(self) -> DataFrame:
        key = F.col("o_orderkey")
        bought = _plus_seconds(F.col("o_orderdate").cast("timestamp_ntz"), key * 7919 % 86400)
        finished = F.col("o_orderstatus").isin("F", "O")
        return (
            self.read("orders")
            .withColumn("bought", bought)
            .select(
                key.alias("ingest_id"),
                _text(key).alias("order_id"),
                _text(F.col("o_custkey")).alias("customer_id"),
                F.when(finished, F.lit("delivered"))
                .otherwise(_lookup(F.col("o_orderpriority"), OPEN_STATUS, OPEN_STATUS_REST))
                .alias("order_status"),
                F.col("bought").alias("order_purchase_timestamp"),
                _plus_seconds(F.col("bought"), 3600).alias("order_approved_at"),
                F.when(finished, _plus_seconds(F.col("bought"), 43200)).alias(
                    "order_delivered_carrier_date"
                ),
                F.when(
                    finished & (key % 97 != 0),
                    _plus_seconds(F.col("bought"), key * 104729 % 2592000 + 86400),
                ).alias("order_delivered_customer_date"),
                F.date_add(F.to_date("bought"), (key * 13 % 30 + 12).cast("int"))
                .cast("timestamp_ntz")
                .alias("order_estimated_delivery_date"),
            )
        )

    def orders(self) -> DataFrame:
        return self._order_facts()

    def order_items(self) -> DataFrame:
        price = _hundredths("l_extendedprice")
        freight = F.call_function("div", price * _hundredths("l_tax") + 50, F.lit(100))
        free = (F.col("l_tax") == 0) & (F.col("l_discount") == 0)
        return self.read("lineitem").select(
            _text(F.col("l_orderkey")).alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            _text(F.col("l_partkey")).alias("product_id"),
            _text(F.col("l_suppkey")).alias("seller_id"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("shipping_limit_date"),
            _money(F.when(free, F.lit(0)).otherwise(price)).alias("price"),
            _money(freight).alias("freight_value"),
        )

    def payments(self) -> DataFrame:
        key = F.col("o_orderkey")

        def payment(place: int, kind: Column, installments: Column, value: Column) -> Column:
            return F.struct(
                F.lit(place).alias("payment_sequential"),
                kind.alias("payment_type"),
                installments.cast("int").alias("payment_installments"),
                _money(value).alias("payment_value"),
            )

        kind = _lookup(F.col("o_orderpriority"), PAYMENT_TYPES, PAYMENT_TYPE_REST)
        made = F.array(
            payment(1, kind, key % 13, _hundredths("o_totalprice")),
            F.when(key % 10 == 0, payment(2, F.lit("voucher"), F.lit(1), F.lit(1000))),
            F.when(key % 101 == 0, payment(3, F.lit("voucher"), F.lit(1), F.lit(0))),
        )
        return (
            self.read("orders")
            .select(_text(key).alias("order_id"), F.explode(F.array_compact(made)).alias("p"))
            .select("order_id", "p.*")
        )

    def reviews(self) -> DataFrame:
        orders = self._order_facts()
        key = F.col("ingest_id")
        late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
        late = F.coalesce(late.cast("int"), F.lit(0))
        score = F.least(F.lit(5), F.greatest(F.lit(1), 5 - 2 * late - key % 7 % 3))

        def review(name: str, place: int, value: Column) -> Column:
            return F.struct(
                F.concat("order_id", F.lit(name)).alias("review_id"),
                (key * 10 + place).alias("ingest_id"),
                value.cast("int").alias("review_score"),
            )

        reviewed = key % 20 != 0
        made = F.array(
            F.when(reviewed, review("-a", 1, score)),
            F.when(reviewed & (key % 50 == 1), review("-b", 2, key % 5 + 1)),
            F.when(reviewed & (key % 100 == 3), review("-a", 3, F.lit(1))),
            F.when(reviewed & (key % 211 == 0), review("-c", 4, F.lit(9))),
        )
        written = F.date_add(F.to_date("order_purchase_timestamp"), 30).cast("timestamp_ntz")
        return orders.select(
            "order_id",
            F.when(key % 3 == 0, F.lit("short note")).alias("review_comment_title"),
            F.when(key % 4 == 0, F.concat(F.lit("about order "), F.col("order_id"))).alias(
                "review_comment_message"
            ),
            written.alias("review_creation_date"),
            _plus_seconds(written, 172800).alias("review_answer_timestamp"),
            F.explode(F.array_compact(made)).alias("r"),
        ).select("order_id", "r.*", *[c for c in _REVIEW_TEXTS])


_REVIEW_TEXTS = (
    "review_comment_title",
    "review_comment_message",
    "review_creation_date",
    "review_answer_timestamp",
)

RAW_NAMES = (
    "customers",
    "orders",
    "order_items",
    "payments",
    "reviews",
    "products",
    "sellers",
    "geolocation",
    "category_translation",
)


def sample_raw(spark: SparkSession, folder: str) -> Tables:
    tables = SampleTables(spark, folder)
    return Tables({name: getattr(tables, name) for name in RAW_NAMES})


def sample_star(spark: SparkSession, folder: str) -> Star:
    return star_from_raw(sample_raw(spark, folder))
