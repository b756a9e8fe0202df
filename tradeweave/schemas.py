"""Input layouts, the star's columns, and its keys."""

from pyspark.sql import types as T

TEXT, WHOLE = T.StringType(), T.IntegerType()
MOMENT, MONEY = T.TimestampNTZType(), T.DecimalType(12, 2)
SIZE, DEGREES = T.DecimalType(10, 2), T.DecimalType(10, 6)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Raw files.  Fixed values: these header names, two misspelt, are what the files carry.
# Timestamps stay text here because bad ones turn into null during cleaning.
RAW = {
    "customers": _struct(
        customer_id=TEXT,
        customer_unique_id=TEXT,
        customer_zip_code_prefix=TEXT,
        customer_city=TEXT,
        customer_state=TEXT,
    ),
    "orders": _struct(
        order_id=TEXT,
        customer_id=TEXT,
        order_status=TEXT,
        order_purchase_timestamp=TEXT,
        order_approved_at=TEXT,
        order_delivered_carrier_date=TEXT,
        order_delivered_customer_date=TEXT,
        order_estimated_delivery_date=TEXT,
    ),
    "order_items": _struct(
        order_id=TEXT,
        order_item_id=WHOLE,
        product_id=TEXT,
        seller_id=TEXT,
        shipping_limit_date=TEXT,
        price=MONEY,
        freight_value=MONEY,
    ),
    "payments": _struct(
        order_id=TEXT,
        payment_sequential=WHOLE,
        payment_type=TEXT,
        payment_installments=WHOLE,
        payment_value=MONEY,
    ),
    "reviews": _struct(
        review_id=TEXT,
        order_id=TEXT,
        review_score=WHOLE,
        review_comment_title=TEXT,
        review_comment_message=TEXT,
        review_creation_date=TEXT,
        review_answer_timestamp=TEXT,
    ),
    "products": _struct(
        product_id=TEXT,
        product_category_name=TEXT,
        product_name_lenght=WHOLE,
        product_description_lenght=WHOLE,
        product_photos_qty=WHOLE,
        product_weight_g=WHOLE,
        product_length_cm=SIZE,
        product_height_cm=SIZE,
        product_width_cm=SIZE,
    ),
    "sellers": _struct(
        seller_id=TEXT, seller_zip_code_prefix=TEXT, seller_city=TEXT, seller_state=TEXT
    ),
    "geolocation": _struct(
        geolocation_zip_code_prefix=TEXT,
        geolocation_lat=T.DecimalType(20, 15),
        geolocation_lng=T.DecimalType(20, 15),
        geolocation_city=TEXT,
        geolocation_state=TEXT,
    ),
    "category_translation": _struct(
        product_category_name=TEXT, product_category_name_english=TEXT
    ),
}

# The star: dimensions first, then facts.
STAR = {
    "dim_customers": _struct(
        customer_id=TEXT,
        customer_unique_id=TEXT,
        customer_city=TEXT,
        customer_state=TEXT,
        customer_zip_prefix=TEXT,
    ),
    "dim_products": _struct(
        product_id=TEXT,
        product_category=TEXT,
        product_category_english=TEXT,
        product_weight_g=WHOLE,
        product_length_cm=SIZE,
        product_height_cm=SIZE,
        product_width_cm=SIZE,
        product_photos_qty=WHOLE,
        product_name_length=WHOLE,
        product_description_length=WHOLE,
    ),
    "dim_sellers": _struct(
        seller_id=TEXT, seller_city=TEXT, seller_state=TEXT, seller_zip_prefix=TEXT
    ),
    "dim_geolocation": _struct(
        geolocation_zip_prefix=TEXT,
        geolocation_lat=DEGREES,
        geolocation_lng=DEGREES,
        geolocation_city=TEXT,
        geolocation_state=TEXT,
    ),
    "fact_orders": _struct(
        order_id=TEXT,
        customer_id=TEXT,
        order_status=TEXT,
        order_purchase_timestamp=MOMENT,
        order_approved_at=MOMENT,
        order_delivered_carrier_date=MOMENT,
        order_delivered_customer_date=MOMENT,
        order_estimated_delivery_date=MOMENT,
        delivery_days_actual=WHOLE,
        delivery_days_estimated=WHOLE,
        delivery_delta_days=WHOLE,
        is_late_delivery=WHOLE,
        order_month=TEXT,
    ),
    "fact_order_items": _struct(
        order_id=TEXT,
        order_item_id=WHOLE,
        product_id=TEXT,
        seller_id=TEXT,
        shipping_limit_date=MOMENT,
        price=MONEY,
        freight_value=MONEY,
        total_value=MONEY,
    ),
    "fact_payments": _struct(
        order_id=TEXT,
        payment_sequential=WHOLE,
        payment_type=TEXT,
        payment_installments=WHOLE,
        payment_value=MONEY,
    ),
    "fact_reviews": _struct(
        review_id=TEXT,
        order_id=TEXT,
        review_score=WHOLE,
        review_comment_title=TEXT,
        review_comment_message=TEXT,
        review_creation_date=MOMENT,
        review_answer_timestamp=MOMENT,
    ),
}

# Primary keys; those of items and payments are numbers given on load.
PRIMARY_KEYS = {
    "dim_customers": "customer_id",
    "dim_products": "product_id",
    "dim_sellers": "seller_id",
    "dim_geolocation": "geolocation_zip_prefix",
    "fact_orders": "order_id",
    "fact_reviews": "review_id",
    "fact_order_items": "item_id",
    "fact_payments": "payment_id",
}

# Row numbers added on load: table -> new column
SURROGATE_KEYS = {"fact_order_items": "item_id", "fact_payments": "payment_id"}

# (child table, child column, parent table); the parent column is its primary key
FOREIGN_KEYS = (
    ("fact_orders", "customer_id", "dim_customers"),
    ("fact_order_items", "order_id", "fact_orders"),
    ("fact_order_items", "product_id", "dim_products"),
    ("fact_order_items", "seller_id", "dim_sellers"),
    ("fact_payments", "order_id", "fact_orders"),
    ("fact_reviews", "order_id", "fact_orders"),
)
