"""CSV in, warehouse out, and checks in between."""

import pytest
from pyspark.sql import functions as F

from tradeweave.operators import overview, quality
from tradeweave.plans.star import star_from_raw
from tradeweave.schemas import RAW, STAR
from tradeweave.sources import files, warehouse
from tradeweave.sources.sample import sample_star

ROWS = {
    "customers": ["c1,u1,01000,  são paulo ,SP", "c1,u9,01000,copy,SP", "c2,u1,01000,d'oeste,RJ"],
    "orders": [
        "o1,c1,delivered,2018-01-01 10:00:00,,,2018-01-03 10:00:00,2018-01-10 00:00:00",
        "o2,c2,shipped,not a date,,,,",
    ],
    "order_items": ["o1,1,p1,s1,2018-01-02 00:00:00,10.00,2.50", "o1,2,p2,s1,,0,1.00"],
    "payments": ["o1,1,credit_card,3,12.50", "o1,2,voucher,1,0.00"],
    "reviews": ['r1,o1,5,,"two\nlines, ""quoted""",2018-01-04 00:00:00,2018-01-05 00:00:00'],
    "products": ["p1,beleza,5,100,1,400,10,10,10", "p2,desconhecido,5,100,1,,10,10,10"],
    "sellers": ["s1,02000,rio claro,SP"],
    "geolocation": ["01000,-23.5,-46.6,sao paulo,sp"],
    "category_translation": ["beleza,health_beauty"],
}


@pytest.fixture
def paths(tmp_path):
    for name, rows in ROWS.items():
        header = ",".join(RAW[name].fieldNames())
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return {name: str(tmp_path / f"{name}.csv") for name in ROWS}


def test_csv_to_report(spark, paths):
    star = star_from_raw(files.load_raw(spark, paths))
    people = {r["customer_id"]: r for r in star.customers.collect()}
    assert people["c1"]["customer_unique_id"] == "u1"
    assert people["c1"]["customer_city"] == "São Paulo" and people["c2"]["customer_city"] == "D'Oeste"
    assert star.reviews.first()["review_comment_message"] == 'two\nlines, "quoted"'
    categories = {r["product_id"]: r["product_category_english"] for r in star.products.collect()}
    assert categories == {"p1": "health_beauty", "p2": "other"}
    kpis = overview.baseline_kpis(star).first()
    assert (kpis["total_orders"], str(kpis["total_revenue"])) == (1, "12.50")
    assert star.orders.filter("order_id = 'o2'").first()["order_purchase_timestamp"] is None
    for table, frame in star.items():
        assert frame.schema.fieldNames() == STAR[table].fieldNames()


def test_missing_files_are_all_named(spark, paths):
    assert files.load_csv(spark, "/nowhere/orders.csv", "orders") is None
    with pytest.raises(FileNotFoundError, match="orders, sellers"):
        files.load_raw(spark, {**paths, "orders": "/nowhere/a", "sellers": "/nowhere/b"})


def test_warehouse_round_trip(spark, tmp_path):
    star = sample_star(spark, "/root/testdata/sf0.001")
    folder = str(tmp_path / "star")
    warehouse.write_star(star, folder, number_rows=True)
    stored = warehouse.read_star(spark, folder)
    assert {r["ok"] for r in quality.verify_load(star, stored).collect()} == {1}
    ids = spark.read.parquet(f"{folder}/fact_order_items").agg(
        F.min("item_id"), F.max("item_id"), F.count_distinct("item_id"), F.count("*")
    )
    low, high, distinct, rows = ids.first()
    assert (low, high, distinct) == (1, rows, rows)
    same = overview.revenue_by_state(stored).collect()
    assert same == overview.revenue_by_state(star).collect()
    # appending again doubles the tables and the check says so; overwriting mends it
    for mode, ok in (("append", 0), ("overwrite", 1)):
        warehouse.write_star(star, folder, mode=mode)
        again = quality.verify_load(star, warehouse.read_star(spark, folder))
        assert again.first()["all_ok"] == ok


def test_filters_reach_the_stored_table(spark, tmp_path):
    star = sample_star(spark, "/root/testdata/sf0.001")
    warehouse.write_star(star, str(tmp_path / "s"))
    stored = warehouse.read_star(spark, str(tmp_path / "s"))
    plan = overview.monthly_order_volume(stored)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_status,delivered)" in plan and "order_approved_at" not in plan


def test_clusters_are_replaced(spark, tmp_path):
    row = ("u", 1, 2, 3.0, 0, "Champions")
    df = spark.createDataFrame(
        [row], "customer_unique_id string, recency int, frequency int, monetary double, "
        "cluster int, segment string"
    )
    for _ in range(2):
        warehouse.export_clusters(df, str(tmp_path))
    assert [tuple(r) for r in warehouse.read_clusters(spark, str(tmp_path)).collect()] == [row]


def test_scans(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert files.scan_table(spark, "three").count() == 3
    assert files.scan_sql(spark, "SELECT * FROM three WHERE id > 0").count() == 2


def test_saved_table_is_replaced(spark):
    """A catalog table is replaced as a whole and read back by name and by statement."""
    from tradeweave.sources import files

    try:
        for n in (3, 2):
            warehouse.save_table(spark.range(n).withColumnRenamed("id", "k"), "saved_numbers")
        assert sorted(r["k"] for r in files.scan_table(spark, "saved_numbers").collect()) == [0, 1]
        found = files.scan_sql(spark, "SELECT sum(k) AS total FROM saved_numbers").collect()
        assert found[0]["total"] == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS saved_numbers")
