"""Loads: one commit for eight tables, keys kept on append, buckets, figures while writing."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tradeweave.operators import quality, revenue, sellers
from tradeweave.plans import bloom
from tradeweave.plans.ordering import counted
from tradeweave.plans.star import Star, Tables
from tradeweave.registry import _planted
from tradeweave.schemas import STAR
from tradeweave.sources import commits, warehouse
from tradeweave.sources.checked import append_checked
from tradeweave.sources.sample import sample_star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return sample_star(spark, FOLDER)


def sizes(star):
    return {t: star[t].count() for t in STAR}


class Killed(Exception):
    pass


def breaking(star, after=5):
    """The star, until the load asks for its sixth table."""

    def loader(n, table):
        def load():
            if n >= after:
                raise Killed
            return star[table].limit(3)

        return load

    return Tables({t: loader(n, t) for n, t in enumerate(STAR)})


@pytest.mark.parametrize("mode", ["overwrite", "append"])
def test_a_killed_load_changes_nothing(spark, star, tmp_path, mode):
    folder = str(tmp_path)
    warehouse.write_star(star, folder)
    before = sizes(warehouse.read_star(spark, folder))
    with pytest.raises(Killed):
        warehouse.write_star(breaking(star), folder, mode=mode)
    assert sizes(warehouse.read_star(spark, folder)) == before
    # a reader that began before a load goes on with the star that it found
    reader = warehouse.read_star(spark, folder)
    warehouse.write_star(star, folder, mode=mode)
    assert sizes(reader) == before
    times = 1 if mode == "overwrite" else 2
    assert sizes(warehouse.read_star(spark, folder)) == {t: n * times for t, n in before.items()}


def test_a_named_load_counts_once(spark, star, tmp_path):
    folder = str(tmp_path)
    first = warehouse.write_star(star, folder, mode="append", load="monday")
    assert warehouse.write_star(star, folder, mode="append", load="monday") == {}
    assert sizes(warehouse.read_star(spark, folder)) == {t: f["rows"] for t, f in first.items()}
    assert append_checked(star, folder, load="monday").collect() == []
    with pytest.raises(ValueError):
        warehouse.write_star(star, folder, mode="replace")


def test_two_loads_cannot_commit_the_same_number(spark, tmp_path):
    assert commits.latest(spark, str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        warehouse.read_star(spark, str(tmp_path))
    commit = commits.Commit().with_version(STAR, "a", keep=True, load=None)
    commits.publish(spark, str(tmp_path), commit)
    with pytest.raises(RuntimeError, match="another load"):
        commits.publish(spark, str(tmp_path), commit)
    assert commits.latest(spark, str(tmp_path)) == commit


def test_figures_of_an_empty_star(spark, tmp_path):
    frames = {t: spark.createDataFrame([], s) for t, s in STAR.items()}
    star = Star({t: lambda df=df: df for t, df in frames.items()})
    figures = warehouse.write_star(star, str(tmp_path), watched=quality.star_figures())
    assert {f["rows"] for f in figures.values()} == {0} and figures["fact_orders"]["late"] is None
    raw = {"geolocation": {"rows": 0}, "order_items": {"rows": 0, "removed": None}}
    cleaned = quality.cleaning_report(raw, figures, warehouse.read_star(spark, str(tmp_path))).collect()
    assert len(cleaned) == 16 and {r["value"] for r in cleaned} == {0, None}
    report = quality.verify_load({t: f["rows"] for t, f in figures.items()}, warehouse.read_star(spark, str(tmp_path)))
    assert report.first()["all_ok"] == 1
    assert append_checked(star, str(tmp_path)).collect() == []


def test_lost_rows_are_told(spark, star, tmp_path):
    figures = warehouse.write_star(star, str(tmp_path))
    expected = {t: f["rows"] for t, f in figures.items()} | {"fact_payments": 0}
    found = {r["table"]: r["ok"] for r in quality.verify_load(expected, warehouse.read_star(spark, str(tmp_path))).collect()}
    assert found.pop("fact_payments") == 0 and set(found.values()) == {1}


# --- keys


def hand_made(spark, **rows):
    def frame(table):
        names = STAR[table].fieldNames()
        full = [tuple(dict(r).get(n) for n in names) for r in rows.get(table, [])]
        return spark.createDataFrame(full, STAR[table])

    return Star({t: lambda t=t: frame(t) for t in STAR})


def order(key, customer="c1"):
    return {"order_id": key, "customer_id": customer, "order_purchase_timestamp": datetime(2018, 1, 1)}


def test_rejects(spark, tmp_path):
    folder = str(tmp_path)
    warehouse.write_star(
        hand_made(spark, dim_customers=[{"customer_id": "c1"}], dim_products=[{"product_id": "p1"}], fact_orders=[order("o1")]), folder
    )
    load = hand_made(
        spark,
        dim_customers=[{"customer_id": "c1"}, {"customer_id": "c2"}, {"customer_id": None}, {"customer_id": "c2"}],
        fact_orders=[order("o1"), order("o2"), order("o3", "c2"), order("o4", "c9"), order("o5", None)],
        fact_order_items=[
            {"order_id": "o1", "order_item_id": 1, "product_id": "p1"},  # an old order and product
            {"order_id": "o3", "order_item_id": 1, "product_id": "p2"},
            {"order_id": "o4", "order_item_id": 1, "product_id": "p2"},  # both wrong: the order comes first
            {"order_id": None, "order_item_id": 1, "product_id": None},
        ],
        fact_reviews=[{"review_id": "r1", "order_id": "o9"}, {"review_id": "r2", "order_id": "o5"}],
    )
    for time in (1, 2):  # the second time all that went in before is there already
        rejects = {(r["table"], r["key"], r["reason"]): r["row"] for r in append_checked(load, folder, bits=1 << 16).collect()}
        expected = {
            ("dim_customers", "c1", "duplicate key"),
            ("dim_customers", "c2", "duplicate key"),
            ("dim_customers", None, "null key"),
            ("fact_orders", "o1", "duplicate key"),
            ("fact_orders", "o4", "no such dim_customers"),
            ("fact_order_items", None, "no such dim_products"),
            ("fact_order_items", None, "no such fact_orders"),
            ("fact_reviews", "r1", "no such fact_orders"),
        }
        if time == 2:
            expected |= {("fact_orders", k, "duplicate key") for k in ("o2", "o3", "o5")} | {("fact_reviews", "r2", "duplicate key")}
        assert set(rejects) == expected
        assert '"order_id":"o4"' in rejects["fact_order_items", None, "no such fact_orders"]
        stored = warehouse.read_star(spark, folder)
        for table, key, keys in (
            ("dim_customers", "customer_id", ["c1", "c2"]),
            ("fact_orders", "order_id", ["o1", "o2", "o3", "o5"]),
            ("fact_reviews", "review_id", ["r2"]),
        ):
            assert sorted(r[key] for r in stored[table].collect()) == keys
        assert stored["fact_order_items"].count() == 2 * time  # items have no key of their own


def test_new_keys_are_not_looked_up(spark, star, tmp_path, monkeypatch):
    """What the filters do not know is new: the stored keys are not read for it."""
    from tradeweave.sources import checked

    folder = str(tmp_path)
    warehouse.write_star(star, folder)
    append_checked(_planted(star), folder, bits=1 << 20)
    fresh = hand_made(spark, dim_customers=[{"customer_id": f"new {k}"} for k in range(50)])
    looked = []
    plain = checked._Stored.keys
    monkeypatch.setattr(checked._Stored, "keys", lambda self, t: looked.append(t) or plain(self, t))
    complete = checked._Stored.complete
    monkeypatch.setattr(checked._Stored, "complete", lambda self, t: complete(self, t) or looked.append(self.commit.filters[t]))
    assert append_checked(fresh, folder, bits=1 << 20).collect() == []
    assert all(len(x) == 2 for x in looked if isinstance(x, list))  # no filter had to be made anew


def test_filters_know_all_their_keys(spark):
    keys = spark.range(0, 20000).selectExpr("CAST(id AS string) AS k")
    one, other = (bloom.build(keys.where(f"k % 2 = {n}"), 1 << 18) for n in (0, 1))
    built = bloom.united([one, other])
    asked = spark.range(10000, 40000).selectExpr("IF(id = 39999, NULL, CAST(id AS string)) AS k")
    found = {r["k"] for r in bloom.possible(asked, built, 1 << 18).collect()}
    assert {str(k) for k in range(10000, 20000)} <= found and len(found) < 10000 + 20000 // 50
    assert bloom.possible(asked, bloom.build(keys.limit(0)), 1 << 18).collect() == []


# --- numbers and buckets


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_without_an_order(spark, star):
    df = counted(star.order_items.repartition(7), "number")
    assert "rangepartitioning" not in planned(df) and "Sort [order_id" not in planned(df)
    rows, low, high, distinct = df.agg(F.count("*"), F.min("number"), F.max("number"), F.count_distinct("number")).first()
    assert (low, high, distinct) == (1, rows, rows) and rows == star.order_items.count()
    assert counted(star.order_items.limit(0), "number").collect() == []


@pytest.mark.parametrize("report", [revenue.revenue_waterfall, sellers.seller_performance])
def test_bucketed_facts_are_not_shuffled_by_order(spark, star, tmp_path, no_broadcast, report):
    warehouse.save_star(star, "bucketed_", str(tmp_path), buckets=4)
    try:
        stored = warehouse.catalog_star(spark, "bucketed_")
        source = revenue.order_sales(stored) if report is revenue.revenue_waterfall else sellers.seller_sums(stored)
        plan = planned(source)
        assert "fact_order_items" in plan and "Bucketed: true" in plan
        assert not re.search(r"Exchange hashpartitioning\(order_id", plan)
        assert "Exchange hashpartitioning(order_id" in planned(
            revenue.order_sales(star) if report is revenue.revenue_waterfall else sellers.seller_sums(star)
        )
        assert report(stored).collect() == report(star).collect()
    finally:
        for table in STAR:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{table}")


def test_cleaning_reads_each_raw_table_once(spark, tmp_path):
    """The figures come with the write: the plans that ran hold one scan of each raw file."""
    from tradeweave import registry

    seen = []
    plain = registry.sample_raw

    def noted(session, folder):
        tables = plain(session, folder)
        return Tables({n: lambda n=n: (seen.append(n), tables[n])[1] for n in tables})

    registry.sample_raw = noted
    try:
        assert registry.cleaning_report(spark, FOLDER).count() == 16
    finally:
        registry.sample_raw = plain
    assert sorted(seen) == sorted(set(seen))
