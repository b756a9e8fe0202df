"""Distributed ranking against plain Spark windows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeweave.plans.ordering import numbered, running, standing, tiled, tiled_each, value_standing
from tradeweave.plans.quantiles import grouped_quantiles


def as_rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("n, tiles", [(3, 5), (5, 5), (13, 5), (0, 4), (1000, 7)])
def test_ntile(spark, n, tiles):
    df = spark.range(n).withColumn("key", F.col("id") % 3)
    plain = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(F.desc("key"), "id")))
    ours = tiled(df.repartition(4), "t", tiles, F.desc("key"), F.asc("id"))
    assert as_rows(ours.select("id", "t"), "id") == as_rows(plain.select("id", "t"), "id")


@pytest.mark.parametrize("n", [0, 3, 14])
def test_several_tiles_at_once(spark, n):
    df = spark.range(n).selectExpr("id", "id % 3 AS a", "CASE WHEN id % 4 > 0 THEN id END AS b")
    ours = tiled_each(df.repartition(3), "id", 5, {"ta": -F.col("a"), "tb": F.col("b")})
    plain = df.select(
        "*",
        F.ntile(5).over(Window.orderBy(F.desc("a"), "id")).alias("ta"),
        F.ntile(5).over(Window.orderBy("b", "id")).alias("tb"),
    )
    assert as_rows(ours, "id") == as_rows(plain, "id")


@pytest.mark.parametrize("key", ["1", "CASE WHEN id % 3 = 0 THEN id END"])
def test_positions_with_one_key_or_null_keys(spark, key):
    df = spark.range(500).withColumn("key", F.expr(key))
    plain = df.withColumn("p", F.row_number().over(Window.orderBy("key", "id")))
    ours = numbered(df.repartition(5), "key", "id").withColumnRenamed("position", "p")
    assert as_rows(ours.select("id", "p"), "id") == as_rows(plain.select("id", "p"), "id")


def test_one_key_spreads_over_tasks(spark):
    from tradeweave.plans.ordering import sliced

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sliced(spark.range(20_000).withColumn("key", F.lit(1)), "key", "id").groupBy("slice")
        counts = [r["count"] for r in sizes.count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 8 and max(counts) < 2 * 20_000 / 8


def test_running_sums_and_standing(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (2,), (2,), (2,)], "v int")
    standing = {r["v"]: tuple(r)[1:] for r in value_standing(df, "v", descending=True).collect()}
    assert standing == {3: (2, 0, 1), 2: (3, 2, 2), 1: (1, 5, 3)}
    unique = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "k int, w long")
    assert as_rows(running(unique, [F.desc("k")], {"before": "w"}), F.desc("k")) == [
        (5, 50, 0), (4, 40, 50), (3, 30, 90), (2, 20, 120), (1, 10, 140),
    ]


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = {g: rng.integers(0, 40, size).tolist() for g, size in (("a", 301), ("b", 2), ("c", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v int")
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    fractions = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    for row in grouped_quantiles(counts, ["g"], "v", "w", fractions).collect():
        expected = np.quantile(values[row["g"]], list(fractions.values()))
        assert [row[f] for f in fractions] == pytest.approx(expected.tolist())
        assert row["n"] == len(values[row["g"]])


@pytest.mark.parametrize("value", ["id % 4", "1", "id", "IF(id < 50, 7, id)", "IF(id % 5 = 0, NULL, id % 9)"])
@pytest.mark.parametrize("n", [0, 1, 200])
def test_standing_carries_ties_over_borders(spark, value, n):
    df = spark.range(n).selectExpr("id", f"CAST({value} AS long) AS v")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # equal values go on over several slices
    try:
        ours = standing(df.repartition(4), "v", "id")
        assert n < 200 or ours.select("position").count() == n
        found = as_rows(ours.select("id", "position", "n", "dense_rank", "running", "everything"), "id")
    finally:
        spark.conf.unset(setting)
    falling = Window.orderBy(F.desc("v"))
    plain = df.select(
        "id",
        F.row_number().over(Window.orderBy(F.desc("v"), "id")).alias("position"),
        F.lit(n).alias("n"),
        F.dense_rank().over(falling).alias("r"),
        F.coalesce(F.sum("v").over(falling), F.lit(0)).alias("s"),
        F.sum("v").over(Window.partitionBy()).alias("e"),
    )
    assert found == as_rows(plain, "id")
