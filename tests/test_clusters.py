"""K-means on planted clusters, where the answer is known."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tradeweave import labels as L
from tradeweave import registry
from tradeweave.operators import clusters
from tradeweave.plans import kmeans
from tradeweave.plans.star import Star
from tradeweave.schemas import STAR


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    rows = []
    for group, (r, f, m) in enumerate(((5, 20, 9000), (100, 5, 800), (900, 1, 50))):
        for i in range(40):
            jitter = 1 + rng.uniform(-0.05, 0.05)
            rows.append((f"{group}-{i}", int(r * jitter), f, round(m * jitter, 2)))
    schema = "customer_unique_id string, recency int, frequency long, monetary double"
    base = spark.createDataFrame(rows, schema).withColumn(
        "monetary", F.col("monetary").cast("decimal(12,2)")
    )
    return clusters.scaled(base).persist()


@pytest.fixture(scope="module")
def clustered(planted):
    scores, model = clusters._scored(kmeans.weighted(planted, clusters.LOGS).persist(), [2, 3, 4], starts=3)
    assert model.k == 3 and [best for *_, best in scores] == [False, True, False]
    return clusters.named_clusters(kmeans.assigned(planted, clusters.LOGS, model.centers, "cluster")).persist()


def test_features_are_standard(planted):
    for m in clusters.MEASURES:
        mean, std = planted.agg(F.avg(f"{m}_log"), F.stddev_pop(f"{m}_log")).first()
        assert abs(mean) < 1e-9 and std == pytest.approx(1)


def test_constant_measure_scales_to_zero(spark):
    base = spark.createDataFrame(
        [("a", 1, 1, 5.0), ("b", 2, 1, 6.0)],
        "customer_unique_id string, recency int, frequency int, monetary double",
    )
    assert {r["frequency_log"] for r in clusters.scaled(base).collect()} == {0.0}


def test_planted_groups_and_names(clustered):
    groups = clustered.groupBy(
        F.substring_index("customer_unique_id", "-", 1).alias("g"), "segment"
    ).count()
    found = {r["g"]: (r["segment"], r["count"]) for r in groups.collect()}
    assert found == {str(i): (L.CLUSTER_SEGMENTS[i], 40) for i in range(3)}


def test_segment_reports(clustered):
    shares = clusters.segment_revenue_share(clustered).collect()
    assert [r["top"] for r in shares] == [True, False, False]
    assert sum(r["customer_pct"] for r in shares) == pytest.approx(100, abs=0.02)
    profile = {r["segment"]: r for r in clusters.segment_profile(clustered).collect()}
    best, worst = profile[L.CLUSTER_SEGMENTS[0]], profile[L.CLUSTER_SEGMENTS[2]]
    assert best["recency"] > 0.95 and worst["recency"] < 0.1 and best["frequency"] == 1.0
    boxes = {
        (r["measure"], r["segment"]): r for r in clusters.segment_box_stats(clustered).collect()
    }
    assert boxes[("frequency", L.CLUSTER_SEGMENTS[1])]["median"] == 5.0
    assert len(boxes) == 9
    assert clusters.cluster_summary(clustered).first()["customers"] == 40
    assert clusters.segment_points(clustered).filter("size = 610").count() == 40


def numbers(spark, n=2000):
    """Points in three heaps of different width, one in seven of them repeated."""
    draw = np.random.default_rng(3)
    heap = draw.integers(0, 3, n)
    at = np.array([[0, 0, 0], [4, 1, 0], [1, 5, 3]])[heap] + draw.normal(0, 1, (n, 3)) * (0.4 + 0.4 * heap[:, None])
    at[::7] = at[0]
    return at, spark.createDataFrame(at.tolist(), "x double, y double, z double").repartition(5)


def plain_silhouette(points, label):
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(label):
        mine = label == own
        others = [far[i, label == c].mean() for c in set(label.tolist()) - {own}]
        a, b = far[i, mine].sum() / max(1, mine.sum() - 1), min(others)
        scores.append((b - a) / max(a, b) if mine.sum() > 1 and max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


AXES = ("x", "y", "z")


def test_all_models_at_once(spark):
    """Costs no higher than those of a run per model, silhouettes as by comparing all pairs."""
    points, df = numbers(spark)
    distinct = kmeans.weighted(df, AXES).persist()
    assert distinct.count() == len({tuple(p) for p in points.tolist()}) < len(points)
    jobs = [(k, seed) for k in (2, 3, 4) for seed in range(10)]
    models = kmeans.fit_all(distinct, AXES, jobs)
    assert [(m.k, m.seed) for m in models] == jobs
    best = [min((m for m in models if m.k == k), key=lambda m: m.cost) for k in (2, 3, 4)]
    vectors = VectorAssembler(inputCols=list(AXES), outputCol="features").transform(df).persist()
    for m in best:
        label = ((points[:, None] - m.centers) ** 2).sum(axis=2).argmin(axis=1)
        assert m.cost == pytest.approx(((points - m.centers[label]) ** 2).sum())
        single = [KMeans(k=m.k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(3)]
        assert m.cost <= min(single) * (1 + 1e-5)
        found = {tuple(r[c] for c in AXES): r["c"] for r in kmeans.assigned(df, AXES, m.centers, "c").collect()}
        assert [found[tuple(p)] for p in points.tolist()] == label.tolist()
    widths = kmeans.silhouettes(distinct, AXES, best)
    for m, width in zip(best, widths):
        label = ((points[:, None] - m.centers) ** 2).sum(axis=2).argmin(axis=1)
        assert width == pytest.approx(plain_silhouette(points, label), abs=1e-9)
    again = kmeans.fit_all(distinct.repartition(3), AXES, jobs[:2])
    assert [m.cost for m in again] == pytest.approx([m.cost for m in models[:2]])


def test_silhouettes_of_blocks_far_apart(spark, monkeypatch):
    """The sums over blocks far apart are those over all pairs, from a small part of the distances."""
    draw = np.random.default_rng(11)
    middles, heap = draw.uniform(-40, 40, (12, 3)), draw.integers(0, 12, 6000)
    points = middles[heap] + draw.normal(0, 0.3, (6000, 3))
    points[:, 1] = np.round(points[:, 1])  # an axis of few values, and one cluster of a single point
    points[0], heap[0] = 500.0, 12
    distinct = kmeans.weighted(spark.createDataFrame(points.tolist(), "x double, y double, z double"), AXES).persist()
    monkeypatch.setattr(kmeans, "BLOCK", 400)
    far, apart = kmeans._far, []
    models = [kmeans.Model(k, 0, np.vstack([middles[: k - 1], points[0]])) for k in (4, 9)]
    for m, found in zip(models, kmeans.silhouettes(distinct, AXES, models)):
        label = ((points[:, None] - m.centers) ** 2).sum(axis=2).argmin(axis=1)
        assert found == pytest.approx(plain_silhouette(points, label), abs=1e-10)
    monkeypatch.setattr(kmeans, "_far", lambda x, y, share, out: apart.append(len(x) * len(y)) or far(x, y, share, out))
    blocks = [points[heap == h] for h in range(13)]
    group = kmeans._Group(blocks, 1)
    for y in blocks:
        group.add(y, np.ones((len(y), 1)))
    found, exact = group.whole()[:, 0], np.zeros((6000, 1))
    far(np.concatenate(blocks), points, np.ones((6000, 1)), exact)
    assert found == pytest.approx(exact[:, 0], rel=1e-10) and sum(apart) < 6000**2 / 2


def test_a_job_a_turn(spark, monkeypatch):
    """However many models there are."""
    _, df = numbers(spark, 300)
    distinct = kmeans.weighted(df, AXES).persist()
    asked = []
    plain = kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda p, c, models: asked.append(len(models)) or plain(p, c, models))
    kmeans.fit_all(distinct, AXES, [(k, s) for k in range(2, 6) for s in range(3)])
    assert asked[0] == 12 and sorted(asked, reverse=True) == asked and len(asked) < 100


def test_nearest_centres():
    """As by all distances, the first of equal ones."""
    draw = np.random.default_rng(3)
    x, centers = draw.integers(-3, 4, (500, 3)).astype(float), draw.integers(-3, 4, (7, 3)).astype(float)
    squares = kmeans._squares(x, centers)
    label, nearest = kmeans._nearest(x, centers)
    assert (label == squares.argmin(axis=1)).all() and (nearest == squares.min(axis=1)).all()


def test_sums_by_kinds():
    """Sums of distances by a few kinds of points, spread over the clusters, are those by clusters."""
    draw = np.random.default_rng(4)
    x, far, y = draw.normal(0, 1, (300, 3)), draw.normal(90, 1, (300, 3)), draw.normal(0, 1, (900, 3))
    kind, spread = draw.integers(0, 3, 900), np.repeat(np.eye(3), 4, axis=1)
    share = np.eye(3)[kind] * draw.integers(1, 5, (900, 1))
    one, other = kmeans._Group([x, far], 12), kmeans._Group([x, far], 12)
    one.add(y, share, spread)
    other.add(y, share @ spread)
    assert one.grids and one.whole() == pytest.approx(other.whole(), rel=1e-12)


def test_points_of_the_search_are_dealt_evenly(spark, monkeypatch):
    """However few they are, all cores take part in each turn."""
    people = spark.range(4000).selectExpr(
        "cast(id AS string) AS customer_unique_id", "cast(id AS int) AS recency", "id % 7 AS frequency", "cast(id + 1 AS decimal(12,2)) AS monetary"
    )
    dealt = []

    def noted(points, ks, starts):
        dealt.append([r["n"] for r in points.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return [], None

    monkeypatch.setattr(clusters, "rfm_base", lambda star: people)
    monkeypatch.setattr(clusters, "_scored", noted)
    clusters.search(Star({t: lambda df=spark.createDataFrame([], s): df for t, s in STAR.items()}))
    cores = spark.sparkContext.defaultParallelism
    assert len(dealt[0]) == cores and sum(dealt[0]) == 4000 and max(dealt[0]) < 2 * 4000 / cores


def test_few_points(spark):
    kinds = "x double, y double, z double"
    nothing = kmeans.weighted(spark.createDataFrame([], kinds), AXES)
    assert kmeans.fit_all(nothing, AXES, [(2, 1)]) == [] and kmeans.silhouettes(nothing, AXES, []) == []
    for rows, centers, width in (([(1.0, 2.0, 3.0)] * 5, 1, None), ([(0.0, 0.0, 0.0)] * 3 + [(1.0, 0.0, 0.0)], 2, 0.75)):
        points = kmeans.weighted(spark.createDataFrame(rows, kinds), AXES)
        (model,) = kmeans.fit_all(points, AXES, [(4, 7)])
        assert len(model.centers) == centers and model.cost == 0
        assert kmeans.silhouettes(points, AXES, [model]) == [width]


def test_nobody_and_one_kind_of_person(spark):
    empty = Star({t: lambda df=spark.createDataFrame([], s): df for t, s in STAR.items()})
    scores, people = clusters.search(empty)
    assert scores.collect() == [] and people.collect() == []
    for report in registry.CLUSTER_REPORTS:
        assert report(people).collect() == [], report.__name__
    one = spark.createDataFrame(
        [(str(i), 5, 2, 10.0, 0) for i in range(4)],
        "customer_unique_id string, recency int, frequency long, monetary double, cluster int",
    )
    same = clusters.named_clusters(one.withColumn("monetary", F.col("monetary").cast("decimal(12,2)")))
    counts = {r.__name__: r(same).count() for r in registry.CLUSTER_REPORTS}
    assert counts == {
        "cluster_summary": 1, "segment_profile": 1, "segment_revenue_share": 1, "segment_box_stats": 3, "segment_points": 4
    }


STORED = {
    "cluster_summary": """SELECT cluster, segment, avg(recency) AS recency, avg(frequency) AS frequency,
        avg(CAST(monetary AS DOUBLE)) AS monetary, count(*) AS customers FROM c GROUP BY ALL""",
    "segment_profile": """SELECT segment, avg(1 - (recency - a) / (b - a)) AS recency,
        avg((frequency - d) / (e - d)) AS frequency, avg((CAST(monetary AS DOUBLE) - f) / (g - f)) AS monetary
        FROM c, (SELECT min(recency)::DOUBLE AS a, max(recency)::DOUBLE AS b, min(frequency)::DOUBLE AS d,
        max(frequency)::DOUBLE AS e, min(monetary)::DOUBLE AS f, max(monetary)::DOUBLE AS g FROM c) GROUP BY segment""",
    "segment_revenue_share": """SELECT segment, sum(monetary)::DOUBLE AS revenue, count(*) AS customers,
        round(100 * sum(monetary)::DOUBLE / sum(sum(monetary)) OVER ()::DOUBLE, 2) AS revenue_pct,
        round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS customer_pct,
        (row_number() OVER (ORDER BY sum(monetary) DESC, segment) = 1)::BIGINT AS top FROM c GROUP BY segment""",
    "segment_points": "SELECT customer_unique_id, segment, recency, monetary::DOUBLE AS monetary, frequency * 30 + 10 AS size FROM c",
    "segment_box_stats": """SELECT segment, measure, quantile_cont(value, 0.25) AS q1, median(value) AS median,
        quantile_cont(value, 0.75) AS q3 FROM (
        SELECT segment, unnest(['recency', 'frequency', 'monetary']) AS measure,
        unnest([recency::DOUBLE, frequency::DOUBLE, monetary::DOUBLE]) AS value FROM c) GROUP BY ALL""",
}


def test_reports_against_duckdb_over_the_stored_assignment(spark):
    """The search of the sample, as stored in the catalog, and each report of it."""
    folder = "/root/testdata/sf0.001"
    queries = registry.all_queries()
    scores = queries["kmeans_k_search"](spark, folder).collect()
    assert [r["k"] for r in scores] == list(clusters.K_RANGE) and sum(r["best"] for r in scores) == 1
    assert max(scores, key=lambda r: r["silhouette"])["best"] == 1
    inertias = [r["inertia"] for r in scores]
    assert inertias == sorted(inertias, reverse=True)
    c = registry._search(spark, folder)[1].toPandas()  # noqa: F841  read by the statements
    con = duckdb.connect()
    for name, sql in STORED.items():
        theirs = con.execute(sql).fetch_df()
        ours = queries[name](spark, folder).toPandas()[list(theirs.columns)]
        for df in (ours, theirs):
            for column in df.columns:
                if df[column].dtype.kind in "if":
                    df[column] = df[column].astype(float)
        by = [x for x in theirs.columns if theirs[x].dtype.kind not in "f"] or list(theirs.columns)
        a, b = (df.sort_values(by).reset_index(drop=True) for df in (ours, theirs))
        assert len(a) == len(b), name
        for column in theirs.columns:
            if theirs[column].dtype.kind == "f":
                assert a[column].to_numpy() == pytest.approx(b[column].to_numpy(), abs=1.1e-2 if column.endswith("pct") else 1e-6), (name, column)
            else:
                assert a[column].tolist() == b[column].tolist(), (name, column)
