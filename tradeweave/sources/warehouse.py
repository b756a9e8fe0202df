"""The stored star: Parquet folders under one commit, or bucketed catalog tables."""

from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tradeweave.operators.cleaning import conform
from tradeweave.operators.quality import with_surrogate_key
from tradeweave.plans.star import Star
from tradeweave.schemas import STAR, SURROGATE_KEYS
from tradeweave.sources import commits

CLUSTERS = "rfm_clusters"
BUCKETS = 32

Figures = dict[str, dict[str, int]]


def observed(df: DataFrame, wanted: Mapping[str, Column]) -> tuple[DataFrame, Callable[[], dict]]:
    """The frame, and a function that gives the wanted aggregates once an action has run over it."""
    seen = Observation()

    def figures() -> dict:
        try:
            return seen.get
        except Py4JJavaError:  # Spark has no figures if it knew beforehand that there are no rows
            return {name: 0 if name == "rows" else None for name in wanted}

    return df.observe(seen, *[value.alias(name) for name, value in wanted.items()]), figures


def write_star(
    star: Mapping[str, DataFrame],
    folder: str,
    *,
    mode: str = "overwrite",
    number_rows: bool = False,
    load: str | None = None,
    watched: Mapping[str, Mapping[str, Column]] | None = None,
) -> Figures:
    """Stores the eight tables with their fixed columns under one commit, and returns per table the
    ``rows`` written and any ``watched`` aggregates, all observed while writing.

    Readers see all eight tables of a load or none. ``overwrite`` replaces the star, ``append`` adds to
    it; a ``load`` of a name that the star holds already is not repeated (and returns nothing). Facts
    are dealt by ``order_id`` and sorted by it within files, so rows of an order lie together and a
    filter on orders skips most row groups. ``number_rows`` adds ``item_id`` and ``payment_id``, only
    needed by readers that want a single-column key.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    spark = next(iter(star.values())).sparkSession
    before = commits.latest(spark, folder) or commits.Commit()
    if load is not None and mode == "append" and load in before.loads:
        return {}
    version, found = commits.new_version(), {}
    for table in STAR:
        rows = conform(star[table], table)
        if number_rows and table in SURROGATE_KEYS:
            rows = with_surrogate_key(rows, table)
        wanted = {"rows": F.count(F.lit(1)), **(watched or {}).get(table, {})}
        rows, seen = observed(rows, wanted)
        if "order_id" in rows.columns:
            rows = rows.repartition("order_id").sortWithinPartitions("order_id")
        rows.write.parquet(commits.path_of(folder, table, version))
        found[table] = seen()
    commits.publish(spark, folder, before.with_version(STAR, version, keep=mode == "append", load=load))
    return found


def read_star(spark: SparkSession, folder: str) -> Star:
    """The star of the latest commit; reports then skip cleaning and filters reach the Parquet scan."""
    commit = commits.latest(spark, folder)
    if commit is None:
        raise FileNotFoundError(f"no star has been committed to {folder}")

    def loader(table: str):
        paths = [commits.path_of(folder, table, v) for v in commit.versions[table]]
        return lambda: spark.read.schema(STAR[table]).parquet(*paths)

    return Star({table: loader(table) for table in STAR})


def save_star(star: Mapping[str, DataFrame], prefix: str, folder: str | None = None, buckets: int = BUCKETS) -> None:
    """Replaces the star's catalog tables ``<prefix><table>``; facts are bucketed and sorted by
    ``order_id``, so joins and sums by order read them without a shuffle."""
    for table in STAR:
        rows = conform(star[table], table)
        if "order_id" in rows.columns:
            writer = rows.repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").sortBy("order_id")
        else:
            writer = rows.write
        if folder is not None:
            writer = writer.option("path", f"{folder}/{table}")
        writer.mode("overwrite").saveAsTable(f"{prefix}{table}")


def catalog_star(spark: SparkSession, prefix: str) -> Star:
    """The star of ``save_star``."""
    return Star({table: lambda t=table: spark.table(f"{prefix}{t}") for table in STAR}, dealt=True)


def save_table(df: DataFrame, name: str, folder: str | None = None) -> None:
    """Replaces a catalog table, in the catalog's own place or in ``folder``."""
    writer = df.write.mode("overwrite")
    (writer if folder is None else writer.option("path", folder)).saveAsTable(name)


CLUSTER_COLUMNS = ("customer_unique_id", "recency", "frequency", "monetary", "cluster", "segment")


def save_clusters(scores: DataFrame, clustered: DataFrame, name: str = CLUSTERS, folder: str | None = None) -> None:
    """Replaces the catalog tables of a search: the assignment, and ``<name>_scores``."""
    save_table(scores, f"{name}_scores", folder and f"{folder}/scores")
    save_table(clustered.select(*CLUSTER_COLUMNS), name, folder and f"{folder}/{CLUSTERS}")


def export_clusters(clustered: DataFrame, folder: str) -> None:
    """Replaces the stored cluster assignment."""
    clustered.select(*CLUSTER_COLUMNS).write.mode("overwrite").parquet(f"{folder}/{CLUSTERS}")


def read_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{CLUSTERS}")
