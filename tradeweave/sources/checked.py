"""Appending to a stored star under the keys of its tables: what breaks one is set aside.

A row is rejected when its primary key is null, repeated in the load or stored already, or when it
refers to a parent that is neither stored nor accepted with this load; tables come in the order of
their references, so what refers to a rejected row is rejected too. Only the first reason of a row is
given. Null references are allowed, and so are rows of tables without a key of their own.

The stored side is asked through Bloom filters of its keys (``plans.bloom``), which lie beside each
version: keys that the filter does not know are new without reading the table, and only the few others
are looked up in it. Filters of versions that were written without them are made on the first use.

Accepted rows become one version of the star, rejected ones lie beside it, and both count with the
one commit at the end.
"""

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.operators.cleaning import conform
from tradeweave.plans import bloom
from tradeweave.plans.ordering import durable
from tradeweave.schemas import FOREIGN_KEYS, PRIMARY_KEYS, STAR
from tradeweave.sources import commits

FILTERS, REJECTS = "_filters", "_rejects"
REFERRED = sorted({parent for _, _, parent in FOREIGN_KEYS} | {t for t, key in PRIMARY_KEYS.items() if key in STAR[t].names})
NULL_KEY, COPY, ORPHAN = "null key", "duplicate key", "no such "
REJECT_SCHEMA = "table string, reason string, key string, row string"


class _Stored:
    """The keys of a stored star, by table."""

    def __init__(self, spark: SparkSession, folder: str, commit: commits.Commit, bits: int):
        self.spark, self.folder, self.commit, self.bits = spark, folder, commit, bits

    def keys(self, table: str) -> DataFrame | None:
        paths = [commits.path_of(self.folder, table, v) for v in self.commit.versions.get(table, [])]
        if not paths:
            return None
        return self.spark.read.schema(STAR[table]).parquet(*paths).select(F.col(PRIMARY_KEYS[table]).alias("key"))

    def complete(self, table: str) -> None:
        """Makes the filters that versions of the table lack."""
        have = self.commit.filters.get(table, [])
        for version in self.commit.versions.get(table, []):
            if version not in have:
                rows = self.spark.read.schema(STAR[table]).parquet(commits.path_of(self.folder, table, version))
                write_filter(rows, self.folder, table, version, self.bits)
                have = [*have, version]
        self.commit = replace(self.commit, filters=self.commit.filters | {table: have})

    def among(self, keys: DataFrame, table: str) -> DataFrame | None:
        """Those of the distinct ``keys`` (key) that are stored; None if nothing is."""
        stored = self.keys(table)
        if stored is None:
            return None
        self.complete(table)
        paths = [commits.path_of(self.folder, f"{FILTERS}/{table}", v) for v in self.commit.filters[table]]
        known = bloom.united([self.spark.read.schema(bloom.SCHEMA).parquet(p) for p in paths])
        possible = durable(bloom.possible(keys, known, self.bits))
        if possible.isEmpty():
            return possible
        return stored.join(possible, "key", "left_semi").distinct()


def write_filter(rows: DataFrame, folder: str, table: str, version: str, bits: int) -> None:
    """Stores the filter of a version's keys; written again, it comes out the same."""
    keys = rows.select(F.col(PRIMARY_KEYS[table]).alias("key"))
    bloom.build(keys, bits).write.mode("overwrite").parquet(commits.path_of(folder, f"{FILTERS}/{table}", version))


def _marked(rows: DataFrame, table: str, stored: _Stored, accepted: Mapping[str, DataFrame]) -> DataFrame:
    """The rows with ``__reason``, null where nothing is wrong."""
    reasons = []
    key = PRIMARY_KEYS.get(table)
    if key in STAR[table].names:
        reasons.append(F.when(F.col(key).isNull(), NULL_KEY))
        first = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__arrival").alias("__first"))
        rows = rows.join(first, rows[key] == first["__key"], "left").drop("__key")
        reasons.append(F.when(F.col("__arrival") != F.col("__first"), COPY))
        known = stored.among(rows.select(F.col(key).alias("key")), table)
        if known is not None:
            rows = rows.join(known.select(F.col("key").alias("__stored")), F.col(key) == F.col("__stored"), "left")
            reasons.append(F.when(F.col("__stored").isNotNull(), COPY))
    for n, (child, column, parent) in enumerate(FOREIGN_KEYS):
        if child != table:
            continue
        fresh = accepted[parent].select(F.col(PRIMARY_KEYS[parent]).alias("key"))
        asked = rows.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
        orphans = asked.join(fresh, "key", "left_anti")
        known = stored.among(durable(orphans), parent)
        if known is not None:
            orphans = orphans.join(known, "key", "left_anti")
        rows = rows.join(orphans.select(F.col("key").alias(f"__orphan{n}")), F.col(column) == F.col(f"__orphan{n}"), "left")
        reasons.append(F.when(F.col(f"__orphan{n}").isNotNull(), f"{ORPHAN}{parent}"))
    return rows.select(*STAR[table].names, F.coalesce(*reasons, F.lit(None).cast("string")).alias("__reason"))


def append_checked(
    star: Mapping[str, DataFrame], folder: str, *, load: str | None = None, bits: int = bloom.BITS
) -> DataFrame:
    """Appends what keeps the keys to the star in ``folder`` and returns the rows that do not:
    (table, reason, key, row as JSON), which are stored too. A ``load`` that the star holds already adds
    nothing and returns nothing. ``bits`` must stay the same for a folder.
    """
    spark = next(iter(star.values())).sparkSession
    before = commits.latest(spark, folder) or commits.Commit()
    if load is not None and load in before.loads:
        return spark.createDataFrame([], REJECT_SCHEMA)
    stored, version, accepted = _Stored(spark, folder, before, bits), commits.new_version(), {}
    rejected = commits.path_of(folder, REJECTS, version)
    for table in STAR:
        arriving = durable(conform(star[table], table).withColumn("__arrival", F.monotonically_increasing_id()))
        marked = durable(_marked(arriving, table, stored, accepted))
        kept = marked.where("__reason IS NULL").drop("__reason")
        if "order_id" in kept.columns:
            kept = kept.repartition("order_id").sortWithinPartitions("order_id")
        kept.write.parquet(commits.path_of(folder, table, version))
        accepted[table] = spark.read.schema(STAR[table]).parquet(commits.path_of(folder, table, version))
        if table in REFERRED:
            write_filter(accepted[table], folder, table, version, bits)
        name = F.col(PRIMARY_KEYS[table]) if PRIMARY_KEYS.get(table) in STAR[table].names else F.lit(None).cast("string")
        marked.where("__reason IS NOT NULL").select(
            F.lit(table).alias("table"),
            F.col("__reason").alias("reason"),
            name.alias("key"),
            F.to_json(F.struct(*STAR[table].names)).alias("row"),
        ).write.mode("append").parquet(rejected)
    commit = stored.commit.with_version(STAR, version, keep=True, load=load)
    filters = commit.filters | {t: [*commit.filters.get(t, []), version] for t in REFERRED}
    commits.publish(spark, folder, replace(commit, filters=filters))
    return spark.read.schema(REJECT_SCHEMA).parquet(rejected)
