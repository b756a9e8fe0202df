"""Reading: raw CSV files, catalog tables, SQL text and JDBC."""

import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.plans.star import Tables
from tradeweave.schemas import RAW

log = logging.getLogger(__name__)


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path on whatever file system it names."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = system.globStatus(location)
    return found is not None and len(found) > 0


def load_csv(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One raw table from CSV with a header, or None with a warning when it is missing.

    Columns are matched by the header, types come from the known layout.  ``ingest_id``
    orders rows as they stand in the files: file, block, place in the block.
    """
    if not file_exists(spark, path):
        log.warning("raw table %s not found at %s", name, path)
        return None
    raw = (
        spark.read.schema(RAW[name])
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        # review texts hold line breaks; the other files stay splittable
        .option("multiLine", name == "reviews")
        .csv(path)
    )
    return raw.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
        ).alias("ingest_id"),
    )


def write_csv(raw: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Stores raw tables as CSV with headers, one folder each; returns their paths."""
    paths = {name: f"{folder}/{name}" for name in RAW}
    for name, path in paths.items():
        raw[name].select(*RAW[name].fieldNames()).write.option("header", True).option(
            "escape", '"'
        ).csv(path)
    return paths


def load_raw(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    """All nine raw tables; raises with every missing one named."""
    missing = [
        name for name in RAW if name not in paths or not file_exists(spark, paths[name])
    ]
    if missing:
        raise FileNotFoundError(f"missing raw tables: {', '.join(missing)}")
    return Tables({name: lambda n=name: load_csv(spark, paths[n], n) for name in RAW})


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_on: str,
    low: int,
    high: int,
    parts: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column at once."""
    return spark.read.jdbc(
        url,
        table,
        column=split_on,
        lowerBound=low,
        upperBound=high,
        numPartitions=parts,
        properties=dict(properties or {}),
    )
