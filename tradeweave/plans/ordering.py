"""Ranking of tables too large for one task.

A window without a partition key sorts everything in a single task.  Here Spark range-
partitions and sorts the rows, each row notes its partition and its place in it, and
that result is checkpointed so the partition numbers are fixed.  Positions then follow
by adding the sizes of the earlier partitions, a table with one row per partition.

Orders must be unique (end with an id): a key shared by a third of all rows is then
spread over partitions like any other.
"""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in the partition


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, setting one only for local masters."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="tradeweave-")
        context.setCheckpointDir(shared)
    return shared or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute once, cut the lineage and survive lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, *parts: str) -> DataFrame:
    """Like ``durable``, but as a Parquet table, by the columns ``parts`` if any: Spark knows its size,
    so it broadcasts what proves to be small and shuffles the rest."""
    folder = f"{checkpoint_folder(df.sparkSession)}/sized-{uuid.uuid4()}"
    df.write.partitionBy(*parts).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sliced(df: DataFrame, *order: Column | str) -> DataFrame:
    """Globally sorted rows with ``slice`` and ``slice_row`` marking their place."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    return durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("slice"), place.alias("slice_row"))
    )


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``position`` (from 1) in the given unique order and the row count ``n``."""
    slices = sliced(df, *order)
    sizes = slices.groupBy("slice").agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy()
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "slice",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"),
        F.sum("size").over(every).alias("n"),
    )
    # one row per range partition, so at most spark.sql.shuffle.partitions rows
    return (
        slices.join(F.broadcast(starts), "slice")
        .withColumn("position", F.col("start") + F.col("slice_row") + 1)
        .drop("slice", "slice_row", "start")
    )


def counted(df: DataFrame, name: str) -> DataFrame:
    """Numbers the rows from 1 in no particular order, without sorting or shuffling them.

    The rows are stored as they lie; a row's number is its place in its partition after the sizes
    of the earlier partitions.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    held = durable(df.select("*", F.spark_partition_id().alias("__slice"), place.alias("__place")))
    sizes = held.groupBy("__slice").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__start"))
    # one row per partition
    return (
        held.join(F.broadcast(starts), "__slice")
        .withColumn(name, F.col("__start") + F.col("__place") + 1)
        .select(*df.columns, name)
    )


def ntile_at(position: Column, n: Column, tiles: int) -> Column:
    """NTILE bucket of a 1-based position among ``n``: the first buckets take the spare rows."""
    size = F.floor(n / tiles)
    spare = n % tiles
    in_large = spare * (size + 1)
    rest = spare + F.ceil((position - in_large) / F.greatest(size, F.lit(1)))
    return (
        F.when(position <= in_large, F.ceil(position / (size + 1))).otherwise(rest).cast("int")
    )


def tiled(df: DataFrame, name: str, tiles: int, *order: Column | str) -> DataFrame:
    """NTILE(tiles) over the whole table in a unique order."""
    ranked = numbered(df, *order)
    return ranked.withColumn(name, ntile_at(F.col("position"), F.col("n"), tiles)).drop(
        "position", "n"
    )


def tiled_each(df: DataFrame, ident: str, tiles: int, orders: dict[str, Column]) -> DataFrame:
    """Several NTILEs of the same rows from one global order.

    ``orders`` maps each new column to the number it sorts by, ascending, ties by ``ident``.
    Every row enters the order once per number; its tiles are then gathered by key.
    """
    marks = [
        F.struct(F.lit(i).alias("which"), key.cast("decimal(38,2)").alias("key"))
        for i, key in enumerate(orders.values())
    ]
    long = df.select("*", F.explode(F.array(*marks)).alias("mark"))
    ranked = numbered(long.select(*df.columns, "mark.*"), "which", "key", ident)
    n = F.call_function("div", F.col("n"), F.lit(len(orders)))
    tile = ntile_at(F.col("position") - F.col("which") * n, n, tiles)
    gathered = ranked.select(*df.columns, "which", tile.alias("tile")).groupBy(*df.columns)
    return gathered.agg(
        *[F.max(F.when(F.col("which") == i, F.col("tile"))).alias(name) for i, name in enumerate(orders)]
    )


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``new -> column``, the sum of ``column`` over all earlier rows."""
    slices = sliced(df, *order)
    totals = slices.groupBy("slice").agg(
        *[F.sum(source).alias(f"{new}_slice") for new, source in sums.items()]
    )
    before_slice = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "slice",
        *[
            F.coalesce(F.sum(f"{new}_slice").over(before_slice), F.lit(0)).alias(f"{new}_start")
            for new in sums
        ],
    )
    before_row = (
        Window.partitionBy("slice").orderBy("slice_row").rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per range partition, as in numbered()
    placed = slices.join(F.broadcast(starts), "slice")
    return placed.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(source).over(before_row), F.lit(0)) + F.col(f"{new}_start")).alias(new)
            for new, source in sums.items()
        ],
    )


def value_standing(
    df: DataFrame, key: str, *, descending: bool = False, weight: str | None = None
) -> DataFrame:
    """One row per distinct value: its rows (or the sum of ``weight``), dense rank, and the
    rows (or weight) before it.

    Ties share a value, so RANGE running sums, DENSE_RANK and average ranks all follow
    from this table, which holds no ties and is joined back on the value.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    values = df.groupBy(key).agg(size.alias("rows"), F.lit(1).alias("one"))
    order = F.col(key).desc() if descending else F.col(key).asc()
    return running(values, [order], {"rows_before": "rows", "values_before": "one"}).select(
        key, "rows", "rows_before", (F.col("values_before") + 1).alias("dense_rank")
    )


def standing(df: DataFrame, value: str, ident: str) -> DataFrame:
    """From one global order, by falling ``value`` and then ``ident``: adds ``position`` and ``n``, and
    over equal values alike ``dense_rank`` and ``running`` (the sum of this and all larger values), and
    ``everything``, the sum of all.

    Each slice works out what lies in it; a table of a row per slice carries sums, distinct values
    and the rows of a value that goes on in later slices over the borders, so ties need no join.
    """
    falling = Window.partitionBy("slice").orderBy(F.desc(value))
    rows = sliced(df, F.desc(value), F.asc(ident)).select(
        "*", F.sum(value).over(falling).alias("within"), F.dense_rank().over(falling).alias("rank_within")
    )
    slices = rows.groupBy("slice").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(value).alias("held"),
        F.max("rank_within").alias("distinct"),
        F.count_if(F.col("rank_within") == 1).alias("heading"),
        F.min_by(value, "slice_row").alias("first"),
        F.max_by(value, "slice_row").alias("last"),
    )
    in_order = Window.orderBy("slice")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    goes_on = (F.lag("size").over(in_order).isNotNull() & F.lag("last").over(in_order).eqNullSafe(F.col("first"))).cast("int")
    slices = slices.withColumn("goes_on", goes_on)
    alike = Window.partitionBy("first")
    # a value that a slice ends with heads the later slices that it goes on in
    heads = slices.groupBy(F.col("first").alias("head")).agg(F.sum("heading").alias("heads"))
    carried = slices.select(
        "slice",
        "first",
        "last",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("size").over(every).alias("n"),
        F.sum("held").over(earlier).alias("sum_before"),
        F.sum("held").over(every).alias("everything"),
        (F.coalesce(F.sum("distinct").over(earlier), F.lit(0)) - F.sum("goes_on").over(so_far)).alias("ranks_before"),
        F.sum("heading").over(alike.orderBy("slice")).alias("headed"),
    )
    carried = carried.join(heads, carried["last"].eqNullSafe(heads["head"]), "left").withColumn(
        "later",
        F.coalesce("heads", F.lit(0)) - F.when(F.col("first").eqNullSafe(F.col("last")), F.col("headed")).otherwise(0),
    )
    # one row per range partition, as in numbered()
    joined = rows.join(F.broadcast(carried.drop("first", "headed", "heads", "head")), "slice")
    peers = F.when(F.col(value) == F.col("last"), F.col("later") * F.col(value))
    running_sum = F.coalesce("sum_before", F.lit(0)) + F.coalesce("within", F.lit(0)) + F.coalesce(peers, F.lit(0))
    return joined.select(
        *df.columns,
        (F.col("rows_before") + F.col("slice_row") + 1).alias("position"),
        "n",
        (F.col("ranks_before") + F.col("rank_within")).alias("dense_rank"),
        running_sum.alias("running"),
        "everything",
    )
