"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone: no ring, no table. With one
shard more, a row either stays or moves to the new shard, so only 1/(n+1) of the rows move
(Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014).

Everything is built-in columns. The generator of the paper multiplies modulo 2^64; Spark's
multiplication raises on overflow under ANSI rules, so it is done in limbs of 22 bits.

Cases: a null key is hashed as 0; keys that are not whole numbers are hashed with XXH64 first;
a null text has size 8 and the CRC-32 of nothing (0); rows repeated in every column share a
shard and get slots of their own; an empty table gives an empty result; columns other than the
key and the text are not read, so their names cannot clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeweave.plans.ordering import numbered

MULTIPLIER = 2862933555777941757  # fixed by the paper
LIMB = 22
LOW = (1 << LIMB) - 1
ROW_OVERHEAD = 8  # bytes counted for each row besides its text


def _next(state: Column) -> Column:
    """state * MULTIPLIER + 1 modulo 2^64."""
    m0, m1, m2 = (F.lit((MULTIPLIER >> (LIMB * i)) & LOW) for i in range(3))
    s0 = state.bitwiseAND(F.lit(LOW))
    s1 = F.shiftrightunsigned(state, LIMB).bitwiseAND(F.lit(LOW))
    s2 = F.shiftrightunsigned(state, 2 * LIMB)
    low = s0 * m0 + F.lit(1)
    middle = s1 * m0 + s0 * m1 + F.shiftright(low, LIMB)
    high = s2 * m0 + s1 * m1 + s0 * m2 + F.shiftright(middle, LIMB)
    return (
        F.shiftleft(high.bitwiseAND(F.lit((1 << 20) - 1)), 2 * LIMB)
        .bitwiseOR(F.shiftleft(middle.bitwiseAND(F.lit(LOW)), LIMB))
        .bitwiseOR(low.bitwiseAND(F.lit(LOW)))
    )


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown_shard) of a long key: its shard of ``shards`` and of one more.

    The jumps for both counts are the same until they pass ``shards``, so one walk gives both.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    start = F.struct(
        _next(key).alias("state"),
        F.lit(0).cast("long").alias("jump"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def step(at: Column, _: Column) -> Column:
        jump = at["jump"]
        draw = F.shiftrightunsigned(at["state"], 33) + F.lit(1)
        return F.when(jump > shards, at).otherwise(
            F.struct(
                _next(at["state"]).alias("state"),
                F.floor((jump + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).alias("jump"),
                F.when(jump < shards, jump).otherwise(at["shard"]).alias("shard"),
                jump.alias("grown"),
            )
        )

    # every jump goes up by one at least, so shards + 1 of them are enough
    walk = F.sequence(F.lit(0), F.lit(shards))
    return F.aggregate(
        walk,
        start,
        step,
        lambda at: F.struct(
            at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown_shard")
        ),
    )


def _long_key(df: DataFrame, key: str) -> Column:
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    column = F.col(f"`{key}`")
    return F.coalesce(column.cast("long") if whole else F.xxhash64(column), F.lit(0).cast("long"))


def assign(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """All rows and columns with ``shard`` and ``grown_shard``, in place of columns so named.

    No shuffle: a projection of the scan.
    """
    return df.withColumn("_jump", jump_shards(_long_key(df, key), shards)).withColumns(
        {"shard": F.col("_jump.shard"), "grown_shard": F.col("_jump.grown_shard")}
    ).drop("_jump")


def place(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, size, text_crc32, law, shard, slot, grown_shard.

    Slots number each shard's rows from 0 in the order of the key. Only (key, size, crc, shard)
    are sorted, by range over all partitions, so neither a large shard nor a repeated key ends
    in one task; the rows of a shard are then counted from the place of its first row.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias(key),
        (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shards(_long_key(docs, key), shards).alias("jump"),
    ).select(key, "size", "text_crc32", "jump.shard", "jump.grown_shard")
    ordered = numbered(rows, "shard", key, "text_crc32", "size")
    counts = ordered.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard
    starts = counts.select("shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    return ordered.join(F.broadcast(starts), "shard").select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("position") - F.lit(1) - F.col("start")).cast("long").alias("slot"),
        "grown_shard",
    )
