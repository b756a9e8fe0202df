"""Bloom filters of keys as ordinary tables, built and asked with Spark's bitmap functions.

A filter of ``bits`` bits is a table (bucket, bitmap) of 4 KB bitmaps, so it may be as large as the
keys need, is stored beside them, and several are united by ``or``. A key sets ``HASHES`` bits. A key
that finds one of its bits unset is certainly not among those put in; with ten bits a key about one
in 120 others passes.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 5
BITS = 1 << 27  # 16 MB: ten bits each for 13 million keys
LIKELY_BITS = 1 << 25  # 4 MB, which each executor holds whole
SCHEMA = "bucket long, bitmap binary"


def _positions(key: Column, bits: int) -> Column:
    """The bits of a key, from 1."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) + 1 for i in range(HASHES)])


def build(keys: DataFrame, bits: int = BITS) -> DataFrame:
    """The filter of the non-null keys in the one column of ``keys``."""
    key = F.col(keys.columns[0])
    set_bits = keys.where(key.isNotNull()).select(F.explode(_positions(key, bits)).alias("bit"))
    return set_bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap")
    )


def united(filters: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, filters)
    return every.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(place: Column) -> Column:
    """Whether the bit of the column ``bitmap`` is set."""
    byte = F.substring("bitmap", (place / 8).cast("int") + 1, F.lit(1))
    value, bit = F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")
    return F.call_function("shiftright", value, bit) % 2 == 1


def likely(rows: DataFrame, name: str, keys: DataFrame, bits: int = LIKELY_BITS) -> DataFrame:
    """The rows whose column ``name`` may be among ``keys``: all that are, and a few others, the more
    the more keys there are. The rows are not shuffled: the filter, of one bit a key and a
    size that does not grow, goes to every task. For what a join would then drop anyway."""
    held = F.pmod(F.xxhash64(name), F.lit(bits)) + 1
    set_bits = keys.select(held.alias("bit")).select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place")
    )
    built = set_bits.distinct().repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    asked = rows.withColumn("bucket", F.bitmap_bucket_number(held))
    found = asked.join(F.broadcast(built), "bucket").where(_is_set(F.bitmap_bit_position(held)))
    return found.select(*rows.columns)


def possible(keys: DataFrame, built: DataFrame, bits: int = BITS) -> DataFrame:
    """The distinct non-null keys that may be in the filter: all that are, and a few others."""
    name = keys.columns[0]
    asked = (
        keys.where(F.col(name).isNotNull())
        .distinct()
        .select(name, F.explode(_positions(F.col(name), bits)).alias("bit"))
        .select(name, F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    )
    found = asked.join(built, "bucket").where(_is_set(F.col("place")))
    return found.groupBy(name).agg(F.count(F.lit(1)).alias("bits")).where(F.col("bits") == HASHES).select(name)
