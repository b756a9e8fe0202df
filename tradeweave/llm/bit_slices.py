"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to whole numbers. The index holds blocks of vectors; in a block each
dimension is a few bitmaps, one for each binary digit of its values (shifted to start at 0), with a
bit for each vector. A query's scores for a whole block are sums of those bitmaps: a slice that
counts 2^i, times a power of two in the query's weight, is added by bitwise full adders, so the
total too is a stack of slices. The best k are then taken from the most significant slice down:
vectors with the bit set are ahead of those without, and where the k-th falls among equals, the
rest of the places go to the smallest ids (after O'Neil and Quass, "Improved Query Performance
with Variant Indexes", 1997).

Rows are numbered, and blocks are runs of numbers. A block is sliced once, in the task that holds it,
and the chunks of queries stream past it; so vectors are moved once, and what grows with blocks
and queries is only the queries' share of the shuffle. With few blocks, each is held by several tasks
that share the queries. The best k of each block are merged by a window per query.

Cases: vectors that are null, or hold nulls or numbers that are not finite, take no part; a vector
of another length than most raises an error, and so does a component that leaves 64 bits; a query is
not compared with its own row; with fewer candidates than k all are returned; equal scores go to
smaller ids; rows that repeat an id are queries and candidates each; rows with a null id are left
out; an empty table gives an empty result; columns other than the id and the vector are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.plans.ordering import counted

BLOCK_ROWS = 8192
CHUNK_QUERIES = 128


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null unless all components are finite numbers."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.when(
        vector.isNotNull() & whole,
        F.transform(numbers, lambda x: F.floor(x * F.lit(float(scale))).cast("long")),
    )


# --- bitmaps: arrays of 64-bit words, a bit per vector, the first vector in the lowest bit


def _bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of flags (..., vectors) as rows of words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    if spare:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], spare), np.uint8)], axis=-1)
    return packed.view(np.uint64)


class Block:
    """The bit-sliced index of some vectors: ``slices[d]`` are the digits of dimension d."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, numbers: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values, self.numbers = ids[order], values[order], numbers[order]
        low = self.values.min(axis=0)
        shifted = (self.values - low).astype(np.uint64).T  # digits need whole positive numbers
        self.peak = [(1 << int(x).bit_length()) - 1 for x in shifted.max(axis=1)]
        self.everyone = _bitmaps(np.ones(len(ids), np.uint8))
        places = [(d, i) for d, x in enumerate(self.peak) for i in range(x.bit_length())]
        self.dimension, self.digit = np.array(places, np.int64).reshape(-1, 2).T
        plain = [_bitmaps((shifted[d] >> np.uint64(i)) & np.uint64(1)) for d, i in places]
        plain = np.array(plain, np.uint64).reshape(-1, len(self.everyone))
        self.slices = np.concatenate([plain, ~plain & self.everyone])  # and their complements

    def totals(self, query: np.ndarray) -> np.ndarray:
        """Slices of each vector's score, lowest digit first, up to a number that all share.

        A negative weight, made positive, multiplies peak - x instead of x; the digits of that
        are the complements of x's. All bitmaps that count the same power of two are added three
        at a time: a sum that stays and a carry for the next power.
        """
        weight = np.abs(query)
        depth = max(1, int((weight * np.array(self.peak)).sum()).bit_length())
        bits = np.arange(max(1, int(weight.max(initial=0)).bit_length()))
        bit, row = np.nonzero((weight[self.dimension][None, :] >> bits[:, None]) & 1)
        power = bit + self.digit[row]
        row = row + np.where(query[self.dimension[row]] < 0, len(self.digit), 0)
        total = np.zeros((depth, len(self.everyone)), np.uint64)
        carried: list[np.ndarray] = []
        for i in range(depth):
            waiting = np.concatenate([self.slices[row[power == i]], *carried])
            carried = []
            while len(waiting) > 2:
                n = len(waiting) // 3
                a, b, c = waiting[:n], waiting[n : 2 * n], waiting[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                waiting = np.concatenate([half ^ c, waiting[3 * n :]])
            if len(waiting) == 2:
                carried.append(waiting[:1] & waiting[1:])
                waiting = waiting[:1] ^ waiting[1:]
            if len(waiting):
                total[i] = waiting[0]
        return total

    def best(self, total: np.ndarray, own: int, k: int) -> np.ndarray:
        """The rows of the k best vectors, the query's own row left out."""
        left = self.everyone.copy()
        for row in np.flatnonzero(self.numbers == own).tolist():
            left[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure, missing = np.zeros_like(left), k
        for digit in total[::-1]:
            ahead = left & digit
            count = int(np.bitwise_count(ahead).sum())
            if count > missing:
                left = ahead
            else:  # all of these are in, and the other places go to those without the bit
                sure |= ahead
                missing -= count
                left &= ~digit
                if not missing:
                    break
        return np.concatenate([_rows(sure), _rows(left)[:missing]])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


# --- the search


def _packed(rows: DataFrame, group: str) -> DataFrame:
    """Vectors by group, as one row each: numbers, ids and values as bytes."""

    def run(table: pa.Table) -> pa.Table:
        ids, numbers = (table.column(c).to_numpy().astype("<i8") for c in ("id", "number"))
        vectors = table.column("vector").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        if len(set(sizes.tolist())) > 1:
            raise ValueError("the vectors differ in length")
        values = vectors.flatten().to_numpy()
        ends = (values.min(), values.max()) if len(values) else (0,)
        values = values.astype(np.result_type(np.int16, *map(np.min_scalar_type, ends)))
        return pa.table(
            {
                group: table.column(group).slice(0, 1),
                "numbers": pa.array([numbers.tobytes()], pa.binary()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "width": pa.array([int(sizes[0])], pa.int32()),
                "vectors": pa.array([values.tobytes()], pa.binary()),
            }
        )

    return rows.groupBy(group).applyInArrow(
        run, f"{group} long, numbers binary, ids binary, width int, vectors binary"
    )


def top_k(
    table: DataFrame, k: int, step: int, scale: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of the largest inner product with each
    query, the queries being the rows whose id is divisible by ``step``."""
    rows = counted(
        table.select(
            F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("vector")
        ).where("id IS NOT NULL AND vector IS NOT NULL"),
        "number",
    )
    asked = counted(rows.where(F.col("id") % step == 0), "place")
    blocks = rows.count() // BLOCK_ROWS + 1
    shares = max(1, 2 * table.sparkSession.sparkContext.defaultParallelism // blocks)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("long"))).alias("block")
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1).cast("long"))).alias("share")
    chunk = F.call_function("div", F.col("place"), F.lit(CHUNK_QUERIES)).cast("long")
    block = F.call_function("div", F.col("number"), F.lit(BLOCK_ROWS)).cast("long")
    what = ("numbers", "ids", "width", "vectors")
    stored = _packed(rows.withColumn("block", block), "block").select("block", every_share, F.lit(-1).cast("long").alias("chunk"), *what)
    visits = _packed(asked.withColumn("chunk", chunk), "chunk").select(every_block, F.col("chunk") % shares, "chunk", *what)
    streams = stored.union(visits).repartition("block", "share").sortWithinPartitions("block", "share", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: tuple[int, Block, int] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                numbers, ids, values = _unpacked(row)
                if row["chunk"] < 0:  # the block itself comes first
                    if built is None or built[0] != row["block"]:
                        built = row["block"], Block(ids, values, numbers), row["width"]
                elif built is not None and built[0] == row["block"]:  # else a block without rows
                    if row["width"] != built[2]:
                        raise ValueError("the vectors differ in length")
                    yield _scored(built[1], numbers, ids, values, k)

    found = streams.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, ids = np.frombuffer(row["numbers"], "<i8"), np.frombuffer(row["ids"], "<i8")
    width = row["width"]
    if not width:
        return numbers, ids, np.zeros((len(ids), 0), np.int64)
    kind = f"<i{len(row['vectors']) // (len(ids) * width)}"
    return numbers, ids, np.frombuffer(row["vectors"], kind).astype(np.int64).reshape(len(ids), width)


def _scored(block: Block, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    asked, own_ids, found, scores = [], [], [], []
    for number, own, query in zip(numbers.tolist(), ids.tolist(), queries, strict=True):
        rows = block.best(block.totals(query), number, k)
        asked.append(np.full(len(rows), number))
        own_ids.append(np.full(len(rows), own))
        found.append(block.ids[rows])
        scores.append(block.values[rows] @ query)
    columns = (np.concatenate(x).astype(np.int64) for x in (asked, own_ids, found, scores))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "vec_id", "score"])
