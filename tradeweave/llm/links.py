"""Connected components of links too many for one machine.

Alternating large and small stars (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): each round hangs every node's neighbours on the smallest of them, so that chains
halve and a component ends as one star around its smallest node. A hub's neighbours are never
gathered: the smallest neighbour is an aggregate, and neighbours meet it in a join.

Cases: links from a node to itself and repeated links add nothing; a link with a null end is
left out; without links the result is empty.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.plans.ordering import durable

ROUNDS = 100  # chains halve in each; reaching this is an error


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # a is the larger end
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    lower = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return lower.unionByName(own).where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    ends = F.xxhash64("a", "b")
    return tuple(
        links.agg(F.count(F.lit(1)), F.bit_xor(ends), F.bit_xor(F.xxhash64(ends))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node of the component."""
    now = durable(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(ROUNDS):
        now = durable(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.unionByName(roots)
    raise RuntimeError(f"the components still changed after {ROUNDS} rounds")
