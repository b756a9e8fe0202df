"""The highest-scoring documents of each item, by searching two trees at once.

A document is a vector of whole numbers, one per term: its impact, which grows with the term's
occurrences and falls with the document's length. An item is a vector of term weights. The score of
a pair is the product of the two vectors.

Both sides have a hierarchy. Documents are stored in blocks; a block's documents are ordered by their
heaviest terms and cut into leaves, and each node of the tree above holds, for every term, the largest
impact below it. Items are ordered by their commonest terms and halved again and again; a node holds
the largest weight of each term below it. The product of two nodes' maxima is a bound on every pair
below them, so where it is under the weakest k-th score of the node's items, the whole batch of pairs
is left out. Bounds only ever leave out pairs that cannot be among the k best; scores are sums of
64-bit whole numbers.

A task keeps the k best of each item over all its blocks, so its bounds grow sharper as it goes on;
a search of one block in ``SEEDS`` gives all tasks their first bounds. The k best of all tasks' rows
are the result.

Items are taken in parts of bounded size (``PART_BYTES`` of text, or one longer item): a part's terms and
weights are sent to all tasks, its documents' vectors hold no other terms, and its result is stored
before the next part is read, so the driver and the tasks hold one part at a time however many items
there are.

Cases: a null or empty text has no terms, such a document is never found and such an item finds
nothing; a document that shares no term scores 0 and is not found; items that repeat are searched
once each; of equal scores the smaller key ranks first, null keys last; repeated documents are
ranked one by one; an empty table gives an empty result; columns other than the keys and the texts
are not read.
"""

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.contamination import split_words
from tradeweave.llm.words import spread
from tradeweave.plans.ordering import durable

PART_BYTES = 1 << 20  # of item texts that are searched at once
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 2_000_000  # a block is closed at either
LEAF, FAN = 16, 4  # documents of a leaf, children of a node
CHUNK = 8  # leaves that are scored before the bounds are looked at again
SEEDS = 64
SLACK = 1 + 1e-9  # bounds are sums of doubles; scores are exact

BLOCK_TYPES = "words long, documents long, keys array<long>, lengths array<long>, ends array<long>, terms binary, counts binary"


# --- vectors of documents


def _vectors(docs: DataFrame, numbers, key: str, text: str) -> DataFrame:
    """Blocks of documents that hold searched terms: keys, lengths, and per document the numbers of
    its terms and how often they occur; ``documents`` and ``words`` count all documents with words."""
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        keys, lengths, ends, terms, counts = [], [], [0], [], []
        words = documents = 0

        def block() -> pa.RecordBatch:
            def one(values, kind) -> pa.Array:
                return pa.array([values], kind)

            def packed(parts: list[np.ndarray]) -> bytes:
                return np.concatenate([np.zeros(0, "<i4"), *parts]).astype("<i4").tobytes()

            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    one(words, pa.int64()),
                    one(documents, pa.int64()),
                    one(keys, longs),
                    one(lengths, longs),
                    one(ends[1:], longs),
                    one(packed(terms), pa.binary()),
                    one(packed(counts), pa.binary()),
                ],
                names=["words", "documents", "keys", "lengths", "ends", "terms", "counts"],
            )

        for batch in batches:
            texts = batch.column("text")
            for k, one_key in enumerate(batch.column("key").to_pylist()):
                found = split_words(texts[k].as_py())
                words, documents = words + len(found), documents + bool(found)
                own = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                own, many = np.unique(own[own >= 0], return_counts=True)
                if not len(own):
                    continue
                keys.append(one_key)
                lengths.append(len(found))
                ends.append(ends[-1] + len(own))
                terms.append(own)
                counts.append(many)
                if len(keys) >= BLOCK_DOCS or ends[-1] >= BLOCK_POSTINGS:
                    yield block()
                    keys, lengths, ends, terms, counts = [], [], [0], [], []
                    words = documents = 0
        if keys or documents:
            yield block()

    return rows.mapInArrow(run, BLOCK_TYPES)


WORDS, DOCUMENTS = -1, -2  # beside the terms in ``_frequencies``


def _frequencies(vectors: DataFrame, terms: int) -> dict[int, int]:
    """In how many documents each term occurs, and the totals of words and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        words = documents = 0
        for batch in batches:
            words += sum(batch.column("words").to_pylist())
            documents += sum(batch.column("documents").to_pylist())
            for data in batch.column("terms").to_pylist():
                found += np.bincount(np.frombuffer(data, "<i4"), minlength=terms)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([WORDS, DOCUMENTS, *held.tolist()], pa.int64()), pa.array([words, documents, *found[held].tolist()], pa.int64())],
            names=["term", "n"],
        )

    counted = vectors.select("words", "documents", "terms").mapInArrow(run, "term long, n long")
    # a row per term of the part, whose size is bounded
    return {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# --- the two trees


class _Items:
    """The items of a part, in an order that brings alike ones together; node (a, b) is a run of it."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, df: np.ndarray):
        order = sorted(range(len(items)), key=lambda k: sorted((-int(df[t]), int(t)) for t in items[k]))
        self.order = np.array(order, np.int64)
        self.terms = [items[k][weights[items[k]] > 0] for k in order]
        self.weights = weights
        self.nodes: dict[tuple[int, int], np.ndarray] = {}

    def terms_of(self, a: int, b: int) -> np.ndarray:
        if b - a == 1:
            return self.terms[a]
        if (a, b) not in self.nodes:
            self.nodes[a, b] = np.unique(np.concatenate(self.terms[a:b]))
        return self.nodes[a, b]


class _Level:
    """The largest impact of each term in each node of one level, by term."""

    def __init__(self, terms: np.ndarray, nodes: np.ndarray, impacts: np.ndarray, count: int, size: int):
        code = terms * size + nodes
        order = np.argsort(code, kind="stable")
        code, impacts = code[order], impacts[order]
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.size = size
        self.terms, self.nodes = code[heads] // size, code[heads] % size
        self.most = np.maximum.reduceat(impacts, heads)
        self.starts = np.searchsorted(self.terms, np.arange(count + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        starts = self.starts[terms]
        sizes = self.starts[terms + 1] - starts
        at = spread(starts, sizes)
        product = np.repeat(weights[terms], sizes).astype(np.float64) * self.most[at]
        return np.bincount(self.nodes[at], product, self.size) * SLACK


class _Block:
    """A block's documents and the tree over them."""

    def __init__(self, row: dict, n: int, total: int, weights: np.ndarray):
        count = len(weights)
        ends = np.array(row["ends"], np.int64)
        sizes = np.diff(ends, prepend=0)
        terms, counts = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("terms", "counts"))
        m = np.array([100 - 90 + 90 * x * n // total for x in row["lengths"]], np.int64)
        impacts = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, sizes))
        # documents in the order of their heaviest terms
        owner = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((-(weights[terms] * impacts), owner))
        heads = ends - sizes
        heaviest = terms[by][heads]
        second = np.where(sizes > 1, terms[by][np.minimum(heads + 1, len(by) - 1)], -1)
        order = np.lexsort((second, heaviest))
        at = spread(heads[order], sizes[order])
        self.keys = [row["keys"][k] for k in order.tolist()]
        self.terms, self.impacts, self.sizes = terms[at], impacts[at], sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        nodes = np.repeat(np.arange(len(order)) // LEAF, self.sizes)
        size = (len(order) - 1) // LEAF + 1
        self.levels = [_Level(self.terms, nodes, self.impacts, count, size)]
        while size > 1:
            low, size = self.levels[-1], (size - 1) // FAN + 1
            self.levels.append(_Level(low.terms, low.nodes // FAN, low.most, count, size))

    def scores(self, leaves: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of all documents of the leaves."""
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.sizes)]
        sizes = self.sizes[docs]
        at = spread(self.starts[docs], sizes)
        products = weight_of[self.terms[at]] * self.impacts[at]
        return docs, np.add.reduceat(products, np.cumsum(sizes) - sizes)


class _Search:
    """The k best documents so far of each item, and the descent through both trees."""

    def __init__(self, items: _Items, k: int, floors: np.ndarray):
        self.items, self.k = items, k
        self.floors = floors[items.order].copy()  # no score below it can be among the k best
        self.floors[[not len(t) for t in items.terms]] = np.iinfo(np.int64).max
        self.best: list[list[tuple]] = [[] for _ in items.terms]
        self.weight_of = np.zeros(len(items.weights), np.int64)

    def block(self, block: _Block) -> None:
        if self.items.terms:
            self._visit(block, 0, len(self.items.terms), len(block.levels) - 1, np.zeros(1, np.int64))

    def _visit(self, block: _Block, a: int, b: int, level: int, nodes: np.ndarray) -> None:
        bounds = block.levels[level].bounds(self.items.terms_of(a, b), self.items.weights)[nodes]
        near = bounds >= self.floors[a:b].min()
        nodes, bounds = nodes[near], bounds[near]
        if not len(nodes):
            return
        below = nodes
        if level:
            below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < block.levels[level - 1].size]
        if b - a > 1:
            middle = (a + b) // 2
            self._visit(block, a, middle, max(level - 1, 0), below)
            self._visit(block, middle, b, max(level - 1, 0), below)
        elif level:
            self._visit(block, a, b, level - 1, below)
        else:
            self._score(block, a, nodes[np.argsort(-bounds, kind="stable")], np.sort(bounds)[::-1])

    def _score(self, block: _Block, item: int, leaves: np.ndarray, bounds: np.ndarray) -> None:
        terms = self.items.terms[item]
        self.weight_of[terms] = self.items.weights[terms]
        for at in range(0, len(leaves), CHUNK):
            if bounds[at] < self.floors[item]:
                break
            docs, scores = block.scores(leaves[at : at + CHUNK], self.weight_of)
            good = scores >= self.floors[item]
            if good.any():
                found = zip(scores[good].tolist(), docs[good].tolist(), strict=True)
                best = self.best[item] + [(-s, block.keys[d] is None, block.keys[d] or 0) for s, d in found]
                best.sort()
                self.best[item] = best = best[: self.k]
                if len(best) == self.k:
                    self.floors[item] = max(self.floors[item], -best[-1][0])
        self.weight_of[terms] = 0


def _found(vectors: DataFrame, shared, k: int) -> DataFrame:
    """(item, key, score): the k best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, items, weights, df, n, total, floors = shared.value
        search = _Search(_Items(items, weights, df), k, floors)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["keys"]:
                    search.block(_Block(row, n, total, weights))
        out = [
            (int(numbers[at]), None if null else key, -score)
            for at, best in zip(search.items.order.tolist(), search.best, strict=True)
            for score, null, key in best
        ]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["item", "key", "score"])

    rows = vectors.drop("words", "documents").mapInArrow(run, "item long, key long, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- the operator


def _part(docs: DataFrame, rows: list[tuple[int, str]], k: int, key: str, text: str) -> DataFrame | None:
    """(item, rank, key, score) of the part's items, stored."""
    context = docs.sparkSession.sparkContext
    numbers: dict[bytes, int] = {}
    items = [
        np.array(sorted({numbers.setdefault(w, len(numbers)) for w in split_words(body)}), np.int64) for _, body in rows
    ]
    if not numbers:
        return None
    terms = context.broadcast(numbers)
    vectors = durable(_vectors(docs, terms, key, text))
    terms.unpersist()
    counted = _frequencies(vectors, len(numbers))
    n, total = counted.get(DOCUMENTS, 0), counted.get(WORDS, 0)
    if n == 0:
        return None
    df = np.array([counted.get(t, 0) for t in range(len(numbers))], np.int64)
    weights = np.array([weight(n, x) for x in df.tolist()], np.int64)
    known = (np.array([r[0] for r in rows], np.int64), items, weights, df, n, total)
    # the k-th scores in a few blocks are lower bounds of those in all
    first = context.broadcast((*known, np.ones(len(items), np.int64)))
    seeds = vectors.where(F.pmod(F.xxhash64("terms"), F.lit(SEEDS)) == 0)
    reached = {r["item"]: r["score"] for r in _found(seeds, first, k).where(F.col("rank") == k).collect()}
    floors = np.array([reached.get(r[0], 1) for r in rows], np.int64)
    shared = context.broadcast((*known, floors))
    found = durable(_found(vectors, shared, k))
    first.unpersist()
    shared.unpersist()
    return found


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    *,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: the item's key, rank (from 1),
    the document's key (a whole number) and score."""
    body = F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit(""))
    stored = durable(
        items.select(F.col(f"`{item_key}`").alias("own"), body.alias("body"), F.monotonically_increasing_id().alias("item"))
    )
    total = stored.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = total // part_bytes + 1
    found = []
    for at in range(count):
        mine = stored.where(F.pmod(F.xxhash64("item"), F.lit(count)) == at).select("item", "body")
        part = _part(docs, [tuple(r) for r in mine.collect()], k, key, text)
        if part is not None:
            found.append(part)
    kinds = "item long, key long, score long, rank int"
    rows = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], kinds)
    return rows.join(stored.select("item", "own"), "item").select(
        F.col("own").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"
    )
