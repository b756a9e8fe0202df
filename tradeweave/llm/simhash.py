"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it.
Fingerprints that differ in at most ``radius`` bits are linked; documents belong together if links
lead from one to the other.

Equal fingerprints are one from the start. The distinct ones are dealt into shards by pigeonhole:
of ``radius + 1`` bands of bits, two linked fingerprints agree on one at least, so a shard holds
the fingerprints that agree on a band. Within a shard a BK-tree is grown: the children of a node
are keyed by their Hamming distance to it, and a search follows only the edges within the radius
of its own distance. A shard passes on only the links that join something new, so a crowded shard
costs one link per fingerprint, not one per pair; shards above ``CROWDED`` fingerprints are dealt
again by bands of their remaining bits.

The trees are sent to the tasks by shuffle, not broadcast: together they grow with the corpus.

Cases: a null text counts as empty; documents without words have the fingerprint zero, linked like
any other; null keys are kept, as smaller than none; repeated documents keep a row each; an empty
table gives an empty result; columns other than the key and the text are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.links import components
from tradeweave.plans.ordering import durable

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z only
PART = 65_536  # hashes whose bits are counted at a time


def fingerprint(text: str, size: int) -> int:
    """SimHash of the ``size``-word shingles, repeats included; 0 without words."""
    found = text.encode().translate(LOWER).split()  # at ASCII white space
    if not found:
        return 0
    size = min(size, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        part = hashes[at : at + PART].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, fingerprint): the fingerprint as a long with the same 64 bits."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [fingerprint(texts[k].as_py() or "", size) for k in range(batch.num_rows)]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(signed)], names=["id", "fingerprint"]
            )

    return rows.mapInArrow(run, f"id {kind}, fingerprint long")


CROWDED = 4096  # fingerprints of a shard that one tree takes; more are dealt again

SHARD = ["mask", "agreed"]  # bits that a shard's fingerprints agree on, and their values
DEALT_TYPES = "mask long, agreed long, fingerprint long"


def bands(mask: int, radius: int) -> list[int]:
    """Masks that each add a band of the bits that ``mask`` leaves, in ``radius + 1`` bands."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    edges = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:])]


def _deal(rows: DataFrame, radius: int) -> DataFrame:
    """(mask, fingerprint) to a row for each shard of the next level that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("mask").to_numpy().view(np.uint64)
            values = batch.column("fingerprint").to_numpy().view(np.uint64)
            for mask in np.unique(held):
                own = values[held == mask]
                for wider in bands(int(mask), radius):
                    bits = np.full(len(own), wider, np.uint64)
                    columns = (bits, own & bits, own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.view(np.int64)) for c in columns],
                        names=[*SHARD, "fingerprint"],
                    )

    return rows.select("mask", "fingerprint").mapInArrow(run, DEALT_TYPES)


def tree_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (value, smallest value) that join the distinct ``values`` as far as they are within
    ``radius`` of each other, directly or through others: a BK-tree grown and searched at once.

    Every value is a query. A node measures its distance to the queries that reach it and to the
    values below it; these become one child for each distance, and a child gets the queries
    whose own distance differs from its edge by ``radius`` at most.
    """
    parent = np.arange(len(values))

    def roots(at: np.ndarray) -> np.ndarray:
        up = parent[at]
        while (parent[up] != up).any():
            up = parent[up]
        parent[at] = up
        return up

    everything = np.arange(len(values))
    waiting = [(everything, everything)]
    while waiting:
        members, queries = waiting.pop()
        node, below = members[0], members[1:]
        apart = np.bitwise_count(values[queries] ^ values[node]).astype(np.int64)
        found = np.unique(roots(np.append(queries[apart <= radius], node)))
        parent[found] = found[0]
        edges = np.bitwise_count(values[below] ^ values[node]).astype(np.int64)
        for edge in np.unique(edges):
            near = queries[np.abs(apart - edge) <= radius]
            if len(near):
                waiting.append((below[edges == edge], near))
    top = roots(everything)
    joined = np.flatnonzero(top != everything)
    return [(int(values[i]), int(values[top[i]])) for i in joined]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(mask, agreed, values, more) of sorted rows; ``more``: the shard is crowded, these are
    some of its values."""
    key: tuple[int, int] | None = None
    held: list[np.ndarray] = []
    size, crowded = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        mask, agreed, values = (
            batch.column(c).to_numpy().view(np.uint64) for c in (*SHARD, "fingerprint")
        )
        change = np.flatnonzero((mask[1:] != mask[:-1]) | (agreed[1:] != agreed[:-1])) + 1
        starts = [0, *change.tolist()]
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            own = (int(mask[a]), int(agreed[a]))
            if own != key:
                if held:
                    yield *key, np.concatenate(held), crowded
                key, held, size, crowded = own, [], 0, False
            held.append(values[a:b])
            size += b - a
            if size > CROWDED:
                crowded = True
                yield *key, np.concatenate(held), True
                held = []
    if held:
        yield *key, np.concatenate(held), crowded


def _searched(dealt: DataFrame, radius: int) -> DataFrame:
    """(mask, a, b): links a-b with mask 0; the members of crowded shards as a = b with their mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def full() -> pa.RecordBatch:
            columns = np.array(out, np.uint64).reshape(-1, 3).T
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns],
                names=["mask", "a", "b"],
            )

        for mask, _, values, crowded in _shards(batches):
            if crowded:
                out += [(mask, v, v) for v in values.tolist()]
            elif len(values) == 2:  # a root and one child
                if (int(values[0]) ^ int(values[1])).bit_count() <= radius:
                    out.append((0, int(values[1]), int(values[0])))
            elif len(values) > 2:
                out += [(0, a, b) for a, b in tree_links(values, radius)]
            if len(out) >= 10_000:
                yield full()
        if out:
            yield full()

    sorted_rows = dealt.repartition(*SHARD).sortWithinPartitions(*SHARD, "fingerprint")
    return sorted_rows.mapInArrow(run, "mask long, a long, b long")


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links among distinct ``fingerprint`` values; those within ``radius`` of each other
    are joined by one link or a chain of them."""
    rows = distinct.select(F.lit(0).cast("long").alias("mask"), "fingerprint")
    links = None
    while True:
        found = durable(_searched(_deal(rows, radius), radius))
        joined = found.where("a <> b").select("a", "b")
        links = joined if links is None else links.unionByName(joined)
        rows = found.where("a = b").select("mask", F.col("a").alias("fingerprint")).distinct()
        if rows.isEmpty():
            return links


def near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: its key, fingerprint (16 hex digits) and component_id, the smallest key of
    the documents it is linked to, itself included."""
    rows = durable(fingerprints(docs, size, key, text))
    classes = rows.groupBy("fingerprint").agg(F.min("id").alias("first"))
    roots = components(near_links(classes.select("fingerprint"), radius))
    placed = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        F.col("id").alias(key), hex_digits("fingerprint").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of one document of each group: the one with the smallest key. A row repeated
    with its key and text is kept once; different texts under one key are different documents and
    stay, as do documents with a null key.

    What stays is decided on (key, fingerprint) alone and then joined to the documents, of which
    a group has at most one that matches, so no group is gathered.
    """
    known = docs.where(F.col(key).isNotNull())
    groups = near_duplicates(known, size, radius, key, text)
    kept = groups.where(F.col(key) == F.col("component_id")).select(key).distinct()
    one = known.join(kept, key, "left_semi").dropDuplicates([key, text])
    return one.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


def hex_digits(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
