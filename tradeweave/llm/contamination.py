"""Benchmark passages in training text, by a positional inverted index.

The index is made of segments: a run of documents whose words lie one after another, and for each
term the sorted list of its places. A segment is one row, so the index is an ordinary table,
stored in the shared folder, that grows with the corpus and is read in parallel. Given the terms
that tests can ask for, only their places are stored.

A phrase is looked up in each segment by its rarest term there: that list, shifted by the term's
offset, is where the phrase may start, and the lists of the other terms, from rare to frequent,
narrow it down. Proximity matches start from the rarest term likewise.

Tests are read in parts of bounded size, one after another, so what the driver holds and what is sent
to the tasks has a bound too.

Cases: a null text has no words; a document without words has no hits; an item without words has
no window, one of fewer words than a window is one window; equal items are found alike; repeated
documents and items keep their rows; empty tables give empty results or no hits; columns other
than the keys and the texts are not read.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.plans.ordering import durable

SEGMENT_WORDS = 1_000_000
PART_BYTES = 1 << 20  # of test texts that are looked up at once

#: A-Z become a-z, other ASCII signs that are no letter or digit become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    """The words of a text: runs of letters, digits and characters beyond ASCII, in lower case."""
    return (text or "").encode().translate(WORD_BYTES).split()


# --- the index

INDEX_TYPES = (
    "segment long, starts array<long>, sizes array<long>, terms array<binary>, ends array<long>, places binary"
)


def build_index(
    docs: DataFrame, terms: set[bytes] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Segments of the positional index of all documents: a row holds the documents' ids, where
    their words start and how many they are, and for each term the end of its list in places.

    ``terms``: store no others. It is sent to every task, so it must be bounded by the caller.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = None if terms is None else rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value

        def segment() -> pa.RecordBatch:
            names = sorted(numbers, key=numbers.__getitem__)
            if held:
                term = np.concatenate([t for t, _ in held])
                place = np.concatenate([p for _, p in held])
                order = np.argsort(term, kind="stable")
                ends = np.searchsorted(term[order], np.arange(len(names)), side="right")
                places = place[order].astype("<i4").tobytes()
            else:
                ends, places = np.zeros(0, np.int64), b""
            return pa.RecordBatch.from_arrays(
                [
                    _one_list(pa.concat_arrays(ids)),
                    pa.array([first + made], pa.int64()),
                    _one_list(pa.array(starts, pa.int64())),
                    _one_list(pa.array(sizes, pa.int64())),
                    _one_list(pa.array(names, pa.binary())),
                    _one_list(pa.array(ends, pa.int64())),
                    pa.array([places], pa.binary()),
                ],
                names=["ids", "segment", "starts", "sizes", "terms", "ends", "places"],
            )

        first, made = TaskContext.get().partitionId() << 32, 0
        numbers = _Terms(wanted)
        ids, starts, sizes, held, total = [], [], [], [], 0
        for batch in batches:
            texts = batch.column("text")
            for k in range(batch.num_rows):
                found = split_words(texts[k].as_py())
                ids.append(batch.column("id").slice(k, 1))
                starts.append(total)
                sizes.append(len(found))
                if found:
                    term = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                    at = np.flatnonzero(term >= 0)
                    if len(at):
                        held.append((term[at], (at + total).astype(np.int32)))
                total += len(found) + 1  # a gap, so that no phrase runs from one into the next
                if total >= SEGMENT_WORDS:
                    yield segment()
                    made += 1
                    numbers = _Terms(wanted)
                    ids, starts, sizes, held, total = [], [], [], [], 0
        if ids:
            yield segment()

    return rows.mapInArrow(run, f"ids array<{kind}>, {INDEX_TYPES}")


def _one_list(items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)


class _Terms(dict):
    """Numbers the terms of a segment as they come; -1 for those that are not wanted."""

    def __init__(self, wanted: set[bytes] | None):
        self.wanted, self.count = wanted, 0

    def __missing__(self, term: bytes) -> int:
        if self.wanted is not None and term not in self.wanted:
            return -1
        self[term] = number = self.count
        self.count += 1
        return number


class Segment:
    """A row of the index, to be searched."""

    def __init__(self, row: pa.RecordBatch):
        def items(name: str) -> pa.Array:
            return row.column(name).flatten()

        self.ids, self.number = items("ids"), row.column("segment")[0].as_py()
        self.starts, self.sizes = items("starts").to_numpy(), items("sizes").to_numpy()
        self.numbers = {t: i for i, t in enumerate(items("terms").to_pylist())}
        self.ends = [0, *items("ends").to_pylist()]
        self.places = np.frombuffer(row.column("places")[0].as_py(), "<i4")

    def places_of(self, term: bytes) -> np.ndarray:
        """Sorted places of a term, numbered through the segment."""
        number = self.numbers.get(term)
        if number is None:
            return self.places[:0]
        return self.places[self.ends[number] : self.ends[number + 1]]

    def document_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrase(self, words: tuple[bytes, ...]) -> np.ndarray:
        """The places where the words stand one after another."""
        if any(w not in self.numbers for w in words):
            return self.places[:0]
        lists = sorted(((self.places_of(w), i) for i, w in enumerate(words)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for places, offset in lists[1:]:
            if not len(found):
                break
            found = found[_within(found + offset, places)]
        return found

    def near(self, words: tuple[bytes, ...], reach: int) -> np.ndarray:
        """The places of the rarest word that have each other word within ``reach`` words, in the
        same document."""
        lists = sorted((self.places_of(w) for w in set(words)), key=len)
        found = lists[0]
        for places in lists[1:]:
            if not len(found) or not len(places):
                return found[:0]
            own = self.document_at(found)
            low = np.maximum(found - reach, self.starts[own])
            high = np.minimum(found + reach, self.starts[own] + self.sizes[own] - 1)
            at = np.searchsorted(places, low)
            found = found[(at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= high)]
        return found


def _within(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = np.searchsorted(places, values)
    return places[np.minimum(at, len(places) - 1)] == values


# --- test items


def windows(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The runs of ``size`` words of an item; a shorter one is one run, an empty one none."""
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def parts(items: DataFrame, key: str, text: str) -> tuple[int, Iterator[list[tuple]]]:
    """How many parts there are, and (key as text, text) of the items of each in turn, about PART_BYTES
    of text or one item. Distinct items suffice, as equal ones are found alike."""
    rows = items.select(
        F.col(f"`{key}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")
    ).distinct()
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = total // PART_BYTES + 1

    def each() -> Iterator[list[tuple]]:
        for k in range(count):
            mine = rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k)
            yield [tuple(r) for r in mine.collect()]

    return count, each()


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPAN_TYPES = "array<struct<start:long,end:long>>"


def _found_in(index: DataFrame, part: list[tuple], size: int) -> DataFrame:
    """(segment, place, id, n_words, spans, items) for every document: the stretches of words that
    a part's windows cover, and the items they are from."""
    owners: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, body in part:
        for window in windows(split_words(body), size):
            owners[window].append("" if item is None else item)
    shared = index.sparkSession.sparkContext.broadcast(dict(owners))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.slice(k, 1))
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                items: dict[int, set[str]] = defaultdict(set)
                for window, own in shared.value.items():
                    found = segment.phrase(window)
                    for place, document in zip(
                        found.tolist(), segment.document_at(found).tolist(), strict=True
                    ):
                        start = place - int(segment.starts[document])
                        spans[document].append((start, start + len(window)))
                        items[document].update(own)
                everyone = range(len(segment.sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(everyone), segment.number)),
                        pa.array(np.arange(len(everyone), dtype=np.int32)),
                        segment.ids,
                        pa.array(segment.sizes),
                        pa.array([merged(spans[d]) if d in spans else [] for d in everyone], SPANS),
                        pa.array(
                            [sorted(items[d]) if d in items else [] for d in everyone],
                            pa.list_(pa.string()),
                        ),
                    ],
                    names=["segment", "place", "id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(
        run,
        f"segment long, place int, id {kind}, n_words long, spans {SPAN_TYPES}, items array<string>",
    )


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """The stretches that (start, end) spans cover together."""
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _over_parts(found: list[DataFrame]) -> DataFrame:
    """What the parts of the items found, put together by document."""
    if len(found) == 1:
        return found[0]
    rows = found[0]  # at least one
    for more in found[1:]:
        rows = rows.unionByName(more)
    gathered = rows.groupBy("segment", "place").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),  # a list for each part
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [merged([(x["start"], x["end"]) for x in s]) for s in batch.column("spans").to_pylist()]
            at = batch.schema.get_field_index("spans")
            yield batch.set_column(at, "spans", pa.array(whole, SPANS))

    return gathered.mapInArrow(join_spans, gathered.schema)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = 13,
    share: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: its key, n_words, n_hit, spans (stretches of hit words), items (whose windows
    occur), n_items, items_sha256 and contaminated (a hit, and hits at least 1/share of the words).
    """
    count, tests = parts(items, item_key, item_text)
    if count == 1:  # its words bound what the index must hold
        (part,) = tests
        index = build_index(docs, {w for _, body in part for w in split_words(body)}, key, text)
        rows = _found_in(durable(index), part, size)
    else:  # a part's result is stored before the next part is read
        index = durable(build_index(docs, None, key, text))
        rows = _over_parts([durable(_found_in(index, part, size)) for part in tests])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.withColumn("n_hit", n_hit).select(
        F.col("id").alias(key),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "spans",
        "items",
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of the rows whose texts are not contaminated.

    A row is judged by its own text, whose hash is the key it is looked up by; ``key`` is not read, so
    null and repeated ones make no difference.
    """
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    found = contaminated(marked, items, size, share, "__mark", text)
    hit = found.where("contaminated").select("__mark").distinct()
    return marked.join(hit, "__mark", "left_anti").select(*docs.columns)


def proximity(index: DataFrame, words: list[str], reach: int) -> DataFrame:
    """(id, position): where the rarest of ``words`` stands with all others within ``reach``."""
    sought = tuple(w for x in words for w in split_words(x))
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.slice(k, 1))
                found = segment.near(sought, reach) if sought else segment.places[:0]
                own = segment.document_at(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        segment.ids.take(pa.array(own)),
                        pa.array(found.astype(np.int64) - segment.starts[own]),
                    ],
                    names=["id", "position"],
                )

    return index.mapInArrow(run, f"id {kind}, position long")
