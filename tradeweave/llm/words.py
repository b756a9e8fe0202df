"""Pre-tokens of a corpus, kept once per block instead of once per occurrence.

A pre-token is a piece of text that byte-pair merges never cross. Most occur again and again, so
what a model says about one (its ids, its count) is worked out once per distinct pre-token of the
corpus and joined back. Joining every occurrence would shuffle many times the corpus; here the
documents are taken in blocks of bounded size, and within a block a pre-token is a number.

``blocks`` splits the documents once into two kinds of rows, which share one exchange:

* words: a row per distinct pre-token of a block, with ``at``, one long of the block and the number,
  as these rows are most of what is shuffled; dealt by word;
* documents: the packed numbers of their pre-tokens in order, some documents to a row; dealt by block.

``distinct_words``, ``places`` and ``with_facts`` each read that exchange: for the distinct words of
the corpus, for the join of what is known about them with the blocks, and for the documents, to
which it applies a function block by block. The block of a row follows from its partition and the
rows before it there, so a lost task comes out the same as long as the documents are read from files
or a checkpoint, which hold still; ``stored`` sees to that.
``with_facts`` checks that every number of a block has its fact and raises otherwise.
"""

from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.plans.ordering import durable

BLOCK_CHARS = 24_000_000
ROWS = 50_000  # rows to an Arrow batch that is handed back
TOGETHER = 16  # documents that are packed as one, which takes less room

SIGNS = frozenset(".,;:!?")

NUMBER_BITS = 25  # of ``at``; a block has no more distinct pre-tokens than characters
BLOCK_BITS = 12  # of a block: its number in its partition
SHIFT = 1 << 15
WORDS_SCHEMA = "at long, word string"


@cache
def letters_and_numbers(pattern: str) -> regex.Pattern:
    r"""``pattern`` with \p{L} and \p{N} as the tokenizer libraries have them.

    The regex module may know characters of a later Unicode version than they do. Those that
    Python itself has no category for are looked up in the library's own splitter.
    """
    import unicodedata

    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    named = regex.compile(r"[\p{L}\p{N}]")
    late = []
    for code in range(0x110000):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(letter) != "Cn":
            continue
        if named.match(letter) and len(split("a" + letter)) > 1 and len(split("1" + letter)) > 1:
            late.append(code)
    if not late:
        return regex.compile(pattern)
    starts = [c for i, c in enumerate(late) if i == 0 or late[i - 1] != c - 1]
    ends = [c for i, c in enumerate(late) if i == len(late) - 1 or late[i + 1] != c + 1]
    out = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
    exact = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{out}])")
    for name in (r"\p{L}", r"\p{N}"):
        exact = exact.replace(f" ?{name}+", f" ?[{name}--[{out}]]+")
    return regex.compile(exact, regex.V1)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class _Chunks(dict):
    """The numbers of the pre-tokens of text between two single spaces, worked out once.

    A chunk that is empty, or has white space at an end, may share a run of white space with its
    neighbours; it has no numbers of its own (None) and its text is split as a whole.
    """

    def __init__(self, split: Callable, numbers: _Numbers, before: str):
        self.split, self.numbers, self.before = split, numbers, before

    def __missing__(self, chunk: str) -> tuple[int, ...] | None:
        found = None
        if chunk.isalpha():  # most are a word, or one with a sign behind it
            found = (self.numbers[self.before + chunk],)
        elif chunk[-1:] in SIGNS and chunk[:-1].isalpha():
            found = (self.numbers[self.before + chunk[:-1]], self.numbers[chunk[-1]])
        elif chunk and not chunk[0].isspace() and not chunk[-1].isspace():
            found = tuple(map(self.numbers.__getitem__, self.split(self.before + chunk)))
        self[chunk] = found
        return found


class _Block:
    def __init__(self, pattern: str, special: str | None):
        self.split, self.special, self.chars = letters_and_numbers(pattern).findall, special, 0
        self.numbers = _Numbers()
        self.first = _Chunks(self.split, self.numbers, "")
        self.later = _Chunks(self.split, self.numbers, " ")
        if special is not None:
            self.numbers[special]  # noqa: B018  takes the first number

    def of(self, text: str) -> list[int]:
        self.chars += len(text)
        if self.special is None or self.special not in text:
            return self._plain(text)
        out = []
        for k, part in enumerate(text.split(self.special)):
            out += [0] * (k > 0) + self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        if not text:
            return []
        start, *rest = text.split(" ")
        try:
            return [*self.first[start], *chain.from_iterable(map(self.later.__getitem__, rest))]
        except TypeError:  # a chunk without numbers
            return list(map(self.numbers.__getitem__, self.split(text)))


def _blocks(
    batches: Iterator[pa.RecordBatch], pattern: str, special: str | None, block_chars: int
) -> Iterator[tuple[int, _Block, list[list[int]] | None, pa.RecordBatch | None]]:
    """(block, its words, pre-token numbers by row, the rows) for runs of rows of one block, and
    once with None for the last two at the block's end."""
    number = TaskContext.get().partitionId() << BLOCK_BITS
    block = _Block(pattern, special)
    for batch in batches:
        texts, start = batch.column("text"), 0
        found: list[list[int]] = []
        for k in range(batch.num_rows):
            if block.chars >= block_chars:
                if found:
                    yield number, block, found, batch.slice(start, k - start)
                yield number, block, None, None
                number, block, start, found = number + 1, _Block(pattern, special), k, []
            found.append(block.of(texts[k].as_py() or ""))
        if found:
            yield number, block, found, batch.slice(start)
    yield number, block, None, None


def stored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the text, checkpointed unless they are plainly read from files or the like: the
    partitions of anything with a shuffle may come out otherwise the second time."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    kept = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    still = plan.getClass().getSimpleName() in ("LogicalRelation", "LogicalRDD", "LocalRelation")
    return kept if still else durable(kept)


def _texts(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")


def blocks(
    docs: DataFrame,
    pattern: str,
    special: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    *,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(word, at, doc), dealt by word. Rows of words have no ``doc``; those of documents have the
    block in ``at``, and in ``word`` a text that is no pre-token and the same for a block.

    Three readers share this exchange. Spark sees that only if each of them asks for all columns of
    it, so they do, and if no filter of theirs goes below it.
    """
    if letters_and_numbers(pattern).findall(_mark(0)) == [_mark(0)]:
        raise ValueError("the pattern takes the mark of a block for a pre-token")
    rows = docs.select(F.col(f"`{key}`").alias("id"), _texts(docs, text))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(word: pa.Array, at: np.ndarray, doc: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([word, pa.array(at), doc], names=["word", "at", "doc"])

        def together(found: list[list[int]], batch: pa.RecordBatch) -> pa.StructArray:
            every = np.concatenate([np.array(x, np.uint32) for x in found])
            columns = [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), batch.column(c)) for c in ("id", "n_bytes")]
            columns += [pa.array([pack(x)], pa.binary()) for x in ([len(x) for x in found], every)]
            return pa.StructArray.from_arrays(columns, ["ids", "n_bytes", "sizes", "packed"])

        type_of = None
        for number, block, found, batch in _blocks(batches, pattern, special, block_chars):
            if found is not None:
                for at in range(0, len(found), TOGETHER):
                    doc = together(found[at : at + TOGETHER], batch.slice(at, TOGETHER))
                    type_of = doc.type
                    yield out(pa.array([_mark(number)]), np.full(1, number, np.int64), doc)
                continue
            words = list(block.numbers) if type_of is not None else []
            for at in range(0, len(words), ROWS):
                part = words[at : at + ROWS]
                places = (number << NUMBER_BITS) + np.arange(at, at + len(part), dtype=np.int64)
                yield out(pa.array(part, pa.string()), places, pa.nulls(len(part), type_of))

    found = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        run, f"word string, at long, doc struct<ids:array<{kind}>,n_bytes:array<long>,sizes:binary,packed:binary>"
    )
    # no word is null; a join on the word would put this filter below one of several equal exchanges
    return found.where("word IS NOT NULL").repartition("word")


def _mark(block: int) -> str:
    return f"d0 {block}"


def distinct_words(found: DataFrame) -> DataFrame:
    """(word, blocks, documents): the distinct words of ``blocks`` and in how many blocks each occurs;
    where ``documents`` is not 0 it is the mark of a block."""
    return found.groupBy("word").agg(F.count("at").alias("blocks"), F.count("doc").alias("documents"))


def only_words(batch: pa.RecordBatch) -> pa.Array:
    """The words of a batch of ``distinct_words``."""
    return batch.column("word").filter(pc.equal(batch.column("documents"), 0))


def places(found: DataFrame) -> DataFrame:
    """(word, at) of the words of ``blocks``, and rows that join with no word."""
    return found.select("word", F.when(F.col("doc").isNull(), F.col("at")).alias("at"))


def _documents(found: DataFrame) -> DataFrame:
    """(word, ids, n_bytes, sizes, packed) of the documents of ``blocks``, some to a row."""
    # a condition that Spark can't foresee stays above the exchange
    here = F.when(F.col("doc").isNull(), F.lit(False)).otherwise(F.monotonically_increasing_id() + F.col("at") >= 0)
    return found.where(here).select("word", "doc.*")


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(numbers: list[int] | np.ndarray) -> bytes:
    """Whole numbers as four byte planes, of which the high ones are mostly zero, compressed."""
    planes = np.array(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return _packer().compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacker().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _packed_facts(facts: DataFrame) -> DataFrame:
    """Facts (at, fact: a whole number or a list of them) as a few rows per block; shorts hold
    numbers less SHIFT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("at")
            at = table.column("at").to_numpy()
            block = at >> NUMBER_BITS
            starts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()]
            fact = table.column("fact").combine_chunks()
            out = []
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                own, sizes = fact.slice(a, b - a), b""
                if pa.types.is_list(own.type):
                    sizes = pack(pc.list_value_length(own).to_numpy())
                    own = own.flatten()
                if pa.types.is_int16(own.type):
                    own = pc.add(own.cast(pa.int32()), SHIFT)
                numbers = at[a:b] & ((1 << NUMBER_BITS) - 1)
                steps = np.diff(numbers, prepend=0)  # sorted, so small
                out.append((int(block[a]), pack(steps), sizes, pack(own.to_numpy())))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "numbers", "sizes", "facts"])

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 40 * ROWS:  # bounds what a task holds
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return facts.select("at", "fact").mapInArrow(
        run, "block long, numbers binary, sizes binary, facts binary"
    )


def with_facts(
    found: DataFrame,
    facts: DataFrame,
    apply: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], dict[str, pa.Array]],
    columns: str,
) -> DataFrame:
    """A row per document of ``blocks``: id, n_bytes and what ``apply`` returns for its block, given
    facts (at, fact).

    ``apply`` gets the facts of a block one after another, where each pre-token's end (a fact that
    is a list may be of any size), and the numbers of each document's pre-tokens; ``columns``
    names and types its results.
    """
    documents = _documents(found)
    kind = documents.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sequences: list[np.ndarray] = []
        for sizes, packed in zip(*(left.column(c).to_pylist() for c in ("sizes", "packed")), strict=True):
            sequences += np.split(unpack(packed), np.cumsum(unpack(sizes))[:-1])
        rows = right.select(["numbers", "sizes", "facts"]).to_pylist()
        parts = [(np.cumsum(unpack(r["numbers"])), r["sizes"], unpack(r["facts"])) for r in rows]
        nothing = np.zeros(0, np.int64)
        numbers = np.concatenate([nothing, *(n for n, _, _ in parts)])
        sizes = np.concatenate(
            [nothing, *(unpack(s) if s else np.ones(len(n), np.uint32) for n, s, _ in parts)]
        )
        known = np.concatenate([nothing, *(f for _, _, f in parts)])
        order = np.argsort(numbers, kind="stable")
        wanted = max((int(s.max()) + 1 for s in sequences if len(s)), default=0)
        if wanted > len(numbers) or (numbers[order] != np.arange(len(numbers))).any():
            raise RuntimeError("the documents changed between two reads; store them first")
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        known = known[spread(starts[order], sizes[order])]
        more = apply(known, np.cumsum(sizes[order], dtype=np.int64), sequences)
        ids, n_bytes = (left.column(c).combine_chunks().flatten() for c in ("ids", "n_bytes"))
        return pa.table({"id": ids, "n_bytes": n_bytes, **more})

    packed = _packed_facts(facts).withColumn("word", F.concat(F.lit(_mark(0)[:-1]), "block"))
    grouped = documents.groupBy("word").cogroup(packed.groupBy("word"))
    return grouped.applyInArrow(run, f"id {kind}, n_bytes long, {columns}")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .., one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)
