"""Byte-level byte-pair encoding of the distinct words of a corpus, in Spark's own functions.

A word (pre-token) is an array of bytes. ``merged`` folds the ranked merges over it: the state is
the word's pieces and the rank of each neighbouring pair; each turn joins the leftmost pair of
the lowest rank and looks up the two new pairs. Words that hold no more pairs stay as they are.

The rank map is a literal. A map of 50,000 entries would be searched from its start for each
lookup, so it is an array of small maps, and a pair's CRC-32 says which. As Java objects it would
take each task seconds to read, so the plan holds it as one JSON string, which is parsed once for
each few thousand words. In it and in the fold a byte is the character of the same number
(ISO 8859-1), so that pieces are strings; ids are turned into binary pieces again for decoding.
The fold is quadratic in a word's length, so the few words of ``LONG_WORD`` characters or more have
the same merges made from a heap.

Each distinct word of the corpus is encoded once; ids are joined back by block (``words``), where
each document's ids are put in order, and decoding concatenates the binary pieces of those ids.

Cases: a null text counts as empty and has no ids; nothing in a text is a special token; bytes
that the vocabulary lacks raise an error; repeated documents keep a row each; an empty table
gives an empty result; columns other than the key and the text are not read.
"""

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.llm import words

SHELVES = 16_384  # maps that the ranks are dealt over; about three entries each
TOGETHER = 25_000  # words that share one reading of the ranks
PART = 20_000  # words of a block that are decoded at once
LONG_WORD = 200  # characters from which a word's merges are kept in a heap, as the fold is quadratic
NONE = (1 << 31) - 1  # rank of a pair that never merges
NO_PAIR = NONE << 31


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the piece, space, rank, a line each."""
    with open(path, "rb") as file:
        return {
            base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file) if piece
        }


def _shelved(ranks: dict[bytes, int], once: Column) -> Column:
    """Array of maps from piece to rank, by CRC-32 of the piece; parsed where ``once`` is read
    (an empty string that depends on the row, so that the plan keeps the string)."""
    shelves: list[dict[str, int]] = [{} for _ in range(SHELVES)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        shelves[zlib.crc32(text.encode()) % SHELVES][text] = rank
    literal = F.lit(json.dumps(shelves, ensure_ascii=False))
    return F.from_json(F.concat(literal, once), SHELF_TYPE)


SHELF_TYPE = "array<map<string,int>>"
STATE = "struct<pieces:array<string>,pairs:array<int>,at:int>"


def _let(value: Column, use: Callable[[Column], Column], kind: str = STATE) -> Column:
    """``use(value)``, of type ``kind``, with ``value`` worked out once: lambda bodies share
    nothing by themselves. A fold over one value, as transform() would copy the result."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, held: use(held))


def merged(word: Column, shelves: Column) -> Column:
    """The token ids of a pre-token; ``shelves`` holds the ranks as ``_shelved`` deals them."""

    def rank(piece: Column) -> Column:
        shelf = F.element_at(shelves, (F.crc32(piece) % SHELVES + 1).cast("int"))
        return F.coalesce(F.try_element_at(shelf, piece), F.lit(NONE))

    def pair(pieces: Column, at: Column) -> Column:
        """Rank of the pieces at ``at`` and after it; NONE beyond either end."""
        inside = (at >= 1) & (at < F.size(pieces))
        return F.when(
            inside, rank(F.concat(F.get(pieces, at - 1), F.get(pieces, at)))
        ).otherwise(F.lit(NONE))

    def state(pieces: Column, pairs: Column) -> Column:
        """at: the first place of the lowest rank, 0 if no pair is left to merge."""
        return _let(
            pairs,
            lambda found: F.struct(
                pieces.alias("pieces"),
                found.alias("pairs"),
                _let(
                    # one number holds rank and place, so that the least of them gives both
                    F.array_min(
                        F.transform(found, lambda r, i: F.shiftleft(r.cast("long"), 31) + i)
                    ),
                    lambda least: F.when(
                        least < NO_PAIR, (least.bitwiseAND(F.lit((1 << 31) - 1)) + 1).cast("int")
                    ).otherwise(F.lit(0)),
                    "int",
                ).alias("at"),
            ),
        )

    def head(items: Column, n: Column) -> Column:
        return F.slice(items, F.lit(1), F.greatest(n, F.lit(0)))

    def tail(items: Column, start: Column) -> Column:
        return F.slice(items, start, F.size(items))

    def step(held: Column, _: Column) -> Column:
        pieces, pairs, at = held["pieces"], held["pairs"], held["at"]
        joined = F.concat(
            head(pieces, at - 1),
            F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at))),
            tail(pieces, at + 2),
        )
        # pair i joins pieces i and i + 1: those before, at and after the joined piece change
        def with_pairs(now: Column) -> Column:
            before = F.when(at >= 2, F.array(pair(now, at - 1))).otherwise(F.array().cast("array<int>"))
            after = F.when(at < F.size(now), F.array(pair(now, at))).otherwise(
                F.array().cast("array<int>")
            )
            return state(now, F.concat(head(pairs, at - 2), before, after, tail(pairs, at + 2)))

        return F.when(at == 0, held).otherwise(_let(joined, with_pairs))

    # each byte is the character of the same number
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    start = _let(
        letters,
        lambda pieces: state(
            pieces,
            F.when(
                F.size(pieces) > 1,
                F.transform(
                    F.sequence(F.lit(1), F.size(pieces) - 1), lambda at: pair(pieces, at)
                ),
            ).otherwise(F.array().cast("array<int>")),
        ),
    )
    turns = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
    return F.aggregate(turns, start, step, lambda held: F.transform(held["pieces"], rank))


def word_ids(distinct: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, fact): the token ids of each distinct pre-token, less ``words.SHIFT`` as shorts where
    they all fit."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            column = words.only_words(batch)
            short = pc.less(pc.utf8_length(column), LONG_WORD)
            held.append(column.filter(short))
            rows += len(held[-1])
            long = column.filter(pc.invert(short)).to_pylist()
            if long:
                yield _row(None, long, [heap_merged(x.encode(), ranks) for x in long])
            if rows >= TOGETHER:
                yield _row(pa.concat_arrays(held), [], [])
                held, rows = [], 0
        if rows:
            yield _row(pa.concat_arrays(held), [], [])

    kind = "array<struct<word:string,fact:array<int>>>"
    rows = distinct.mapInArrow(together, f"words array<string>, long {kind}")
    nothing = F.substring(F.element_at("words", 1), 1, 0)
    encoded = _let(
        _shelved(ranks, nothing),
        lambda shelves: F.transform(
            "words",
            lambda word: F.struct(word.alias("word"), merged(word, shelves).alias("fact")),
        ),
        kind,
    )
    found = F.when(F.col("words").isNull(), F.col("long")).otherwise(encoded)
    ids = F.col("found.fact")
    if max(ranks.values(), default=0) < 2 * words.SHIFT:
        unknown = F.raise_error(F.lit("a byte of the text is not in the vocabulary")).cast("short")
        ids = F.transform(
            ids, lambda x: F.when(x == NONE, unknown).otherwise((x - words.SHIFT).cast("short"))
        )
    return rows.select(F.explode(found).alias("found")).select("found.word", ids.alias("fact"))


def _row(short: pa.Array | None, long: list[str], ids: list[list[int]]) -> pa.RecordBatch:
    strings, found = pa.list_(pa.string()), pa.struct([("word", pa.string()), ("fact", pa.list_(pa.int32()))])
    words_of = pa.array([None], strings)
    if short is not None:
        words_of = pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), short)
    pairs = [{"word": w, "fact": x} for w, x in zip(long, ids, strict=True)]
    return pa.RecordBatch.from_arrays([words_of, pa.array([pairs], pa.list_(found))], names=["words", "long"])


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one word in n log n: the pairs wait in a heap by rank and place."""
    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def pair(i: int) -> tuple[int, int, bytes] | None:
        j = after[i]
        both = pieces[i] + pieces[j] if j < n else b""
        return (ranks[both], i, both) if both in ranks else None

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if pieces[i] is None or j >= n or pieces[i] + pieces[j] != both:
            continue  # one of the two has been merged since
        pieces[i], pieces[j], after[i] = both, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (new := pair(k)):
                heapq.heappush(heap, new)
    return [ranks[x] for x in pieces if x is not None]


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    *,
    keep_ids: bool = False,
    block_chars: int = words.BLOCK_CHARS,
) -> DataFrame:
    """Per document: its key, n_bytes, n_tokens, ids_sha256 (of the decimal ids, joined by commas),
    decoded_sha256 (of the bytes decoded from the ids) and, if wanted, ids. Larger blocks shuffle
    less, smaller ones take less memory."""
    pieces = {rank: piece for piece, rank in ranks.items()}
    numerals = {rank: str(rank) for rank in pieces}

    def assemble(
        known: np.ndarray, ends: np.ndarray, sequences: list[np.ndarray]
    ) -> dict[str, pa.Array]:
        """Puts the ids of each document's words in order and decodes them."""
        starts = np.concatenate([[0], ends[:-1]])
        decoded: list[bytes] = []
        decimal: list[str] = []
        for at in range(0, len(ends), PART):  # a part at a time, as lists take many times the room
            part = slice(at, at + PART)
            low, bounds = int(starts[at]), zip((starts[part] - starts[at]).tolist(), (ends[part] - starts[at]).tolist(), strict=True)
            ids = known[low : int(ends[part][-1])].tolist()
            try:
                binary = list(map(pieces.__getitem__, ids))
            except KeyError:
                raise ValueError("a byte of the text is not in the vocabulary") from None
            digits = list(map(numerals.__getitem__, ids))
            for a, b in bounds:
                decoded.append(b"".join(binary[a:b]))
                decimal.append(",".join(digits[a:b]))
        sizes = ends - starts
        hashes, back, all_ids = [], [], []
        for sequence in sequences:
            order = sequence.tolist()
            joined = ",".join(map(decimal.__getitem__, order))
            hashes.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(map(decoded.__getitem__, order))).hexdigest())
            if keep_ids:
                all_ids.append(known[words.spread(starts[sequence], sizes[sequence])].astype(np.int32))
        out = {
            "n_tokens": pa.array([int(sizes[s].sum()) for s in sequences], pa.int64()),
            "ids_sha256": pa.array(hashes, pa.string()),
            "decoded_sha256": pa.array(back, pa.string()),
        }
        if keep_ids:
            offsets = np.cumsum([0, *map(len, all_ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *all_ids])
            out["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return out

    docs = words.stored(docs, key, text)
    found = words.blocks(docs, pattern, None, key, text, block_chars=block_chars)
    facts = words.places(found).join(word_ids(words.distinct_words(found), ranks), "word")
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = words.with_facts(found, facts, assemble, columns + ", ids array<int>" * keep_ids)
    return rows.withColumnRenamed("id", key)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the bytes of their ids, null where the ids are null."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shelf = F.from_json(F.lit(json.dumps([x.hex() for x in pieces])), "array<string>")
    joined = F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.element_at(shelf, i + 1)), "")
    return encoded.withColumn("decoded", F.unhex(joined))
