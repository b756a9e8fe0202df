"""Token ids in binary files of 64-bit words (Simple-8b), written in key order and read back.

Coding: a word's highest four bits say how many ids it holds and how wide they are (``COUNTS``,
``WIDTHS``), so one word takes from 120 zeros to a single id of 60 bits. A wider id is an escape:
its word (selector 0) holds a place in the block's list of plain 64-bit values. The ids of a file
are cut into blocks of ``BLOCK_IDS``, whose places are listed at the file's end, so that any block
is found and decoded by itself, a selector at a time instead of a word at a time.

A file, little-endian:

    magic, then per block: its words, then its escapes
    documents: keys (8 bytes each), a byte each that is 1 for a null key, numbers of ids (8 bytes each)
    blocks: place in the file, words, escapes, ids (8 bytes each)
    documents, blocks, place of the documents section (8 bytes each), magic

Texts are encoded with the tokenizers library, whose word-level vocabulary never joins two words of its
splitter. Most words occur again and again, so each task asks the library's byte-pair model once per
distinct word and keeps a bounded number of answers. Texts of ASCII and Latin-1 letters need of the
library's normalising only small letters; what is beyond them passes through all of it (``_Encoder``).

Documents are range-partitioned and sorted by key, so partition after partition and file after file
hold ascending keys; how many ids precede a file follows from the list of files. Files lie in a
folder that all executors share; a task's files carry its attempt in their names, and only those of
attempts that succeeded are listed.

Cases: a null text counts as empty and has the end id only; null keys come first; rows with equal
keys lie in the order of a hash of their texts (equal rows: in any order), so a repeated key
spreads over partitions; an empty table has no files and an empty result; other columns are not
read.
"""

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.llm.archives import filesystem
from tradeweave.plans.ordering import checkpoint_folder, durable

#: ids in a word and bits of each, by selector; selector 0 is an escape
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 0
FEW = 4  # at a part of the places of less than one in so many, selectors are tried one by one
SHORT_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)  # of small numbers

MAGIC = b"TWIDS8b1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24  # a file is closed after the document that passes this


# --- coding


def encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of whole numbers from 0 to 2**64 - 1."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, none = len(ids), np.zeros(0, np.uint64)
    if n == 0:
        return none, none
    wide = ids >> np.uint64(60) > 0
    escapes = ids[wide]
    values = np.where(wide, np.cumsum(wide).astype(np.uint64) - np.uint64(1), ids) if len(escapes) else ids
    # the narrowest selector that fits at each place; beyond the end anything fits
    bits = np.zeros(n + max(COUNTS), np.int8)
    if int(values.max()) < len(SHORT_BITS):
        bits[:n] = SHORT_BITS[values.astype(np.int64)]
    else:
        bits[:n] = np.frexp(values.astype(np.float64))[1]  # beyond 53 the width is 60 anyway
    bits[:n][wide] = WIDTHS[-1]
    best = np.full(n, len(COUNTS) - 1, np.int8)
    before = np.zeros(n + max(COUNTS), np.int32)  # numbers that are too wide before a place
    places = None  # that the selector before fits at; a narrower one of more numbers fits at no others
    for selector in range(len(COUNTS) - 2, 0, -1):
        width, count = WIDTHS[selector], COUNTS[selector]
        if places is None:
            np.cumsum(bits[:n] > width, out=before[1 : n + 1])
            before[n + 1 :] = before[n]
            fits = before[count : count + n] == before[:n]
            np.copyto(best, np.int8(selector), where=fits)
            if np.count_nonzero(fits) * FEW <= n:
                places = np.flatnonzero(fits)
        else:
            places = places[(bits[places[:, None] + np.arange(count)] <= width).all(axis=1)]
            best[places] = selector
        if places is not None and not len(places):
            break
    if len(escapes):
        best[wide] = ESCAPE
    steps = np.array(COUNTS, np.uint8)[best].tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(max(COUNTS), np.uint64)])
    for selector in np.unique(chosen).tolist():
        width, count = WIDTHS[selector], COUNTS[selector]
        if width:
            mine = np.flatnonzero(chosen == selector)
            shifts = (np.arange(count) * width).astype(np.uint64)
            held = padded[starts[mine][:, None] + np.arange(count)] << shifts
            words[mine] |= np.bitwise_or.reduce(held, axis=1)
    return words, escapes


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors).tolist():
        width, count = WIDTHS[selector], COUNTS[selector]
        if not width:
            continue
        mine = np.flatnonzero(selectors == selector)
        shifts = (np.arange(count) * width).astype(np.uint64)
        held = (words[mine][:, None] >> shifts) & np.uint64((1 << width) - 1)
        if selector == ESCAPE:
            held = escapes[held.astype(np.int64)]
        out[starts[mine][:, None] + np.arange(count)] = held
    return out[:n]


# --- files


class Writer:
    """One file of ids: documents are added whole, blocks are written as they fill."""

    def __init__(self, file, block_ids: int = BLOCK_IDS):
        self.file, self.place, self.block_ids = file, len(MAGIC), block_ids
        self.keys, self.sizes, self.blocks = [], [], []
        self.held, self.waiting, self.ids = [], 0, 0
        file.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            every = np.concatenate(self.held)
            full = self.waiting // self.block_ids * self.block_ids
            for at in range(0, full, self.block_ids):
                self._block(every[at : at + self.block_ids])
            self.held, self.waiting = [every[full:]], self.waiting - full

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = encode_block(ids)
        data = words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
        self.blocks.append((self.place, len(words), len(escapes), len(ids)))
        self.file.write(data)
        self.place += len(data)

    def close(self) -> int:
        """The file's length."""
        if self.waiting:
            self._block(np.concatenate(self.held))
        tail = [
            np.array([0 if k is None else k for k in self.keys], "<i8").tobytes(),
            bytes(k is None for k in self.keys),
            np.array(self.sizes, "<u8").tobytes(),
            np.array(self.blocks, "<u8").reshape(-1, 4).tobytes(),
            struct.pack("<QQQ", len(self.keys), len(self.blocks), self.place) + MAGIC,
        ]
        self.file.write(b"".join(tail))
        self.file.close()
        return self.place + sum(map(len, tail))


END = struct.Struct("<QQQ8s")


class Reader:
    """The documents and blocks of a file; ``ids`` decodes any stretch of it."""

    def __init__(self, file, size: int):
        self.file = file
        *found, magic = END.unpack(self._at(size - END.size, END.size))
        if magic != MAGIC:
            raise ValueError("not a file of ids, or cut off")
        documents, blocks, place = found
        data = self._at(place, documents * 17 + blocks * 32)
        null = np.frombuffer(data, np.uint8, documents, documents * 8)
        self.keys = pa.array(np.frombuffer(data, "<i8", documents), mask=null.astype(bool))
        self.sizes = np.frombuffer(data, "<u8", documents, documents * 9).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", blocks * 4, documents * 17).reshape(-1, 4).astype(np.int64)
        self.starts = np.cumsum(self.blocks[:, 3]) - self.blocks[:, 3]

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def block(self, number: int) -> np.ndarray:
        place, words, escapes, n = self.blocks[number].tolist()
        data = np.frombuffer(self._at(place, (words + escapes) * 8), "<u8")
        return decode_block(data[:words], data[words:], n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.starts, start, side="right")) - 1
        last = int(np.searchsorted(self.starts, stop - 1, side="right")) - 1
        found = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return found[start - self.starts[first] : stop - self.starts[first]]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; each block is read once."""
        held, number = np.zeros(0, np.uint64), 0
        for size in self.sizes.tolist():
            if len(held) < size:
                parts, have = [held], len(held)
                while have < size:
                    parts.append(self.block(number))
                    have, number = have + len(parts[-1]), number + 1
                held = np.concatenate(parts)
            yield held[:size]
            held = held[size:]


# --- encoding

PLAIN = re.compile("[ \\n!-~À-ÖØ-öø-ÿ]*")  # what normalising only lowers
SPECIAL = "<|"  # how the library's added tokens begin
#: the words of a plain text in small letters, as the library's splitter finds them
WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
END_OF_WORD = "</w>"  # ends the last token of each word
REMEMBERED = 500_000  # pieces that a task keeps the ids of, and
SHORT = 40  # none longer than this
TOGETHER = 1_000_000  # characters of texts that are encoded together


class _Encoder:
    """The ids of texts by the library, whose model is asked once per distinct word.

    White space is dropped by the library's splitter, so pieces between blanks can be encoded by themselves.
    Those of plain texts are split here into the words that it finds, and the new words of several texts go to the
    model together; the ids of pieces are kept as bytes, which join quickly. Of others (white space takes
    no part in normal forms) the pieces that are not plain go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.library.model)  # neither normalises nor splits words
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith(END_OF_WORD)]] = True
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c).lower() for c in range(0xC0, 0x100) if PLAIN.fullmatch(chr(c))]
        signs = {(chr(b), sign) for x in letters for b, sign in zip(x.encode(), byte_level.pre_tokenize_str(x)[0][0], strict=True)}
        self.shown = sorted((b, sign) for b, sign in signs if b != sign)  # bytes that the model has another sign for
        self.pieces: dict[str, bytes] = {}

    def _by_model(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        text = " ".join(words).encode().decode("latin-1")
        for byte, sign in self.shown:
            text = text.replace(byte, sign)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
        if len(ends) != len(words):
            raise RuntimeError("the ids of the words cannot be told apart")
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, missing: set[str]) -> list[str]:
        """Works out the ids of pieces; returns those that are too long to be kept."""
        plain = {p for p in missing if PLAIN.fullmatch(p) and SPECIAL not in p}
        split = {p: WORDS.findall(p) for p in plain if not p.isalpha()}
        words = plain.difference(split).union(*split.values()).difference(self.pieces)
        if words:
            words = list(words)
            self.pieces.update(zip(words, self._by_model(words), strict=True))
        for piece, own in split.items():
            self.pieces[piece] = b"".join([self.pieces[w] for w in own])
        odd = missing - plain
        for piece in odd:
            self.pieces[piece] = np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return [p for p in {*words, *split, *odd} if len(p) > SHORT]

    def _split(self, text: str) -> list[str]:
        """The pieces of a text, plain ones in small letters."""
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            return text.lower().split()
        pieces = text.replace("\n", " ").split(" ")
        return [p.lower() if PLAIN.fullmatch(p) and SPECIAL not in p else p for p in pieces]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the model gets the new words of all of them together."""
        split = [self._split(text) for text in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces = {}
        found = [list(map(self.pieces.get, pieces)) for pieces in split]
        places = [(n, k) for n, own in enumerate(found) if None in own for k, ids in enumerate(own) if ids is None]
        long = self._learn({split[n][k] for n, k in places})
        for n, k in places:
            found[n][k] = self.pieces[split[n][k]]
        for piece in long:
            del self.pieces[piece]
        return [np.frombuffer(b"".join(own), "<u4") for own in found]

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


_encoders: dict[str, _Encoder] = {}  # of a Python worker, which serves one task after another


def by_library(path: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """Makes, in a task, the function from text to ids by the tokenizer file at ``path``."""

    def make() -> _Encoder:
        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        return _encoders[path]

    return make


# --- the operator

FILE_TYPES = "part int, number int, path string, documents long, ids long, bytes long, earlier long"


def _encoded(batch: pa.RecordBatch, many: Callable[[list[str]], list[np.ndarray]]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The key and ids of each row, some ``TOGETHER`` characters at a time."""
    keys, texts = batch.column("key").to_pylist(), batch.column("text")
    held, size = [], 0
    for k in range(len(keys)):
        held.append(texts[k].as_py())
        size += len(held[-1])
        if size >= TOGETHER or k + 1 == len(keys):
            yield from zip(keys[k + 1 - len(held) : k + 1], many(held), strict=True)
            held, size = [], 0


def write_files(
    docs: DataFrame,
    make: Callable[[], Callable[[str], np.ndarray]],
    end: int | None = None,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    *,
    file_ids: int = FILE_IDS,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Writes the ids of all texts in ascending order of the key (a whole number) and lists the files
    with the ids before each: (part, number, path, documents, ids, bytes, earlier: in its part, start).

    ``make`` gives each task its function from text to ids, which may have a function ``many`` for several
    texts at once; ``end`` is appended to each document.
    """
    folder = folder or f"{checkpoint_folder(docs.sparkSession)}/ids-{uuid.uuid4()}"
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    order = (F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("arrival"))
    placed = (
        rows.withColumn("arrival", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), make()
        many = getattr(encode, "many", lambda texts: [encode(text) for text in texts])
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        last = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
        writer, number, name, earlier = None, 0, "", 0

        def closed() -> pa.RecordBatch:
            size = writer.close()
            row = (task.partitionId(), number, f"{folder}/{name}", len(writer.keys), writer.ids, size, earlier)
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
            names = ["part", "number", "path", "documents", "ids", "bytes", "earlier"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for one, ids in _encoded(batch, many):
                if writer is None:
                    name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.bin"
                    writer = Writer(files.open_output_stream(f"{root}/{name}"), block_ids)
                writer.add(one, np.concatenate([ids, last]))
                if writer.ids >= file_ids:
                    yield closed()
                    writer, number, earlier = None, number + 1, earlier + writer.ids
        if writer is not None:
            yield closed()

    listed = durable(placed.mapInArrow(run, FILE_TYPES))
    # one row per part; the list keeps its partitions, in which the files will be read
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = listed.groupBy("part").agg(F.sum("ids").alias("held"))
    starts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    placed = listed.join(F.broadcast(starts), "part")
    return placed.withColumn("start", F.col("first") + F.col("earlier")).drop("first")


def read_files(listed: DataFrame, *, keep_ids: bool = False, key: str = "doc_id") -> DataFrame:
    """Per document of the listed files (path, start): the key, ``start`` (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian numbers; null if one
    is larger) and, if wanted, ids."""
    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, place = filesystem(path)
                with files.open_input_file(place) as file:
                    reader = Reader(file, file.size())
                    starts = start + np.cumsum(reader.sizes) - reader.sizes
                    sums, held, at = [], [], 0
                    for k, ids in enumerate(reader.documents()):
                        narrow = not len(ids) or int(ids.max()) < 1 << 32
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()) if narrow else None)
                        if keep_ids:
                            held.append(ids)
                        whole = k + 1 == len(starts)
                        if whole or len(sums) >= 10_000 or sum(map(len, held)) >= FILE_IDS:
                            columns = [reader.keys.slice(at, len(sums)), pa.array(starts[at : k + 1]), pa.array(reader.sizes[at : k + 1]), pa.array(sums, pa.int64())]
                            if keep_ids:
                                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int64))))
                            yield pa.RecordBatch.from_arrays(columns, names)
                            sums, held, at = [], [], k + 1

    kinds = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return listed.select("path", "start").mapInArrow(run, kinds)
