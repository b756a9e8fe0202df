"""Runs of repeating words, found with a run-length grammar made by recompression.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and
``times`` periods long, that no neighbouring word extends. Texts are taken in batches, laid one
after another with a separator of its own around each.

The grammar (``Grammar``): each turn first replaces blocks of equal symbols by one symbol (block
compression), then splits the symbols into left and right ones and replaces each left-right pair by
one symbol (pair compression), until a text is a single symbol. What a turn does at a place depends
on the neighbouring symbols only, so equal stretches are cut alike but for their ends. How far two
places agree (``forward``) is then a walk up and down the turns: compare the symbols that start at
both places, step over them while they are equal, over equal blocks at once, go up where both places
begin a symbol of the next turn, and down after a difference. ``backward`` is the same towards the
front. No suffix array is needed, and a query takes a few steps per turn.

Candidates lie on a harmonic grid: a run of period q holds two words q apart for each of max(q,
least - q) places in a row, one of which is a multiple of that number; so for each q only those
places are looked at, n log n in all, and only where the two words are equal do queries find the
whole stretch. A stretch found for several q has the smallest of them as its period.

Cases: a null text has no words and no runs; repeated rows are judged alike; an empty table gives
an empty result; a text is handled whole, however long, and bounds what a task holds; columns
other than the key and the text are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 300_000  # words that share a grammar, or one longer text
QUERIES = 400_000  # candidates that are followed at once
DENSE = 16  # turns that keep at least this share of the words look places up in a table
#: an odd multiplier per turn says which symbols are left and which are right
MULTIPLIER = 0x9E3779B97F4A7C15


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, between blanks, tabs and line breaks."""
    return (text or "").encode().split()


class _Turn:
    """The symbols at the beginning of a turn: where each starts, how long it is, and how many
    equal ones stand from it on and up to it."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, n: int):
        count = len(symbols)
        self.symbols, self.starts = symbols, starts
        self.sizes = np.diff(starts, append=n)
        self.heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        self.blocks = np.diff(self.heads, append=count)
        place, block = np.arange(count), np.repeat(self.heads, self.blocks)
        self.back = place - block + 1
        self.ahead = np.repeat(self.heads + self.blocks, self.blocks) - place
        self.table = None
        if count * DENSE >= n:
            self.table = np.zeros(n + 1, np.int32)
            self.table[starts] = place
            self.table[n] = count

    def at(self, places: np.ndarray) -> np.ndarray:
        """Which symbol starts at each of the places, all of which start one."""
        return self.table[places] if self.table is not None else np.searchsorted(self.starts, places)


class Grammar:
    """The turns of recompression over whole numbers; those from ``plain`` on occur once each and
    are never joined with others."""

    def __init__(self, symbols: np.ndarray, plain: int):
        self.n = n = len(symbols)
        starts, single = np.arange(n), symbols >= plain
        lone = int(single.sum())
        self.turns, self.top = [], np.zeros(n + 1, np.int16)
        turn = 0
        while True:
            level = _Turn(symbols, starts, n)
            if not self.turns or len(symbols) < len(self.turns[-1].symbols):
                self.top[starts] = self.top[n] = len(self.turns)
                self.turns.append(level)
            if len(symbols) <= 2 * lone:  # a symbol between two separators, at most
                return
            # block compression
            heads, blocks = level.heads, level.blocks
            wide = int(blocks.max()) + 1
            code = symbols[heads] * wide + blocks
            symbols, starts, single = pd.factorize(code)[0].astype(np.int64), starts[heads], single[heads]
            # pair compression
            odd = np.uint64((MULTIPLIER * (2 * turn + 1)) & ((1 << 64) - 1))
            right = (symbols.astype(np.uint64) * odd) >> np.uint64(63) > 0
            free = ~(single[:-1] | single[1:])
            one = free & ~right[:-1] & right[1:]
            other = free & right[:-1] & ~right[1:]
            first = np.flatnonzero(one if one.sum() >= other.sum() else other)
            code = symbols * (len(symbols) + 1)
            code[first] += symbols[first + 1] + 1
            kept = np.ones(len(symbols), bool)
            kept[first + 1] = False
            symbols, starts, single = pd.factorize(code[kept])[0].astype(np.int64), starts[kept], single[kept]
            turn += 1

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` on equal those from ``b`` on."""
        return self._walk(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` equal those before ``b``."""
        return self._walk(a, b, -1)

    def _walk(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        here, apart = a.astype(np.int64), (b - a).astype(np.int64)
        fell: list[np.ndarray] = []  # who met a difference, by turn
        going = np.arange(len(here))
        for number in range(len(self.turns)):
            up, stopped = [], []
            while len(going):
                if number + 1 < len(self.turns):
                    place = here[going]
                    both = np.minimum(self.top[place], self.top[place + apart[going]]) > number
                    up.append(going[both])
                    going = going[~both]
                going, differing = self._step(number, here, apart, going, way)
                stopped.append(differing)
            fell.append(np.concatenate(stopped) if stopped else going)
            going = np.concatenate(up) if up else going[:0]
            if not len(going):
                break
        down = fell[-1][:0]
        for number in range(len(fell) - 1, -1, -1):
            going = down  # those that differ at this turn already need not be looked at again
            stopped = [fell[number]]
            while len(going):
                going, differing = self._step(number, here, apart, going, way)
                stopped.append(differing)
            down = np.concatenate(stopped)
        return np.abs(here - a)

    def _step(
        self, number: int, here: np.ndarray, apart: np.ndarray, going: np.ndarray, way: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Moves those whose symbols are equal over them; (the moved, the others)."""
        turn, place = self.turns[number], here[going]
        one, other = turn.at(place), turn.at(place + apart[going])
        if way < 0:
            one, other = one - 1, other - 1
        same = turn.symbols[one] == turn.symbols[other]
        moved, one, other = going[same], one[same], other[same]
        equal = turn.ahead if way > 0 else turn.back
        here[moved] += way * np.minimum(equal[one], equal[other]) * turn.sizes[one]
        return moved, going[~same]


def runs_of(
    texts: list[np.ndarray], least: int = 12, times: int = 2
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in lists of word numbers, by text, start, period."""
    sizes = np.array([len(x) for x in texts], np.int64)
    nothing = np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")  # longest first: those that can hold a period lead
    order = order[sizes[order] >= max(least, times)]
    if not len(order):
        return nothing, nothing, nothing, nothing
    plain = 1 + max(int(texts[k].max()) for k in order)
    parts = [np.array([plain], np.int64)]
    for place, k in enumerate(order.tolist()):
        parts += [texts[k], np.array([plain + place + 1], np.int64)]
    line = np.concatenate(parts).astype(np.int64)
    own = sizes[order]
    begins = 1 + np.cumsum(own + 1) - (own + 1)
    grammar, words = Grammar(line, plain), line.astype(np.int32 if plain < 1 << 30 else np.int64)
    n = len(line)

    found: list[np.ndarray] = []  # rows of start, end, period
    held: list[tuple[np.ndarray, int]] = []

    def follow() -> None:
        if not held:
            return
        a = np.concatenate([x for x, _ in held])
        q = np.repeat(np.array([p for _, p in held], np.int64), [len(x) for x, _ in held])
        held.clear()
        start = a - grammar.backward(a, a + q)
        end = a + q + grammar.forward(a, a + q)
        good = end - start >= np.maximum(least, times * q)
        found.append(_smallest(np.stack([start[good], end[good], q[good]], axis=1)))
        if sum(map(len, found)) > 5 * QUERIES:
            found[:] = [_smallest(np.concatenate(found))]

    waiting = 0
    for q in range(1, int(own[0]) // times + 1):
        able = int(np.searchsorted(-own, -max(least, times * q), side="right"))
        stop, step = int(begins[able - 1] + own[able - 1]), max((times - 1) * q, least - q, 1)
        equal = np.flatnonzero(words[: stop - q : step] == words[q:stop:step]) * step
        if len(equal):
            held.append((equal, q))
            waiting += len(equal)
            if waiting >= QUERIES:
                follow()
                waiting = 0
    follow()
    every = _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    start, end, period = every.T
    place = np.searchsorted(begins, start, side="right") - 1
    text, start, length = order[place], start - begins[place], end - start
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Each (start, end) once, with its smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
    return rows


RUN_TYPE = "array<struct<start:long,length:long,period:long>>"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = 12, times: int = 2
) -> DataFrame:
    """Per document: the key, n_words, runs (start, length, period; by start, then period) and
    collapsed: its words, joined by one blank, without those that a run holds after its first period.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, words, numbers, total = batch.column("text"), 0, [], _Numbers(), 0
            numbered: list[np.ndarray] = []
            for k in range(batch.num_rows):
                words.append(split_words(texts[k].as_py()))
                numbered.append(np.fromiter(map(numbers.__getitem__, words[-1]), np.int64, len(words[-1])))
                total += len(words[-1])
                if total >= BATCH_WORDS or k + 1 == batch.num_rows:
                    yield _judged(batch.column("id").slice(first, len(words)), words, numbered, least, times)
                    first, words, numbers, numbered, total = k + 1, [], _Numbers(), [], 0

    return rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUN_TYPE}, collapsed string").withColumnRenamed("id", key)


def _judged(
    ids: pa.Array, words: list[list[bytes]], numbered: list[np.ndarray], least: int, times: int
) -> pa.RecordBatch:
    text, start, length, period = runs_of(numbered, least, times)
    ends = np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
    collapsed = []
    for k, own in enumerate(words):
        a, b = ends[k], ends[k + 1]
        if b > a:
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, start[a:b] + period[a:b], 1)
            np.add.at(change, start[a:b] + length[a:b], -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(own))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(x) for x in words], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), runs),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ],
        names=["id", "n_words", "runs", "collapsed"],
    )


def longest(runs: Column) -> Column:
    """The run of the greatest length; of several, that of the smallest start, then period."""
    ranked = F.transform(
        runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    )
    best = F.array_max(ranked)
    return F.when(
        F.size(runs) > 0,
        F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")),
    )


def with_repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One text in ten, by CRC-32 of the key, gets a tail that repeats: its words from a on are
    replaced by a repetition of the first p of them, where a and p follow from that CRC too."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    chosen = F.when(h % 10 == 0, F.filter(F.split(F.col(f"`{text}`").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size("__words")
    a = (F.col("__g") % n).cast("int")
    p = (1 + F.call_function("div", n - a, (3 + F.col("__g") % 8).cast("int"))).cast("int")
    copies = (F.call_function("div", n - a, p) + 1).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("__words", a + 1, p), copies)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice("__words", F.lit(1), a), tail), " ")
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"), g.alias("__g"), chosen.alias("__words"))
    return rows.select(
        F.col(f"`{key}`"), F.when(n > 0, changed).otherwise(F.col(f"`{text}`")).alias(text)
    )
