"""License texts inside documents: MinHash bands over overlapping windows, verified exactly.

Words are taken five at a time (shingles). A template of m shingles is sought in windows of 2 L
shingles, each starting L after the last, with L a power of two between 1.25 m and 2.5 m (2 at
least), so one window holds any occurrence whole. A window's MinHash is one minimum for each of
``BANDS`` permutations, and each is a band of its own: a window that shares 0.8 of a template has a
resemblance of 0.15 at least, and some band agrees with probability 1 - 0.85^64 = 0.99997; for a
verbatim copy it is 1 - 0.8^64 or better.

Minima of neighbouring blocks give those of the blocks twice as long, so all window sizes together
cost little more than the smallest. A template that a band retrieves counts only if the window
really holds ``SHARE`` of its distinct shingles, compared as words.

Texts are read as one stream per batch, in slabs that overlap by the longest window; the templates
are sent to every task, which their callers must bound. Nothing is shuffled.

Cases: a null text counts as empty and has no match; a template of fewer than five words is one
shingle, one without words is never found; equal templates under two names are both found; repeated
documents keep a row each; an empty table gives an empty result; columns other than the key and
the text are not read.
"""

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.llm.contamination import split_words

SHINGLE = 5
BANDS = 64
SHARE = 0.8
SLAB = 16_384  # places whose minima are held at a time
SEED = 5
WORDS_AT_ONCE = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = xxhash.xxh32_intdigest(word)
        return number


def _mixed(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


class Template:
    def __init__(self, number: int, name: str, text: str):
        self.number, self.name, self.words = number, name, split_words(text)
        self.size = min(SHINGLE, len(self.words))
        n = len(self.words) - self.size + 1 if self.words else 0
        self.shingles = {tuple(self.words[i : i + self.size]) for i in range(n)}
        self.length = 2
        while self.length < 1.25 * n:
            self.length *= 2


class Scanner:
    """Templates with their band values, by shingle size and window length."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        every = [Template(i, name, text) for i, (name, text) in enumerate(templates)]
        self.templates = [t for t in every if t.words]
        draw = np.random.default_rng(SEED)
        self.factor = draw.integers(0, 1 << 32, BANDS, np.uint64).astype(np.uint32) | np.uint32(1)
        self.offset = draw.integers(0, 1 << 32, BANDS, np.uint64).astype(np.uint32)
        self.groups: dict[int, dict[int, list[tuple[Template, np.ndarray]]]] = defaultdict(
            lambda: defaultdict(list)
        )
        hashes = _Hashes()
        for t in self.templates:
            words = np.array([hashes[w] for w in t.words], np.uint32)
            bands = self.permuted(_mixed(words, t.size)).min(axis=1)
            self.groups[t.size][t.length].append((t, bands))

    def permuted(self, hashes: np.ndarray) -> np.ndarray:
        return hashes[None, :] * self.factor[:, None] + self.offset[:, None]

    def retrieved(self, words: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, start, end): windows of the stream whose bands agree with a template's."""
        found = set()
        for size, lengths in self.groups.items():
            hashes, most = _mixed(words, size), max(lengths)
            for at in range(0, max(1, len(hashes)), SLAB):
                slab = hashes[at : at + SLAB + 2 * most]
                if not len(slab):
                    continue
                least, length = self.permuted(slab), 1
                while length < most:
                    if least.shape[1] % 2:
                        least = np.pad(least, ((0, 0), (0, 1)), mode="edge")
                    least, length = np.minimum(least[:, ::2], least[:, 1::2]), 2 * length
                    if length not in lengths:
                        continue
                    # a window is two blocks; the last block may stand alone
                    window = np.minimum(least, np.concatenate([least[:, 1:], least[:, -1:]], axis=1))
                    for template, bands in lengths[length]:
                        for k in np.flatnonzero((window == bands[:, None]).any(axis=0)).tolist():
                            start = at + k * length
                            found.add((template.number, start, start + 2 * length + size - 1))
        return found

    def matches(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its matches: license, first and last + 1 word, share of the shingles."""
        hashes, stream = _Hashes(), [split_words(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in stream])])
        flat = [w for words in stream for w in words]
        numbers = np.fromiter(map(hashes.__getitem__, flat), np.uint32, len(flat))
        by_number = {t.number: t for t in self.templates}
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        seen = set()
        for number, start, end in sorted(self.retrieved(numbers)):
            template = by_number[number]
            first = int(np.searchsorted(starts, start, side="right")) - 1
            last = int(np.searchsorted(starts, min(end, len(flat)) - 1, side="right")) - 1
            for text in range(first, last + 1):  # a window may run over several texts
                low = max(start, int(starts[text]))
                span = verified(template, flat[low : min(end, int(starts[text + 1]))])
                if span:
                    own = low - int(starts[text])
                    row = (number, text, own + span[0], own + span[1])
                    if row not in seen:
                        seen.add(row)
                        out[text].append((template.name, row[2], row[3], span[2]))
        return [_widest(m) for m in out]


def verified(template: Template, words: list[bytes]) -> tuple[int, int, float] | None:
    """The stretch of words from the template's first to last shingle among them, and the share of
    its distinct shingles that stand there; None below SHARE."""
    size = template.size
    at = [
        i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in template.shingles
    ]
    share = len({tuple(words[i : i + size]) for i in at}) / len(template.shingles)
    return (at[0], at[-1] + size, share) if share >= SHARE else None


def _widest(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """One row for overlapping stretches of one license: the union, with the largest share."""
    out: list[tuple[str, int, int, float]] = []
    for name, start, end, share in sorted(found):
        if out and out[-1][0] == name and start < out[-1][2]:
            out[-1] = (name, out[-1][1], max(end, out[-1][2]), max(share, out[-1][3]))
        else:
            out.append((name, start, end, share))
    return sorted(out, key=lambda m: (m[1], m[0]))


MATCHES = pa.list_(
    pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
)


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: its key, n_matches, licenses (names, sorted, joined by commas) and matches
    (license, start and end in words, share of the template's shingles found)."""
    rows = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    templates = list(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            start, size = 0, 0
            for k, own in enumerate(texts):
                size += len(own)
                if size >= 5 * WORDS_AT_ONCE or k + 1 == len(texts):
                    found = scanner.matches(texts[start : k + 1])
                    rows_of = [[dict(zip(("license", "start", "end", "share"), m, strict=True)) for m in x] for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, k + 1 - start), pa.array(rows_of, MATCHES)], names=["id", "matches"]
                    )
                    start, size = k + 1, 0

    found = rows.mapInArrow(
        run, f"id {kind}, matches array<struct<license:string,start:long,end:long,share:double>>"
    )
    return found.select(
        F.col("id").alias(key),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        "matches",
    )
