"""A quality score for whole documents from a small convolutional network over bytes, in numpy.

Bytes become learned vectors; learned filters slide over them; each filter's largest value is taken
in every chunk of 512 bytes, the next chunk starting 256 bytes on, to the end of the document. The
mean and the maximum over all chunks go through one hidden layer to a probability.

The network is fitted on the driver on a bounded sample of labelled documents (``SAMPLE`` for each
label, texts up to ``SAMPLE_BYTES``), drawn by hash of the id, so that a run repeats. The two labels
are drawn alike; the score is then shifted to their shares among all labelled rows. Scoring is a
projection of the documents and needs no shuffle.

Cases: a null text counts as empty, and an empty one has a score like any other; labels that are
null or belong to no document are left out; a label given more than once counts once, the larger
one; without examples of both labels every score is the share of good ones (0.5 without any);
repeated documents keep a row each; an empty table gives an empty result; columns other than the
key and the text are not read, and labels, language and source are never inputs of a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
SAMPLE_BYTES = 32_768
HELD_OUT = 5  # rows whose CRC-32 of the id is divisible by this teach nothing

STEP = 256  # bytes from one chunk to the next; a chunk is two steps long
STRIDE, WIDTH = 2, 6  # bytes between two places of a filter, and bytes that it covers
VECTOR, FILTERS, HIDDEN = 8, 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 32, 0.01, 1e-4, 7
AT_ONCE = 1 << 18  # bytes that are scored together


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % HELD_OUT == 0


def padded(text: bytes) -> np.ndarray:
    """The bytes as numbers from 1, with zeros before and after them, in whole steps.

    A filter that reaches over the end of one document sees zeros, whichever document is next.
    """
    lead = WIDTH - STRIDE
    out = np.zeros(-(-(lead + len(text) + WIDTH) // STEP) * STEP, np.int16)
    out[lead : lead + len(text)] = np.frombuffer(text, np.uint8).astype(np.int16) + 1
    return out


@dataclass
class Network:
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((257, VECTOR), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH * VECTOR, FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    inner: np.ndarray = field(default_factory=lambda: np.zeros((2 * FILTERS, HIDDEN), np.float32))
    inner_bias: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN, np.float32))
    outer: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN, np.float32))
    outer_bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    shift: float = 0.0  # log odds by which the labels' shares differ from the sample's

    @classmethod
    def fresh(cls, seed: int) -> "Network":
        draw = np.random.default_rng(seed)
        new = cls()
        for name in ("vectors", "filters", "inner", "outer"):
            shape = getattr(new, name).shape
            scale = 0.5 if name == "vectors" else np.sqrt(2.0 / shape[0])
            setattr(new, name, (draw.standard_normal(shape) * scale).astype(np.float32))
        return new

    def steps(self, numbers: np.ndarray) -> np.ndarray:
        """The filters' values before pooling: (steps, places in a step, filters)."""
        ahead = np.concatenate([numbers, np.zeros(WIDTH, np.int64)])
        rows = np.lib.stride_tricks.sliding_window_view(self.vectors[ahead].reshape(-1), WIDTH * VECTOR)
        windows = rows[:: STRIDE * VECTOR][: len(numbers) // STRIDE]
        return (windows @ self.filters + self.bias).reshape(-1, STEP // STRIDE, FILTERS)

    def pooled(self, tops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document the mean and maximum over its chunks; the chunks and where they start."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        last = np.zeros(len(tops), bool)
        last[starts + sizes - 1] = True
        follow = np.where(last, np.arange(len(tops)), np.arange(len(tops)) + 1)
        chunks = np.maximum(tops, tops[np.minimum(follow, len(tops) - 1)])
        mean = np.add.reduceat(chunks, starts, axis=0) / sizes[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunks, starts, axis=0)], axis=1), chunks, starts

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum(features @ self.inner + self.inner_bias, 0)
        return hidden @ self.outer + self.outer_bias[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        numbers = [padded(t) for t in texts]
        sizes = np.array([len(n) // STEP for n in numbers])
        whole = np.concatenate(numbers)
        tops = np.concatenate(
            [
                # the places at a part's end look ahead into the next part
                np.maximum(self._tops(whole, at, min(at + AT_ONCE, len(whole))), 0)
                for at in range(0, len(whole), AT_ONCE)
            ]
        )
        odds = self.log_odds(self.pooled(tops, sizes)[0]) + self.shift
        return 1 / (1 + np.exp(-odds.astype(np.float64)))

    def _tops(self, whole: np.ndarray, start: int, end: int) -> np.ndarray:
        extra = min(STEP, len(whole) - end)
        values = self.steps(whole[start : end + extra])
        return values[: (end - start) // STEP].max(axis=1)


class _Adam:
    def __init__(self, network: Network, names: tuple[str, ...]):
        self.network, self.names, self.turn = network, names, 0
        self.first = {n: np.zeros_like(getattr(network, n)) for n in names}
        self.second = {n: np.zeros_like(getattr(network, n)) for n in names}

    def move(self, slopes: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for n in self.names:
            held, slope = getattr(self.network, n), slopes[n]
            self.first[n] += 0.1 * (slope - self.first[n])
            self.second[n] += 0.001 * (slope**2 - self.second[n])
            mean = self.first[n] / (1 - 0.9**self.turn)
            spread = self.second[n] / (1 - 0.999**self.turn)
            held -= (RATE * (mean / (np.sqrt(spread) + 1e-8) + DECAY * held)).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Network:
    """A network for examples of both labels."""
    network = Network.fresh(seed)
    adam = _Adam(network, ("vectors", "filters", "bias", "inner", "inner_bias", "outer", "outer_bias"))
    draw = np.random.default_rng(seed)
    numbers = [padded(t) for t in texts]
    for _ in range(EPOCHS):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            adam.move(_slopes(network, [numbers[i] for i in some], labels[some]))
    return network


def _slopes(network: Network, numbers: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.array([len(n) // STEP for n in numbers])
    whole = np.concatenate(numbers)
    values = network.steps(whole)
    place = values.argmax(axis=1)
    tops = np.maximum(np.take_along_axis(values, place[:, None], axis=1)[:, 0], 0)
    features, chunks, starts = network.pooled(tops, sizes)
    inner = features @ network.inner + network.inner_bias
    hidden = np.maximum(inner, 0)
    odds = hidden @ network.outer + network.outer_bias[0]
    error = ((1 / (1 + np.exp(-odds)) - labels) / len(labels)).astype(np.float32)
    back = np.outer(error, network.outer) * (inner > 0)
    to_features = back @ network.inner.T
    # to the chunks: a share of the mean to each, the maximum's to the chunks that reach it
    document = np.repeat(np.arange(len(sizes)), sizes)
    to_chunks = to_features[document, :FILTERS] / sizes[document][:, None]
    reaching = chunks == features[document, FILTERS:]
    ties = np.add.reduceat(reaching.astype(np.float32), starts, axis=0)
    to_chunks += reaching * (to_features[:, FILTERS:] / ties)[document]
    # to the steps: a chunk is the larger of its step and the next one of the document
    to_steps = np.zeros_like(tops)
    last = np.zeros(len(tops), bool)
    last[starts + sizes - 1] = True
    here = last[:, None] | (tops >= np.roll(tops, -1, axis=0))
    to_steps += to_chunks * here
    to_steps[1:] += (to_chunks * ~here)[:-1]
    to_steps *= tops > 0
    # to the filters: only the place of the maximum counts
    at = (np.arange(len(tops))[:, None] * STEP + place * STRIDE).reshape(-1)
    ahead = np.concatenate([whole, np.zeros(WIDTH, np.int64)])
    which = np.tile(np.arange(FILTERS), len(tops))
    weight = to_steps.reshape(-1)
    to_filters = np.zeros((WIDTH, VECTOR, FILTERS), np.float32)
    to_vectors = np.zeros_like(network.vectors)
    filters = network.filters.reshape(WIDTH, VECTOR, FILTERS)
    for k in range(WIDTH):
        cell = np.bincount(ahead[at + k] * FILTERS + which, weight, 257 * FILTERS)
        cell = cell.reshape(257, FILTERS).astype(np.float32)
        to_filters[k] = network.vectors.T @ cell
        to_vectors += cell @ filters[k].T
    return {
        "vectors": to_vectors,
        "filters": to_filters.reshape(WIDTH * VECTOR, FILTERS),
        "bias": to_steps.sum(axis=0),
        "inner": features.T @ back,
        "inner_bias": back.sum(axis=0),
        "outer": hidden.T @ error,
        "outer_bias": error.sum(keepdims=True),
    }


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> Network:
    """A network from the labelled rows that are not held out."""
    known = (
        labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = (F.xxhash64("id", F.lit(SEED)), F.col("id"))
    texts = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    ).where(F.octet_length("text") <= SAMPLE_BYTES)
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        one = float(np.mean(list(shares))) if shares else 0.5
        return Network(shift=float(np.log((one + 0.01) / (1.01 - one))))
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 31))
    drawn = []
    for value in (0, 1):  # among four times as many as are wanted, so that tasks sort few
        share = min(1.0, 4 * SAMPLE / shares[value])
        pool = known.where((F.col("label") == value) & (place < int(share * (1 << 31))))
        drawn.append(pool.orderBy(*order).limit(SAMPLE))
    wanted = drawn[0].unionByName(drawn[1])  # 2 * SAMPLE rows at most
    # one text for each id, so that an id of many rows is not collected as often
    rows = texts.join(F.broadcast(wanted), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    chosen = sorted(rows.collect(), key=lambda r: r["id"])
    y = np.array([r["label"] for r in chosen], np.float32)
    odds = np.log(shares[1] / shares[0])
    if not 0 < y.sum() < len(y):
        return Network(shift=float(odds))
    network = fit([r["text"].encode() for r in chosen], y)
    network.shift = float(odds - np.log(y.sum() / (len(y) - y.sum())))
    return network


def scored(
    docs: DataFrame, network: Network, threshold: float = 0.3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: its key, held_out, score (higher: better) and predicted (score >= threshold)."""
    rows = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            at, held, size = 0, [], 0
            for k in range(batch.num_rows):
                held.append(texts[k].as_py().encode())
                size += len(held[-1])
                if size >= AT_ONCE or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(held)), pa.array(network.scores(held))], names=["id", "score"]
                    )
                    at, held, size = k + 1, [], 0

    return rows.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(key),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def passing(docs: DataFrame, network: Network, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of the documents that score ``threshold`` or more."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            start, held, size = 0, [], 0
            for k in range(batch.num_rows):
                held.append((texts[k].as_py() or "").encode())
                size += len(held[-1])
                if size >= AT_ONCE or k + 1 == batch.num_rows:
                    keep = pa.array(network.scores(held) >= threshold)
                    yield batch.slice(start, len(held)).filter(keep)
                    start, held, size = k + 1, [], 0

    return docs.mapInArrow(run, docs.schema)
