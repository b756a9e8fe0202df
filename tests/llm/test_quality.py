"""The byte network: slopes, whole texts, held-out accuracy."""

import zlib

import numpy as np

from tests.llm.cases import AWKWARD, TYPES, awkward, by_id, nothing
from tradeweave.llm import quality
from tradeweave.llm.queries import op8_byte_network

LARGER = "/root/testdata/sf0.01"


def loss(network, numbers, labels):
    sizes = np.array([len(n) // quality.STEP for n in numbers])
    tops = np.maximum(network.steps(np.concatenate(numbers)).max(axis=1), 0)
    odds = network.log_odds(network.pooled(tops, sizes)[0])
    return float(np.mean(np.log1p(np.exp(-np.where(labels > 0, odds, -odds)))))


def test_slopes_match_differences():
    texts = [b"some text " * 60, b"other", b"JUNK!! " * 90]
    numbers, labels = [quality.padded(t) for t in texts], np.array([1, 0, 1], np.float32)
    network = quality.Network.fresh(3)
    for name in ("vectors", "filters", "bias", "inner", "inner_bias", "outer", "outer_bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    slopes = quality._slopes(network, numbers, labels)
    draw = np.random.default_rng(0)
    for name, slope in slopes.items():
        held = getattr(network, name).reshape(-1)
        likely = np.flatnonzero(np.abs(slope.reshape(-1)) > 1e-4)
        for i in draw.choice(likely, min(5, len(likely)), replace=False):
            before, h = held[i], 1e-6
            held[i] = before + h
            up = loss(network, numbers, labels)
            held[i] = before - h
            down = loss(network, numbers, labels)
            held[i] = before
            assert np.isclose((up - down) / (2 * h), slope.reshape(-1)[i], rtol=0.02, atol=1e-5), name


def plain_score(network, text):
    """The network a byte, a filter and a chunk at a time."""
    lead = quality.WIDTH - quality.STRIDE
    numbers = [0] * lead + [b + 1 for b in text] + [0] * quality.WIDTH
    numbers += [0] * (-len(numbers) % quality.STEP)
    tops = []
    for step in range(0, len(numbers), quality.STEP):
        best = [0.0] * quality.FILTERS
        for place in range(step, step + quality.STEP, quality.STRIDE):
            seen = [numbers[place + k] if place + k < len(numbers) else 0 for k in range(quality.WIDTH)]
            for f in range(quality.FILTERS):
                value = float(network.bias[f])
                for k, number in enumerate(seen):
                    for v in range(quality.VECTOR):
                        value += float(network.vectors[number][v]) * float(network.filters[k * quality.VECTOR + v][f])
                best[f] = max(best[f], value)
        tops.append(best)
    chunks = [[max(pair) for pair in zip(a, b)] for a, b in zip(tops, tops[1:] + tops[-1:])]
    means = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)]
    features = means + [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    odds = float(network.outer_bias[0]) + network.shift
    for h in range(quality.HIDDEN):
        inner = float(network.inner_bias[h]) + sum(x * float(network.inner[i][h]) for i, x in enumerate(features))
        odds += max(inner, 0.0) * float(network.outer[h])
    return 1 / (1 + np.exp(-odds))


def test_scores_against_plain_loops():
    network = quality.Network.fresh(5)
    network.shift = 0.3
    texts = [b"", b"q", "näïve text, with 日本語".encode(), b"some words " * 30, b"x" * 511]
    assert np.allclose(network.scores(texts), [plain_score(network, t) for t in texts], atol=1e-5)


def test_an_id_of_many_rows_is_collected_once(spark):
    docs = spark.createDataFrame([(k % 3 + 1, f"text {k}", None, None, None) for k in range(300)], TYPES)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    few = docs.groupBy("doc_id").agg({"text": "min"}).withColumnRenamed("min(text)", "text")
    a, b = (quality.train(df, labels).scores([b"text 5", b"other"]) for df in (docs, few))
    assert (a == b).all()


def test_every_part_of_a_text_counts(monkeypatch):
    network = quality.Network.fresh(3)
    texts = [b"abc " * 5000, b"abc " * 4990 + b"XYZ!" * 10, b"", b"q"]
    scores = network.scores(texts)
    assert scores[0] != scores[1] and np.isfinite(scores).all()
    # the same alone, together, and in small parts
    assert np.allclose(scores, [network.scores([t])[0] for t in texts], atol=1e-6)
    monkeypatch.setattr(quality, "AT_ONCE", 1024)
    assert np.allclose(scores, network.scores(texts), atol=1e-6)


def test_held_out_accuracy(spark):
    rows = by_id(op8_byte_network(spark, LARGER))
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    right = [r["predicted"] == quality_label for r, quality_label in held]
    assert np.mean(right) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert np.mean([r["predicted"] for r, label in held if label == 1]) > 0.97


def test_awkward_rows(spark):
    df = awkward(spark, clashing=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(3, None), (None, 1)], "doc_id long, quality int")
    network = quality.train(df, labels)
    rows = quality.scored(df, network).collect()
    assert len(rows) == len(AWKWARD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(nothing(spark), network).collect() == []
    kept = quality.passing(df, network)
    good = [r["doc_id"] for r in rows if r["predicted"]]
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(good)
    one_sided = quality.train(df, labels.where("quality = 1"))
    assert {round(r["score"], 2) for r in quality.scored(df, one_sided).collect()} == {0.99}
    nobody = quality.train(df, labels.limit(0))
    assert {round(r["score"], 2) for r in quality.scored(df, nobody).collect()} == {0.5}
