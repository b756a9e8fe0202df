"""Runs by grammar against runs found by comparing all words of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from tests.llm.cases import AWKWARD, FOLDER, awkward, by_id, nothing, sample
from tradeweave.llm import periodic_runs
from tradeweave.llm.queries import op12_recompression


def plain_runs(words, least=12):
    """(start, length, period), from every period by itself."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def changed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_numbers_against_all_periods():
    draw = random.Random(1)

    def some():
        n, k = draw.choice([0, 3, 11, 12, 13, 30, 100, 300]), draw.choice([1, 2, 2, 3, 5, 50])
        words = [draw.randrange(k) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + draw.randrange(max(1, (n - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        return words + [draw.randrange(k) for _ in range(draw.choice([0, 20]))]

    old, new = [0], [0, 1]
    while len(new) < 2000:
        old, new = new, new + old  # many runs in runs
    for texts in [[some() for _ in range(draw.randrange(1, 12))] for _ in range(60)] + [[new], [[7] * 3000, new[:500]]]:
        rows = zip(*(x.tolist() for x in periodic_runs.runs_of([np.array(t, np.int64) for t in texts])))
        expected = [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]
        assert list(rows) == expected


def test_equal_stretches_by_the_grammar():
    draw = np.random.default_rng(2)
    line = np.concatenate([[100], np.tile(draw.integers(0, 3, 40), 20), draw.integers(0, 2, 300), [101]])
    grammar = periodic_runs.Grammar(line, 100)
    a = draw.integers(1, len(line) - 2, 2000)
    b = draw.integers(1, len(line) - 2, 2000)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    for x, y, ahead, back in zip(a, b, grammar.forward(a, b), grammar.backward(a, b), strict=True):
        k = 0
        while line[x + k] == line[y + k]:
            k += 1
        assert ahead == k
        k = 0
        while line[x - 1 - k] == line[y - 1 - k]:
            k += 1
        assert back == k


def check(row, words):
    runs = plain_runs(words)
    assert row["n_runs"] == len(runs)
    assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
    assert row["collapsed_sha256"] == sha(collapsed(words, runs))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    exponent = best and 1000 * best[1] // best[2]
    found = row["start"], row["length"], row["period"], row["exponent_milli"]
    assert found == ((*best, exponent) if best else (None,) * 4)


def test_whole_table(spark):
    found = by_id(op12_recompression(spark, FOLDER))
    texts = sample()
    assert len(found) == len(texts) and any(r["n_runs"] for r in found.values())
    for doc_id, text in texts:
        words = changed(doc_id, split(text))
        if len(words) <= 2500:  # the plain way is quadratic
            check(found[doc_id], words)
        else:
            assert found[doc_id]["n_runs"] > 0 or zlib.crc32(str(doc_id).encode()) % 10


def test_awkward_rows(spark):
    docs = awkward(spark, clashing=True)
    rows = periodic_runs.find_runs(docs).collect()
    assert len(rows) == len(AWKWARD) + 1
    for r in rows:
        words = split(AWKWARD[r["doc_id"]])
        assert r["n_words"] == len(words)
        if len(words) < 3000:
            runs = plain_runs(words)
            assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapsed(words, runs)
        else:
            assert [tuple(x) for x in r["runs"]] == [(0, len(words), 5)] and len(split(r["collapsed"])) == 5
    tails = by_id(periodic_runs.with_repeated_tails(docs))
    for k, text in enumerate(AWKWARD):
        assert split(tails[k]["text"]) == changed(k, split(text))
    assert periodic_runs.find_runs(nothing(spark)).collect() == []
    null = periodic_runs.with_repeated_tails(docs.selectExpr("CAST(NULL AS long) AS doc_id", "text"))
    assert sorted(r["text"] or "" for r in null.collect()) == sorted(t or "" for t in [*AWKWARD, AWKWARD[-1]])


def test_texts_of_many_batches(spark):
    rows = [(k, " ".join("ab"[(k * i * i) % 7 % 2] for i in range(3000))) for k in range(150)]
    found = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for r in found[::10]:
        assert [tuple(x) for x in r["runs"]] == plain_runs(split(dict(rows)[r["doc_id"]]))
