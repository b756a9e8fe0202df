"""The dual-tree search against scores of all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import AWKWARD, FOLDER, PASSAGE, awkward, nothing, sample
from tradeweave.llm import ranked_search
from tradeweave.llm.queries import op11_dual_tree

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plainly(docs, items, k):
    """(item key, rank, document key, score), sorted."""
    split = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in split)
    total = sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for d, c in split:
            m = 100 - 90 + 90 * sum(c.values()) * n // total if total else 0
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    expected = plainly(sample(), sample("benchmark", "item_id, text"), 10)
    found = op11_dual_tree(spark, FOLDER)
    assert rows(found.select("item_id", "rank", "doc_id", "score")) == expected and len(expected) > 300


ITEMS = [(1, "word"), (2, None), (3, ""), (4, "nowhere found"), (5, PASSAGE), (5, PASSAGE), (None, "long words 10"), (7, "日本語 naïve")]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS score", "1 AS rank")


def test_awkward_rows(spark, items):
    docs = awkward(spark, clashing=True)
    docs = docs.unionByName(docs.selectExpr("CAST(NULL AS long) AS doc_id", "* EXCEPT (doc_id)"))
    known = [(d, AWKWARD[k]) for k in range(len(AWKWARD)) for d in (k, None)] + [(len(AWKWARD) - 1, AWKWARD[-1]), (None, AWKWARD[-1])]
    for k in (1, 3, 50):
        expected = plainly(known, ITEMS, k)
        for part_bytes in (1 << 20, 40):  # all items at once, and a few at a time
            found = ranked_search.top_documents(docs, items, k, part_bytes=part_bytes)
            assert found.columns == ["item_id", "rank", "doc_id", "score"] and rows(found) == expected


def test_empty_tables(spark, items):
    empty = nothing(spark)
    for docs, asked in ((empty, items), (awkward(spark), items.limit(0)), (awkward(spark), items.where("item_id IN (2, 3)"))):
        assert ranked_search.top_documents(docs, asked).collect() == []


def test_batches_are_left_out():
    """Bounds are never under a score, and most pairs of a sharp search are never scored."""
    draw = np.random.default_rng(4)
    count, docs = 600, 4096  # 20 subjects of 30 terms
    own = [np.unique(30 * draw.integers(0, 20) + draw.integers(0, 30, 15)) for _ in range(docs)]
    ends = np.cumsum([len(x) for x in own])
    tf = draw.integers(1, 4, int(ends[-1]))
    row = {
        "keys": list(range(docs)),
        "lengths": [60] * docs,
        "ends": ends.tolist(),
        "terms": np.concatenate(own).astype("<i4").tobytes(),
        "counts": tf.astype("<i4").tobytes(),
    }
    df = np.bincount(np.concatenate(own), minlength=count)
    weights = np.array([ranked_search.weight(docs, int(x)) for x in df])
    asked = [np.unique(30 * (k % 20) + draw.integers(0, 30, 12)) for k in range(20)]
    block = ranked_search._Block(row, docs, 60 * docs, weights)
    items = ranked_search._Items(asked, weights, df)
    search = ranked_search._Search(items, 5, np.ones(20, np.int64))
    scored = []
    plain = block.scores
    block.scores = lambda leaves, weight_of: scored.append(len(leaves)) or plain(leaves, weight_of)
    search.block(block)
    leaves = block.levels[0].size
    assert sum(scored) < 0.2 * leaves * len(asked)
    for at, terms_of in enumerate(items.terms):
        weight_of = np.zeros(count, np.int64)
        weight_of[terms_of] = weights[terms_of]
        found, exact = plain(np.arange(leaves), weight_of)
        best = sorted((-s, False, block.keys[d]) for s, d in zip(exact.tolist(), found.tolist()) if s)[:5]
        assert search.best[at] == best
        below = np.maximum.reduceat(exact, np.arange(0, docs, ranked_search.LEAF))
        for level in block.levels:
            assert (level.bounds(terms_of, weights) >= below).all()
            below = np.maximum.reduceat(below, np.arange(0, len(below), ranked_search.FAN))
