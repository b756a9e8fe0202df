"""Fingerprints, BK-trees and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.cases import FOLDER, awkward, by_id, nothing, texts
from tradeweave.llm import links, simhash
from tradeweave.llm.queries import op3_simhash


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    """{key: smallest key reachable} of {key: fingerprint}."""
    keys, up = sorted(values), {k: k for k in values}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_whole_table(spark):
    found = by_id(op3_simhash(spark, FOLDER))
    values = {k: plain_fingerprint(t) for k, t in texts().items()}
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{v:016x}" for k, v in values.items()}
    assert {k: r["component_id"] for k, r in found.items()} == plain_components(values, 2)


def test_awkward_rows(spark):
    df = awkward(spark, clashing=True)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    values = {r["doc_id"]: plain_fingerprint(r["text"]) for r in df.collect()}
    expected = plain_components(values, 2)
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert simhash.near_duplicates(nothing(spark)).collect() == []
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def near_values(n, seed):
    """Clouds of fingerprints a few bits from their centres."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    found = set()
    while len(found) < n:
        value = draw.choice(centres)
        for _ in range(draw.randint(0, 5)):
            value ^= 1 << draw.randrange(64)
        found.add(value)
    return sorted(found)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_joins_what_is_near(radius):
    values = near_values(300, radius)
    links_found = simhash.tree_links(np.array(values, np.uint64), radius)
    assert len(links_found) < len(values)
    expected = plain_components({v: v for v in values}, radius)
    root = {v: v for v in values} | dict(links_found)
    assert root == expected


@pytest.mark.parametrize("crowded", [4096, 16])
def test_shards_find_every_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)  # 16: crowded shards are dealt again
    values = near_values(400, 9)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in links.components(simhash.near_links(df, 2)).collect()}
    groups = {}
    for v in signed:
        groups.setdefault(roots.get(v, v), set()).add(v % (1 << 64))
    expected = {}
    for v, top in plain_components({v: v for v in values}, 2).items():
        expected.setdefault(top, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*chain, *hub, (5, 5), (7, 6), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in links.components(df).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert links.components(df.limit(0)).collect() == []
