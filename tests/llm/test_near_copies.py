"""Near copies against brute force over all pairs, and planted ones."""

import random
import re

import numpy as np

import corpus_pipeline
from tests.llm.cases import FOLDER, TYPES, awkward, nothing, texts
from tradeweave.llm import near_copies, simhash
from tradeweave.plans import bloom


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """The number of the first text that each one is linked to, directly or by others."""
    sets, up = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(texts))]


def kept(df):
    return sorted(r["doc_id"] for r in near_copies.without_near_copies(df).collect())


def planted():
    """Prose, and copies of it with a few words changed, down to half of the shingles."""
    draw = random.Random(8)
    texts = []
    for _ in range(30):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(40, 400))]
        texts.append(" ".join(words))
        for part in (0.005, 0.02, 0.025, 0.03, 0.06):
            copy = list(words)
            for at in draw.sample(range(len(copy)), max(1, int(part * len(copy)))):
                copy[at] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


def test_planted_near_copies(spark):
    texts = planted()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], TYPES)
    groups = plain_groups(texts)
    assert kept(df) == sorted(set(groups))
    narrow = {r["doc_id"] for r in simhash.without_near_duplicates(df).collect()}
    assert len(set(groups)) < len(narrow)  # near copies that the rule of op3 leaves


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """More texts in a band than are compared at first, in a chain, so that it takes several turns."""
    monkeypatch.setattr(near_copies, "PIVOTS", 1)
    monkeypatch.setattr(near_copies, "MORE", 2)
    draw = random.Random(9)
    words, texts = [f"w{k}" for k in range(200)], []
    for n in range(60):
        words[draw.randrange(200)] = f"new{n}"
        texts.append(" ".join(words))
    texts += [" ".join(words[:60] + [f"{n} {k}" for k in range(140)]) for n in range(20)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], TYPES)
    assert kept(df) == sorted(set(plain_groups(texts)))


def test_null_and_repeated_keys(spark):
    text, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    rows = [(None, text), (None, text), (5, text + " end"), (5, other), (7, other), (None, "alone"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], TYPES)
    found = [(r["doc_id"], r["text"]) for r in near_copies.without_near_copies(df).collect()]
    assert sorted(found, key=str) == sorted([(5, text + " end"), (5, other), (None, "alone"), (8, "")], key=str)


def test_awkward_rows(spark):
    df = awkward(spark, clashing=True)
    found = near_copies.without_near_copies(df)
    assert found.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(plain_groups([texts[k] for k in sorted(texts)])))
    assert near_copies.without_near_copies(nothing(spark)).collect() == []


def test_stage_over_the_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = texts()
    keys = sorted(found)
    expected = {keys[k] for k in plain_groups([found[k] for k in keys])}
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, FOLDER).collect()} == expected


def test_a_crowd_that_shares_a_passage(spark, monkeypatch):
    """Texts with 0.6 of their shingles in common are told apart with few comparisons each, and the near
    copies among them are found."""
    draw = random.Random(4)
    passage = [f"p{k}" for k in range(150)]
    rows, pairs = [], 0
    for k in range(400):
        own = [f"o{draw.randrange(10**6)}" for _ in range(50)]
        rows.append(" ".join(passage + own))
        if k % 10 == 0:  # one word in the middle of its own part: 0.95 of the shingles stay
            rows.append(" ".join([*passage, *own[:25], "changed", *own[26:]]))
            pairs += 1
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], TYPES)
    compared = []
    plain = near_copies._pairs

    def noted(crowd, done, pivots):
        found = plain(crowd, done, pivots).persist()
        compared.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "_pairs", noted)
    left = near_copies.without_near_copies(df).count()
    assert len(rows) - pairs <= left <= len(rows) - 0.9 * pairs
    assert sum(compared) < 50 * len(rows), compared


def at_the_threshold(pairs):
    """Pairs that share just 0.8 of their shingles, among texts that all share 0.75 with each other."""
    draw = random.Random(12)
    passage, rows = [f"p{k}" for k in range(172)], []
    for _ in range(pairs):
        own = [f"o{draw.randrange(10**6)}" for _ in range(28)]
        other = [f"c{draw.randrange(10**6)}" if k in (4, 9, 14, 19, 27) else w for k, w in enumerate(own)]
        rows += [" ".join(passage + own), " ".join(passage + other)]
    return rows


def test_no_link_is_lost_in_a_crowd(spark, monkeypatch):
    """Near copies at the threshold in a crowd that shares nearly as much are all found, with few comparisons."""
    rows = at_the_threshold(300)
    groups = plain_groups(rows)
    assert groups == [k // 2 * 2 for k in range(len(rows))]
    compared = []
    plain = near_copies._verified

    def noted(pairs, texts):
        compared.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(near_copies, "_verified", noted)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], TYPES)
    assert kept(df) == sorted(set(groups))
    assert sum(compared) < 5 * len(rows), compared


def test_similar_sets_share_first_shingles():
    """Whatever shingles are common, similar sets share as many first ones as ``_counted`` asks for."""
    draw = np.random.default_rng(5)
    common = draw.integers(0, 256, near_copies.COUNTERS // 8, np.uint8)
    similar = 0
    for _ in range(2000):
        whole = np.unique(draw.integers(0, 1 << 64, draw.integers(1, 300), np.uint64))
        a, b = (whole[draw.random(len(whole)) >= draw.choice([0, 0.05, 0.1, 0.2])] for _ in range(2))
        if not len(a) or not len(b) or not near_copies.similar(a, b):
            continue
        similar += 1
        first = [near_copies.first_ones(x, common) for x in (a, b)]
        both = set(first[0].tolist()) & set(first[1].tolist())
        least = -(-4 * (len(a) + len(b)) // 9)
        assert len(both) >= least - max(len(x) - len(f) for x, f in zip((a, b), first))
        short = first[len(a) > len(b)]
        assert both & set(short[: min(len(a), len(b)) // 9 + 1].tolist())
    assert similar > 300


def test_groups_of_fingerprints_are_candidates(spark, monkeypatch):
    """Copies whose fingerprints link them are found by these alone; a group that is not similar is no link."""
    draw = random.Random(6)
    rows = []
    for _ in range(20):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        rows += [" ".join(words), " ".join([*words, "end"])]
    few = [f"r{k}" for k in range(5)]
    rows += [" ".join(few * 60), " ".join(few * 60 + [f"s{k}" for k in range(6)])]  # nearly one fingerprint, sets far apart
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], TYPES)
    assert kept(df) == sorted(set(plain_groups(rows)))
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    linked = [i for i, t in enumerate(rows[:40]) if groups[i] != i]
    assert linked and groups[41] == 40
    monkeypatch.setattr(near_copies, "_pairs", lambda crowd, done, pivots: crowd.select("node", "root").toDF("a", "b").limit(0))
    left = kept(df)
    assert not set(linked) & set(left) and {40, 41} <= set(left)


def test_only_texts_of_candidates_are_shuffled(spark, monkeypatch):
    """Texts that share no band and no group stay where they are; what comes back has a row of each kept text."""
    draw = random.Random(3)
    rows = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    rows += [text + " end" for text in rows[:5]] + [rows[9]]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], TYPES)
    passed = []
    plain = near_copies.likely

    def noted(found, name, keys):
        left = plain(found, name, keys)
        if "text" in left.columns:
            passed.append(left.count())
        return left

    monkeypatch.setattr(near_copies, "likely", noted)
    assert kept(df) == list(range(300))
    assert passed and max(passed) <= 20, passed


def test_a_filter_loses_no_key(spark):
    rows = spark.range(5000).selectExpr("nullif(id, 7) AS id", "id AS other")
    keys = spark.range(0, 5000, 10).selectExpr("id * 3 AS id")
    for bits in (64, 1 << 25):
        found = {r["id"] for r in bloom.likely(rows, "id", keys, bits).collect()}
        assert set(range(0, 5000, 30)) <= found
    assert len(found) < 200 and bloom.likely(rows, "id", keys.limit(0)).count() == 0
