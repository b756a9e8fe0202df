"""License scans, contamination, personal data and top-k against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.cases import AWKWARD, FOLDER, PASSAGE, awkward, by_id, nothing, sample, texts
from tradeweave.llm import bit_slices, contamination, licenses, personal
from tradeweave.llm.license_texts import TEMPLATES
from tradeweave.llm.queries import (
    op5_license_scan,
    op7_bit_slices,
    op9_skip_chain,
    op10_positional_index,
)

# --- licenses


def plain_licenses(text):
    words, found = contamination.split_words(text), set()
    for template in (licenses.Template(i, n, t) for i, (n, t) in enumerate(TEMPLATES)):
        at = [
            (k, tuple(words[k : k + template.size]))
            for k in range(len(words) - template.size + 1)
            if tuple(words[k : k + template.size]) in template.shingles
        ]
        for first, _ in at:
            near = {s for k, s in at if first <= k < first + template.length}
            if len(near) >= licenses.SHARE * len(template.shingles):
                found.add(template.name)
    return ",".join(sorted(found))


def test_licenses_of_the_table(spark):
    found = by_id(op5_license_scan(spark, FOLDER))
    assert {k: r["licenses"] for k, r in found.items()} == {k: plain_licenses(t) for k, t in texts().items()}


def test_licenses_of_awkward_rows(spark):
    rows = licenses.scan(awkward(spark, clashing=True), TEMPLATES).collect()
    assert len(rows) == len(AWKWARD) + 1
    assert all(r["licenses"] == plain_licenses(AWKWARD[r["doc_id"]]) for r in rows)
    assert licenses.scan(nothing(spark), TEMPLATES).collect() == []


def test_planted_and_edited_licenses():
    scanner, draw = licenses.Scanner(TEMPLATES), random.Random(4)
    noise = [f"w{k}" for k in range(300)]
    for name, text in TEMPLATES:
        words = text.split()
        if len(words) > 40:  # one word in 60 changed leaves over 0.8 of the shingles
            for k in range(20, len(words), 60):
                words[k] = "changed"
        before, after = (" ".join(draw.choices(noise, k=draw.randint(0, 500))) for _ in range(2))
        found = scanner.matches([f"{before} {' '.join(words)} {after}", before])
        assert name in {m[0] for m in found[0]} and found[1] == []


# --- contamination


def plain_words(text):
    return re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    )


def plain_hits(docs, items):
    sought = {}
    for item, text in items:
        words = plain_words(text)
        for window in contamination.windows(words, 13):
            sought.setdefault(window, set()).add(str(item))
    out = {}
    for key, text in docs.items():
        words, hit, found = plain_words(text), set(), set()
        for size in {len(w) for w in sought}:
            for k in range(len(words) - size + 1):
                if own := sought.get(tuple(words[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[key] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def hits(df):
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_contamination_of_the_table(spark):
    expected = plain_hits(texts(), sample("benchmark", "item_id, text"))
    assert any(x[4] for x in expected.values())
    assert hits(op10_positional_index(spark, FOLDER)) == expected


@pytest.mark.parametrize("part", [1 << 20, 60])
def test_contamination_of_awkward_rows(spark, monkeypatch, part):
    monkeypatch.setattr(contamination, "PART_BYTES", part)  # 60: several parts, all terms stored
    monkeypatch.setattr(contamination, "SEGMENT_WORDS", 300)
    items = [(1, PASSAGE), (2, "two WORDS"), (3, None), (4, ""), (5, "don't"), (6, PASSAGE), (10, "a word")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    df = awkward(spark, clashing=True)
    found = contamination.contaminated(df, tests)
    assert found.count() == len(AWKWARD) + 1
    assert hits(found) == plain_hits(dict(enumerate(AWKWARD)), items)
    assert contamination.contaminated(nothing(spark), tests).collect() == []
    assert {x[1] for x in hits(contamination.contaminated(df, tests.limit(0))).values()} == {0}
    kept = contamination.without_contaminated(df, tests)
    clean = [r["doc_id"] for r in found.collect() if not r["contaminated"]]
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)


def test_proximity(spark):
    docs = {1: "one two three four five", 2: "five x x x x x one", 3: "one", 4: "five one"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    index = contamination.build_index(df)
    found = {r["id"] for r in contamination.proximity(index, ["One", "FIVE"], 4).collect()}
    assert found == {1, 4}
    assert contamination.proximity(index, ["one", "absent"], 4).collect() == []


# --- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    def luhn(number):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(number))]
        return sum(sum(divmod(d, 10)) for d in doubled) % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    found += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(CARD, text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_spans_of_random_texts():
    draw = random.Random(5)
    parts = [*"ab.@-+ 01234567890.9", "@a.b", "1.2.3.4", "+1 (234) 567-8901", "4111111111111111", "\n", "é", "256."]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_personal_data_of_the_table(spark):
    found = by_id(op9_skip_chain(spark, FOLDER))
    for key, text in texts().items():
        spans, row = plain_spans(text or ""), found[key]
        joined = personal.written(spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in spans) for k in personal.KINDS]
        assert {*joined.split(",")} - {""} <= {*row["spans"].split(",")}


def test_personal_data_of_awkward_rows(spark):
    df = awkward(spark, clashing=True)
    field = personal.train(df)
    rows = personal.personal_data(df, field).collect()
    assert len(rows) == len(AWKWARD) + 1
    for r in rows:
        base = plain_spans(AWKWARD[r["doc_id"]] or "")
        assert set(base) <= {tuple(s) for s in r["found"]}
    empty = nothing(spark)
    assert personal.personal_data(empty, personal.train(empty)).collect() == []
    clean = personal.without_personal_data(df, field)
    assert clean.schema == df.schema
    masked = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert masked[0] is None and masked[3] == "word" and "[EMAIL]" in masked[8] and "[CARD]" in masked[9]


def test_skip_edges_carry_labels():
    """A number known as a card is one in another notation too; an unrelated one is not."""
    cards = ["4111111111111111", "5500005555555559", "340000000000009000"]
    texts_seen = [f"pay {c} now or {k} later, {c}" for c in cards[:2] for k in range(100)]
    field = personal.fit(texts_seen)
    assert field.skip > 1
    text = "card 4111111111111111 again far away " + "word " * 300 + "4111.1111.1111.1111 and 12345"
    (base, spans), *_ = personal.find(field, [text])
    added = [text[s:e] for kind, s, e in spans if (kind, s, e) not in base]
    assert added == ["4111.1111.1111.1111"]
    assert personal.find(personal.Field.empty(), [text])[0][0] == personal.find(personal.Field.empty(), [text])[0][1]


def test_belief_propagation_is_exact_on_trees():
    draw = np.random.default_rng(1)
    field = personal.Field(draw.normal(size=(len(personal.FEATURES), personal.LABELS)),
                           draw.normal(size=(personal.LABELS, personal.LABELS)), 1.3)
    words = personal.Words.none()
    personal.add_words(words, 0, "5551234 a1 b22 5551234", [])
    words.back = [-1, -1, -1, -1]  # a chain, and so a tree
    got, n, k = personal.beliefs(field, words), 4, personal.LABELS
    own = personal._seen(words) @ field.own
    own[0] += field.chain[0]
    own[-1] += field.chain[:, 0]
    grid = np.indices((k,) * n).reshape(n, -1)
    odds = sum(own[i][grid[i]] for i in range(n)) + sum(field.chain[grid[i], grid[i + 1]] for i in range(n - 1))
    weight = np.exp(odds - odds.max())
    exact = np.array([[weight[grid[i] == y].sum() for y in range(k)] for i in range(n)]) / weight.sum()
    assert np.allclose(got, exact, atol=0.01)


# --- top-k


def plain_top(rows, k, step, scale=64):
    whole = {}
    for key, vector in rows:
        if vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            whole[key] = [int(np.floor(float(x) * scale)) for x in vector]
    out = []
    for q in sorted(whole):
        if q % step == 0:
            scored = [(-sum(a * b for a, b in zip(whole[q], v)), c) for c, v in whole.items() if c != q]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return out


def ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block, chunk", [(16_384, 128), (150, 7)])
def test_top_k_of_the_table(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(bit_slices, "BLOCK_ROWS", block)
    monkeypatch.setattr(bit_slices, "CHUNK_QUERIES", chunk)
    assert ranked(op7_bit_slices(spark, FOLDER)) == plain_top(sample("embeddings", "vec_id, embedding"), 20, 20)


def test_rows_that_share_an_id_are_queries_each(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (40, [-1.0, 0.5]), (None, [9.0, 9.0])]
    found = ranked(bit_slices.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 20))
    own, expected = rows[:-1], []
    for i, (q, vector) in enumerate(own):
        if q % 20 == 0:
            scored = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(vector, v)), c) for j, (c, v) in enumerate(own) if j != i)
            expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:3])]
    assert found == sorted(expected)


def test_top_k_with_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), -1.0, 0.0]) for i in range(60)]
    rows += [(100, None), (120, [1.0, None, 0.0]), (140, [nan, 1.0, 1.0]), (160, [inf, 1.0, 1.0]), (180, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, id long")
    for k in (1, 5, 100):
        assert ranked(bit_slices.top_k(df, k, 20)) == plain_top(rows, k, 20)
    assert bit_slices.top_k(df.limit(0), 5, 20).collect() == []
    with pytest.raises(Exception, match="differ in length"):
        bit_slices.top_k(df.unionByName(df.limit(1).selectExpr("7L AS vec_id", "array(1D) AS embedding", "7L AS id")), 5, 20).collect()
