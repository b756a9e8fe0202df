"""Jump consistent hashing against the paper's loop."""

import zlib

from tests.llm.cases import FOLDER, awkward, nothing, sample
from tradeweave.llm import shards
from tradeweave.llm.queries import SHARDS, op1_jump_shards


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    key %= 1 << 64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def checked(rows, texts, n):
    slots = {}
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], n), jump(r["doc_id"], n + 1))
        assert r["grown_shard"] in (r["shard"], n)
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "key")
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_table(spark):
    rows = op1_jump_shards(spark, FOLDER).collect()
    texts = dict(sample())
    assert len(rows) == len(texts)
    checked(rows, texts, SHARDS)


def test_awkward_rows(spark):
    df = awkward(spark, clashing=True)
    rows = shards.place(df, 5).collect()
    assert len(rows) == df.count()
    checked(rows, {r["doc_id"]: r["text"] for r in df.collect()}, 5)
    assert shards.place(nothing(spark), 5).collect() == []
    kept = shards.assign(df, 3)
    assert set(kept.columns) == {*df.columns, "shard", "grown_shard"} and kept.count() == df.count()


def test_keys_of_other_kinds(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), None]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in shards.assign(df, 24).collect()}
    assert got == {i: jump(i or 0, 24) for i in ids}
    words = spark.createDataFrame([(str(i), "t") for i in range(2000)], "doc_id string, text string")
    sizes = [r["count"] for r in shards.assign(words, 10).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * min(sizes)


def test_no_python_in_the_plan(spark):
    plan = op1_jump_shards(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
