"""Token counts and byte pairs against the tokenizer libraries."""

import hashlib
import random

import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.cases import AWKWARD, FOLDER, awkward, by_id, nothing, texts
from tradeweave.llm import byte_pairs, token_counts, words
from tradeweave.llm.queries import op2_token_counts, op6_byte_pairs, vocabulary
from tradeweave.llm.token_counts import PATTERN

MODEL = vocabulary("byte_bpe_50k.json")
RANKS = byte_pairs.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def counted():
    library = Tokenizer.from_file(MODEL)
    return lambda text: len(library.encode(text or "", add_special_tokens=False))


@pytest.fixture(scope="module")
def encoded():
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return lambda text: library.encode_ordinary(text or "")


def odd_texts(n: int) -> list[str]:
    draw = random.Random(3)
    parts = [*"ab1'2 \n\t-!", "  ", " \n", "<|endoftext|>", "՘", "Ᲊ", "é", "٣", " ",
             "'s", "'ll", "\x1c", "\x85", "日本", "😀", "\0"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_counts_of_the_table(spark, counted):
    found = by_id(op2_token_counts(spark, FOLDER))
    assert {k: r["n_tokens"] for k, r in found.items()} == {k: counted(t) for k, t in texts().items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found.values())


def test_counts_of_awkward_rows(spark, counted):
    many = {"block_chars": 500}  # many blocks
    rows = token_counts.token_counts(awkward(spark, clashing=True), MODEL, 10, **many).collect()
    assert len(rows) == len(AWKWARD) + 1
    for r in rows:
        text = AWKWARD[r["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (counted(text), len((text or "").encode()))
    assert token_counts.token_counts(nothing(spark), MODEL, 10).collect() == []
    odd = odd_texts(1000)
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    found = by_id(token_counts.token_counts(df, MODEL, 10))
    assert all(found[i]["n_tokens"] == counted(t) for i, t in enumerate(odd))


def same(row, text, ids):
    return (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_ids_of_the_table(spark, encoded):
    found = by_id(op6_byte_pairs(spark, FOLDER))
    assert len(found) == len(texts())
    assert all(same(found[k], t, encoded(t)) for k, t in texts().items())


def test_ids_of_awkward_rows(spark, encoded):
    rows = byte_pairs.encode(awkward(spark, clashing=True), RANKS, PATTERN, keep_ids=True, block_chars=500)
    back = byte_pairs.decode(rows, RANKS).collect()
    assert len(back) == len(AWKWARD) + 1
    for r in back:
        text = AWKWARD[r["doc_id"]]
        assert r["ids"] == encoded(text) and same(r, text, r["ids"])
        assert bytes(r["decoded"]) == (text or "").encode()
    assert byte_pairs.encode(nothing(spark), RANKS, PATTERN).collect() == []


def test_odd_texts_and_long_words(spark, encoded):
    odd = [*odd_texts(1000), "ab" * 5000 + "é" * 900, " " * 700 + "x", "b" * 199, "b" * 200]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    found = by_id(byte_pairs.encode(df, RANKS, PATTERN))
    assert all(same(found[i], t, encoded(t)) for i, t in enumerate(odd))


def test_documents_are_split_once(spark, capsys):
    for df in (op2_token_counts(spark, FOLDER), op6_byte_pairs(spark, FOLDER)):
        df.collect()
        df.explain()
        final = capsys.readouterr().out.split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 2


def test_marks_of_blocks_are_no_words(spark):
    df = spark.createDataFrame([(1, "d0 0 d0 0")], "doc_id long, text string")
    assert token_counts.token_counts(df, MODEL, 10).first()["n_tokens"] > 0
    with pytest.raises(ValueError, match="mark"):
        words.blocks(df, r"[a-z]0 \d+")


def test_missing_byte(spark):
    few = {bytes([b]): b for b in range(97, 123)}
    df = spark.createDataFrame([(1, "abc!")], "doc_id long, text string")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_pairs.encode(df, few, PATTERN).collect()


def test_packing():
    numbers = [0, 1, 255, 256, 70_000, 2**32 - 1]
    assert words.unpack(words.pack(numbers)).tolist() == numbers
    assert words.unpack(words.pack([])).tolist() == []
