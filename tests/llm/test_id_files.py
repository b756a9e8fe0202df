"""Simple-8b files against plain lists of ids from the library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import AWKWARD, FOLDER, awkward, by_id, nothing, texts
from tests.llm.test_tokens import odd_texts
from tradeweave.llm import id_files
from tradeweave.llm.queries import END_ID, op13_simple8b, vocabulary

MODEL = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoded():
    library = Tokenizer.from_file(MODEL)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_blocks_round_trip():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 119, 120, 121, 500, 70_000):
        for values in (
            np.zeros(n),
            draw.integers(0, 2, n),
            draw.integers(0, 50_000, n),
            2 ** draw.integers(0, 60, n),
            np.where(draw.random(n) < 0.05, 2**64 - 1, draw.integers(0, 9, n).astype(np.uint64)),
        ):
            ids = values.astype(np.uint64)
            words, escapes = id_files.encode_block(ids)
            assert (id_files.decode_block(words, escapes, n) == ids).all()
    assert len(id_files.encode_block(np.zeros(240))[0]) == 2


def test_whole_table(spark, encoded):
    found = by_id(op13_simple8b(spark, FOLDER))
    start = 0
    for key, text in sorted(texts().items()):
        ids = encoded(text)
        row = found.pop(key)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not found


def test_awkward_rows_many_blocks_and_files(spark, encoded):
    make = id_files.by_library(MODEL)
    docs = awkward(spark, clashing=True).selectExpr("nullif(doc_id, 3) AS doc_id", "* EXCEPT (doc_id)")
    listed = id_files.write_files(docs, make, END_ID, file_ids=10, block_ids=50)
    assert listed.count() > 10
    rows = sorted(id_files.read_files(listed, keep_ids=True).collect(), key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert len(rows) == len(AWKWARD) + 1 and keys == sorted(keys) and keys[0] == -1
    start = 0
    for r in rows:
        ids = encoded(AWKWARD[3 if r["doc_id"] is None else r["doc_id"]])
        assert r["ids"] == ids and r["ids_crc32"] == crc(ids) and r["start"] == start
        start += len(ids)
    empty = id_files.read_files(id_files.write_files(nothing(spark), make, END_ID))
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_files_are_read_where_they_are_listed(spark):
    """One task a part, not one for all files."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # the table is small
    listed = id_files.write_files(spark.read.parquet(f"{FOLDER}/documents.parquet"), id_files.by_library(MODEL))
    spark.conf.unset(setting)
    parts = listed.select("part").distinct().count()
    found = id_files.read_files(listed).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert parts > 1 and sum(n > 0 for n in found) == parts


def test_pieces_are_encoded_as_in_their_texts(encoded, monkeypatch):
    monkeypatch.setattr(id_files, "REMEMBERED", 7)  # forgets all the time
    own = id_files.by_library(MODEL)()
    more = [" ".join(odd_texts(40)) for _ in range(5)]
    more += ["é ́x", "ÀÉÎ ñÑ, ß. ÿÿ! Öl;", "İstanbul ſ K", "a" * 100 + " b", "it's I'LL don't.", "<|startoftext|>ab c<|endoftext|>"]
    for text in [*odd_texts(500), *more]:
        assert own(text).tolist() == encoded(text)[:-1], text


def test_a_stretch_and_a_broken_file(tmp_path):
    writer = id_files.Writer(open(tmp_path / "ids", "wb"))
    ids = np.arange(200_000) * 7
    for k in range(0, len(ids), 999):
        writer.add(k, ids[k : k + 999])
    size = writer.close()
    with open(tmp_path / "ids", "rb") as file:
        reader = id_files.Reader(file, size)
        assert (reader.ids(65_000, 140_000) == ids[65_000:140_000]).all() and len(reader.ids(5, 5)) == 0
        with pytest.raises(ValueError):
            id_files.Reader(file, size - 9)


def test_texts_encoded_together(encoded, monkeypatch):
    """One dictionary of bounded size; long pieces are not kept, and texts do not mix."""
    own = id_files.by_library(MODEL)()
    plain = ["Its words, its signs!!", "a" * 500 + " b", "", " ", "ÀÉ'll don't 12.34", "it'S Öl\n\nß?"]
    every = [*plain, *odd_texts(100), "<|endoftext|> a", *plain]
    for size in (3, 10**6):
        monkeypatch.setattr(id_files, "REMEMBERED", size)
        for _ in range(2):
            assert [ids.tolist() for ids in own.many(every)] == [encoded(text)[:-1] for text in every]
    assert own.pieces and max(map(len, own.pieces)) <= id_files.SHORT
