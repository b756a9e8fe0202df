"""Exact token counts without token ids.

The library counts each distinct pre-token of the corpus once; the counts are joined to the
pre-tokens of each block of documents (``words``) and summed per document.

Cases: a null text counts as empty and has no tokens; the strings of special tokens inside a text
are one token each, as the library takes them by default; repeated documents keep a row each; an
empty table gives an empty result; columns other than the key and the text are not read.
"""

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.llm import words

#: How the byte-level splitter cuts text (fixed value of the libraries).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH = 10_000


@cache
def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def special_token(definition: str) -> str | None:
    """The one special token, after checking that the file is of the kind counted here."""
    model = json.loads(definition)
    added = model["added_tokens"]
    split = model["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
    if not plain or model["normalizer"] is not None or len(added) > 1:
        raise ValueError("only byte-level models with at most one special token are counted")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError("special tokens that take in their surroundings are not counted")
    return added[0]["content"] if added else None


def word_counts(distinct: DataFrame, definition: str) -> DataFrame:
    """(word, fact): the tokens of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(definition).encode_batch
        for batch in batches:
            column = words.only_words(batch)
            for at in range(0, len(column), BATCH):
                part = column.slice(at, BATCH)
                found = encode(part.to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array([len(x) for x in found], pa.int32())], names=["word", "fact"]
                )

    return distinct.mapInArrow(run, "word string, fact int")


def token_counts(
    docs: DataFrame,
    model: str,
    limit: int,
    key: str = "doc_id",
    text: str = "text",
    *,
    block_chars: int = words.BLOCK_CHARS,
) -> DataFrame:
    """Per document: its key, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``model`` is the path of a tokenizer file, read on the driver.
    """
    with open(model, encoding="utf-8") as file:
        definition = file.read()
    special = special_token(definition)
    docs = words.stored(docs, key, text)
    found = words.blocks(docs, PATTERN, special, key, text, block_chars=block_chars)
    facts = words.places(found).join(word_counts(words.distinct_words(found), definition), "word")

    def total(tokens: np.ndarray, _: np.ndarray, sequences: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array([int(tokens[s].sum()) for s in sequences], pa.int64())}

    return words.with_facts(found, facts, total, "n_tokens long").select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
