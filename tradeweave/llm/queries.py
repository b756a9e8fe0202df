"""Each operator of this folder over its whole table, by name, and its DuckDB statement."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.llm import (
    archives,
    bit_slices,
    byte_pairs,
    contamination,
    id_files,
    licenses,
    periodic_runs,
    personal,
    quality,
    ranked_search,
    shards,
    simhash,
    token_counts,
)
from tradeweave.llm.license_texts import TEMPLATES

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24
TOKEN_LIMIT = 1024
QUALITY_FROM = 0.3
END_ID = 1
ENCODED_CHARS = 30_000_000  # of a block of op6

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:  # Python workers on this machine import this package from here
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, ROOT]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.place(table(spark, folder, "documents"), SHARDS)


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer files lie; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, folder, "documents"), model, TOKEN_LIMIT)


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_zip_warc(spark: SparkSession, folder: str) -> DataFrame:
    listed = archives.write_archives(table(spark, folder, "pages"))
    return archives.read_archives(listed, payloads=False)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), TEMPLATES)
    places = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"]))
    return found.select("doc_id", "n_matches", "licenses", F.array_join(places, ",").alias("spans"))


def op6_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_pairs.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, folder, "documents")
    return byte_pairs.encode(docs, ranks, token_counts.PATTERN, block_chars=ENCODED_CHARS)


def op7_bit_slices(spark: SparkSession, folder: str) -> DataFrame:
    return bit_slices.top_k(table(spark, folder, "embeddings"), k=20, step=20)


def op8_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    network = quality.train(docs, table(spark, folder, "labels"))
    return quality.scored(docs, network, QUALITY_FROM)


def op9_skip_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return personal.personal_data(docs, personal.train(docs)).drop("found")


def op10_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contamination.contaminated(docs, items).drop("spans", "items")


def op11_dual_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def op12_recompression(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_repeated_tails(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = found.withColumn("longest", periodic_runs.longest(F.col("runs")))
    exponent = F.call_function("div", 1000 * F.col("longest.length"), F.col("longest.period"))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.*",
        exponent.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    encode = id_files.by_library(vocabulary("word_bpe_49k.json"))
    listed = id_files.write_files(table(spark, folder, "documents"), encode, END_ID)
    return id_files.read_files(listed)


QUERIES: tuple[Query, ...] = (
    op1_jump_shards,
    op2_token_counts,
    op3_simhash,
    op4_zip_warc,
    op5_license_scan,
    op6_byte_pairs,
    op7_bit_slices,
    op8_byte_network,
    op9_skip_chain,
    op10_positional_index,
    op11_dual_tree,
    op12_recompression,
    op13_simple8b,
)


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


OP7_SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS line, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.line, q.vec_id AS query_id, v.vec_id,
           CAST(list_sum(list_transform(list_zip(q.whole, v.whole), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.line <> v.line
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored
QUALIFY rank <= 20
"""


OP4_SQL = """
WITH p AS (
    SELECT page_id, regexp_replace(coalesce(url, ''), '\\s', '', 'g') AS url, coalesce(html, '') AS body
    FROM pages
), hashed AS (
    SELECT *, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY body) AS first
    FROM p
)
SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) << (4 - j)))::INTEGER,
           1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""

OP10_SQL = """
WITH split AS (
    SELECT kind, id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents
          UNION ALL SELECT 'b', item_id, text FROM benchmark)
), windows AS (
    SELECT DISTINCT id AS item, n, array_to_string(words[i : i + n - 1], ' ') AS piece
    FROM (SELECT id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
          FROM split WHERE kind = 'b' AND len(words) > 0)
), places AS (
    SELECT id, n, i, array_to_string(words[i : i + n - 1], ' ') AS piece
    FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS i
          FROM split CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE kind = 'd' AND len(words) >= n)
), found AS (
    SELECT id, n, i, item FROM places JOIN windows USING (n, piece)
), hit AS (
    SELECT id, count(DISTINCT place) AS n_hit
    FROM (SELECT id, unnest(range(i, i + n)) AS place FROM found) GROUP BY id
), items AS (
    SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM found) GROUP BY id
)
SELECT split.id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM split LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
"""


OP11_SQL = """
WITH split AS (
    SELECT doc_id AS id, row_number() OVER () AS line, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
    FROM documents
), asked AS (
    SELECT item_id, line AS item, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+'))) AS term
    FROM (SELECT *, row_number() OVER () AS line FROM benchmark)
), totals AS (
    SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words)) AS n_words FROM split
), counted AS (
    SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(words) AS term FROM split)
    WHERE term IN (SELECT term FROM asked) GROUP BY line, term
), weighed AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, totals GROUP BY term, n_docs
), impacts AS (
    SELECT line, id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(words) * n_docs) // n_words)) AS impact
    FROM counted JOIN split USING (line), totals
), scored AS (
    SELECT item_id, item, line, id AS doc_id, CAST(sum(w * impact) AS BIGINT) AS score
    FROM asked JOIN weighed USING (term) JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


def llm_statements() -> dict[str, str]:
    return {
        "op4_zip_warc": OP4_SQL,
        "op7_bit_slices": OP7_SQL,
        "op10_positional_index": OP10_SQL,
        "op11_dual_tree": OP11_SQL,
    }
