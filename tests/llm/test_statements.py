"""The queries that SQL can express against DuckDB."""

import duckdb
import pytest

from tests.compare import differences
from tests.llm.cases import FOLDER
from tradeweave.llm.queries import llm_queries, llm_statements


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm_statements()))
def test_same_as_duckdb(spark, con, name):
    assert differences(llm_queries()[name](spark, FOLDER), con, llm_statements()[name]) == []
