"""Runs registered queries and their DuckDB twins side by side."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem".split()


def plain(value):
    """Values as comparable text; nulls, NaN and -0.0 in one form each."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def duck(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def differences(df, con, sql: str, keep: int = 3) -> list:
    """Rows found on one side only (with multiplicity), and column or type mismatches."""
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    theirs_rows = cursor.fetchall()
    ours_names, ours_rows = df.columns, df.collect()
    if sorted(ours_names) != sorted(theirs_names):
        return [("columns", sorted(ours_names), sorted(theirs_names))]
    names = sorted(ours_names)
    place = [theirs_names.index(n) for n in names]
    ours = sorted(tuple(plain(row[n]) for n in names) for row in ours_rows)
    theirs = sorted(tuple(plain(row[i]) for i in place) for row in theirs_rows)
    if len(ours) != len(theirs):
        return [("rows", len(ours), len(theirs))]
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return [(names, len(wrong), *wrong[:keep])] if wrong else []


def main(folder: str, only: list[str]) -> None:
    import __spark_entry__ as entry
    from tests.session import session

    spark, con = session(), duck(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                found = differences(df, con, oracles[name])
                result = "ok" if not found else f"DIFF {str(found)[:900]}"
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            result = f"FAIL {str(error)[:600]}"
        print(f"{name} {time.time() - start:.2f} {result}", flush=True)
    missing = set(oracles) - set(entry.queries())
    print("oracles without query:", missing or "none")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
