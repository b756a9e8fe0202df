"""Small tables of awkward rows, shared by the tests of the text operators."""

import duckdb

FOLDER = "/root/testdata/sf0.001"
TYPES = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside
CLASHES = "id, word, at, fact, block, segment, place, key, shard, position, n, label, score, fingerprint"

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
AWKWARD: list[str | None] = [
    None,
    "",
    " ",
    "word",
    "Two words",
    "  leading and  double  spaces \n\n and\tbreaks\r\n",
    "don't we'll I'm it's <|endoftext|> and <|endoftext|>",
    "naïve Äpfel 日本語 テキスト 😀 ՘Ᲊ \x1c\x85 end",
    "mail a.b@mail.example.com or c@d.e.f@g.h, 10.0.0.1, 999.1.1.1, +1 (234) 567-8901",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111",
    PASSAGE,
    PASSAGE.upper() + " " + "filler " * 400,
    PASSAGE,
    "a" * 3000,
    "Licensed under the Apache License, Version 2.0. " + "more text " * 30,
    "long text with many words " * 3000,
    "x = 1; y = 2\n" * 50,
]


def awkward(spark, *, clashing: bool = False):
    """The rows above with ids 0 to n - 1, and the last of them twice."""
    rows = [(i, t, None, "src", None) for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame([*rows, rows[-1]], TYPES).repartition(3)
    if clashing:
        df = df.selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHES.split(", ")])
    return df


def nothing(spark):
    return spark.createDataFrame([], TYPES)


def sample(name: str = "documents", columns: str = "doc_id, text") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()


def texts() -> dict[int, str | None]:
    return dict(sample())


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
