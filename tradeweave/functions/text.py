"""Text helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(text: Column | str) -> Column:
    """Trimmed text with a capital after every character that is not a letter."""
    runs = F.regexp_extract_all(F.trim(text), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")
