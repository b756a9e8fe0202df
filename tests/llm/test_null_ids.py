"""The dropping stages judge rows with null and repeated ids by their own texts."""

from tests.llm.cases import PASSAGE, TYPES
from tradeweave.llm import contamination


def test_contaminated_rows_with_null_and_repeated_ids(spark):
    rows = [(None, PASSAGE), (None, "clean one"), (None, None), (1, PASSAGE), (1, "clean two"), (1, ""), (2, PASSAGE), (3, "clean two")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], TYPES)
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = contamination.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([r for r in rows if r[1] != PASSAGE], key=str)
