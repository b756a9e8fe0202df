"""The stages in a row, each against what its operator says about its own input."""

import corpus_pipeline
from tests.llm.cases import FOLDER, awkward, nothing
from tests.llm.test_near_copies import plain_groups
from tradeweave.llm import byte_pairs, contamination, personal
from tradeweave.llm.queries import vocabulary


def test_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    _, good, single, clean, masked, encoded = kept
    for df in kept[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS) and df.dtypes == docs.dtypes
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
    texts = dict(good.select("doc_id", "text").orderBy("doc_id").collect())
    groups = plain_groups(list(texts.values()))  # by five-word shingles, all pairs compared
    assert ids[2] == {key for k, key in enumerate(texts) if groups[k] == k}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    hit = contamination.contaminated(single, items).where("contaminated").collect()
    assert ids[3] == ids[2] - {r["doc_id"] for r in hit}
    for r in masked.collect():
        assert personal.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
    ranks = byte_pairs.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_pairs.decode(encoded, ranks).collect()}
    assert back == {r["doc_id"]: r["text"] for r in masked.collect()}
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"]: r["ids_sha256"] for r in whole.collect()} == {
        r["doc_id"]: r["ids_sha256"] for r in encoded.collect()
    }


def test_awkward_and_empty_tables(spark):
    for docs in (awkward(spark, clashing=True), nothing(spark)):
        rows = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs.checkpoint(), FOLDER)
            assert docs.count() <= rows
