import edge
import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == P.COLUMNS, name
        assert 0 < docs.count() <= n
        n = docs.count()
    used = P.run(spark, SF).select("doc_id").distinct()
    assert used.count() == n and used.join(docs, "doc_id").count() == n


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_rows(spark, name, stage):
    docs = edge.docs(spark)
    found = {r.doc_id for r in stage(spark, docs, SF).collect()}
    gone = {"line_dedup": {5}, "near_dedup": {5, 7, 10}}.get(name, set())
    assert found == set(edge.TEXTS) - gone
    assert stage(spark, edge.empty(spark), SF).collect() == []


def test_line_dedup_stage_cuts_long_lines(spark):
    long = " ".join(edge.words(52, 3))
    texts = {1: f"first\n{long}\nof one", 2: f"second\n{long}\nof two", 3: long}
    found = {r.doc_id: r.text for r in P.line_dedup(spark, edge.docs(spark, texts), SF).collect()}
    assert found == {1: texts[1], 2: "second\nof two"}
