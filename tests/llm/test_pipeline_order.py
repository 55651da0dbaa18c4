"""The order of the mix in what the pipeline returns."""

import corpus_pipeline
from sieveworks.llm import mixing
from sieveworks.llm.queries import WEIGHTS


def test_run_returns_rows_in_the_order_of_the_mix(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).select("position", "doc_id").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    kept = docs.where(docs["doc_id"].isin([r["doc_id"] for r in rows]))
    want = mixing.plan(kept, WEIGHTS).orderBy("position").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in want]


def test_odd_documents_go_through_all_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Extra string"
    rows = [(1, "a b c d e f", "en", "src0", 11, "x"), (1, "a b c d e f", "en", "src0", 11, "x"), (2, None, None, None, None, None), (3, "", "en", "src1", 0, "y"), (4, "word " * 60_000, "xx", "src0", 300_000, "z"), (None, "no id", "en", "zz", 5, "w")]
    labels = "doc_id long, quality int, toxic int"
    for name, docs in (("some", rows), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert [r["position"] for r in got] == list(range(len(got)))
        assert sorted((r["doc_id"] or -1) for r in got) == ([-1, 1, 2, 4] if docs else [])
