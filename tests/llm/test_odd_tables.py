"""Clashing names, empty tables, long texts and hot groups."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveworks.llm import bpe, lines, mixing, neighbours, quality, rules, secrets, simhash

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SCHEMA)


def test_clashing_names_are_errors_or_harmless(spark):
    frame = docs(spark, [(1, "a b c d e"), (2, "x")])
    with pytest.raises(ValueError):
        lines.dedupe(frame.withColumn("Starts", F.lit(1)))
    with pytest.raises(ValueError):
        quality.classify(frame.withColumn("kept", F.lit(1)), quality.Model({}))
    with pytest.raises(ValueError):
        bpe.encode(frame.withColumn("token_ids", F.lit(1)), PATH, public_tokenizers.PATTERN, keep=("token_ids",))
    with pytest.raises(ValueError):
        rules.judge(frame.withColumn("kept", F.lit(1)), keep=("kept",))
    clashing = frame.withColumns({c: F.lit("x") for c in ("fp", "component_id", "_kept", "node", "root", "spans", "base", "key", "start", "first", "weight", "period", "slots", "end")})
    assert simhash.components(clashing).count() == 2
    assert simhash.dedupe(clashing).columns == clashing.columns
    assert secrets.scan(clashing, [0.0] * (len(secrets.ALPHABET) + 1) ** 2).count() == 2
    assert mixing.plan(clashing, {"src0": 2}).count() == 2
    assert rules.judge(clashing).count() == 2


def test_long_texts(spark):
    long = "word " * 40_000 + "x" * 200_000 + " token=" + "ab" * 50_000
    frame = docs(spark, [(1, long), (2, "\n".join(["line"] * 20_000)), (3, "(" * 50_000)])
    assert bpe.encode(frame, PATH, public_tokenizers.PATTERN, decoded=True).where("decoded is null").count() == 0
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedupe(frame.select("doc_id", "text"), counts=True).collect()} == {1: 0, 2: 19_999, 3: 0}
    model = [0.0] * (len(secrets.ALPHABET) + 1) ** 2
    assert [r["n"] for r in secrets.scan(frame, model).orderBy("doc_id").select(secrets.counted("base", "assign").alias("n")).collect()] == [1, 0, 0]
    assert rules.judge(frame).where("kept").count() == 0
    assert simhash.components(frame).count() == 3


def test_hot_groups(spark):
    same = docs(spark, [(i, "one two three four five six") for i in range(400)] + [(1000 + i, f"w{i} x{i} y{i} z{i} q{i}") for i in range(200)])
    assert simhash.dedupe(same).count() == 201
    mixed = mixing.plan(same.withColumn("source", F.when(F.col("doc_id") < 400, "src0").otherwise("src1")), {"src0": 1, "src1": 1})
    assert mixed.agg(F.countDistinct("position")).first()[0] == 600
    vectors = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(300)], "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0).where("query_id = 40").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20)) and {r["score"] for r in got} == {1.25}


def test_empty_tables(spark):
    empty = docs(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(empty, labels)
    assert quality.classify(empty, model).count() == 0
    assert secrets.scan(empty, secrets.train(secrets.samples(empty, labels))).count() == 0
    assert mixing.arrange(empty, {"src0": 1}).count() == 0


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on its own input, with plain versions of lines and near duplicates."""
    from test_near_duplicates import plain_components, plain_sets
    from test_text_operators import plain_lines

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{sf}/documents.parquet")
    held = spark.createDataFrame(stages["quality"](spark, start, sf).collect(), start.schema)
    assert held.columns == start.columns and 0.7 * start.count() < held.count() < start.count()
    cut = spark.createDataFrame(stages["lines"](spark, held, sf).collect(), start.schema)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == plain_lines([(r["doc_id"], r["text"]) for r in held.collect()])
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    single = spark.createDataFrame(stages["near_duplicates"](spark, cut, sf).collect(), start.schema)
    rows = sorted(cut.collect(), key=lambda r: r["doc_id"])  # five-word shingles and similarity 0.8, as no contract binds the stage
    roots = {rows[i]["doc_id"]: rows[j]["doc_id"] for i, j in plain_components(plain_sets([r["text"] for r in rows])).items()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(roots.values()))
    mixed = stages["mixing"](spark, single, sf)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(set(roots.values())) and mixed.columns == start.columns
    tokens = stages["tokens"](spark, mixed, sf)
    assert tokens.join(single.select("doc_id", F.sha2("text", 256).alias("d")), "doc_id").where("d <> decoded_sha256").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == tokens.count()
