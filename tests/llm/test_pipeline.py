"""The corpus pipeline: each stage on its own input, odd rows, and clean documents stay."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from splicewell.llm import common, simhash, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.Written(stage(spark, docs, sf)).df
        assert out.columns == docs.columns
        before, after = docs.count(), out.count()
        assert 0.7 * before <= after <= before, name
        if name == "near_duplicates":
            assert after == simhash.near_duplicates(docs).select("component_id").distinct().count()
        if name == "personal_data":
            assert out.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("rows", [0, 3])
def test_odd_tables(spark, rows, tmp_path):
    data = [(None, None, None, None, None), (1, "One short text", "en", "a", 14), (1, "One short text", "en", "a", 14)][:rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == (1 if rows else 0)


def test_language_stage_uses_its_prediction(spark):
    """Letters in random order go, though they are letters; a null language is filled in; clashing columns stay."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(200)) for _ in range(10)]
    plain = docs.where("lang = 'fr' and n_chars > 300").limit(5).collect()
    rows = [(-1 - i, t, None, "x", len(t)) for i, t in enumerate(noise)] + [(-100 - i, r.text, None, "x", r.n_chars) for i, r in enumerate(plain)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("__language", F.lit("mine"))
    out = corpus_pipeline.language(spark, more, "").cache()
    assert out.columns == more.columns and out.where("`__language` <> 'mine'").count() == 0
    assert out.where("doc_id between -50 and -1").count() == 0
    assert {(r.doc_id, r.lang) for r in out.where("doc_id <= -100").collect()} == {(-100 - i, "fr") for i in range(5)}
    assert out.where("doc_id >= 0").count() == docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Very long texts, ties, repeated rows, nulls and clashing columns go through every stage."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 80")
    r = docs.orderBy("doc_id").first()
    words = r.text.split() * (60_000 // len(r.text.split()) + 1)
    random.Random(1).shuffle(words)
    long_ = " ".join(words)
    rows = [(9001, long_, "en", None, len(long_)), (9002, long_, "en", None, len(long_)), (9003, r.text, None, "x", 1), (9003, r.text, None, "x", 1), (None, None, None, None, None), (9004, "", "en", "x", 0), (None, r.text + " and call +1 (743) 555-3824", "en", "x", 9)]
    extra = ["pii_spans", "toxicity", "fp", "__key", "language", "component_id"]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).select("*", *[F.lit("mine").alias(c) for c in extra])
    common.table(spark, "/root/testdata/sf0.001", "labels").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.Written(stage(spark, docs, str(tmp_path))).df
        assert out.columns == docs.columns, name
        assert out.where(" or ".join(f"`{c}` <> 'mine'" for c in extra)).count() == 0, name
        if name == "near_duplicates":
            assert out.where("doc_id in (9001, 9002)").count() == 1 and out.where("doc_id = 9003").count() <= 1
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("doc_id = 9001").agg(F.sum("length")).first()[0] > 50_000


def test_toxicity_stage_by_its_score(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = toxicity.fit(docs, common.table(spark, "/root/testdata/sf0.01", "labels"))
    wanted = {r.doc_id for r in toxicity.score(docs, model).where("toxicity < 0.5").collect()}
    assert {r.doc_id for r in corpus_pipeline.toxic(spark, docs, "/root/testdata/sf0.01").collect()} == wanted
