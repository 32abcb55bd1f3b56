"""Corpus pipeline: language ID, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents. Null texts have no letters and go in the
first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicewell.llm import common, langid, packing, pii, simhash, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that parse as none of the learned languages go; where lang is null, the prediction is put in."""
    model = langid.fit(langid.train_rows(docs), "text", "lang", "doc_id")
    found = common.free(docs, "__language")
    kept = langid.identify(docs, model, into=found).where(F.col(found)["known"])
    return kept.withColumn("lang", F.coalesce("lang", F.col(found)["lang"])).select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    found = common.free(docs, "__toxicity")
    return toxicity.score(docs, model, into=found).where(F.col(found) < 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that with the smallest id."""
    return simhash.keep_one(docs).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows the new text."""
    clean = pii.redact(pii.find(docs, pii.fit(docs)), spans=pii.columns(docs)[1])
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]
#: Learned models and packing can't be told in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        written = common.Written(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
