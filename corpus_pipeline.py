"""From raw documents to packed token sequences, each stage over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from lamella.llm import language, near, packing, pii, simhash, toxicity
from lamella.llm.common import stage, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stages can't be expressed in SQL: three of them train models, and token ids come from a library.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language isn't known: no letter, or a score below one half."""
    learn = docs.where((language.remainder(4) != 2) & F.col("doc_id").isNotNull())
    return language.identified(docs, language.train(learn.select("doc_id", "text", "lang")))


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that score at or above the threshold."""
    labels = toxicity.learnable(table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, toxicity.train(toxicity.learnable(docs), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, near.near_roots)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars follows."""
    out = pii.masked(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document and its place."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", by_language), ("toxicity", by_toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
