"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import decontam, langid, mixing, simhash, tokens
from notegraph.llm.common import held_out, materialise, table
from notegraph.session import clear, mark

#: A text whose nearest codeword is less likely than this is rejected, like one without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    model = langid.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    name = "_language"
    while name in docs.columns:
        name += "_"
    judged = docs.withColumn(name, langid.predict(model, docs))
    return judged.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_SCORE)).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document."""
    return tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_output", token_output)]

#: SQL cannot express the trained classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, begun, mark(spark) - 1)  # the stage's input and all it held; its output stays
    return docs
