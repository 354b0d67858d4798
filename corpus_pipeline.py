"""A corpus pipeline over documents: quality, language, near copies, benchmark passages, tokens.

Each stage gets the rows that its predecessor kept, all of them, and returns the
columns of ``documents``; the last one returns the encoded digests.  ``run``
writes each stage's rows to the shared folder and reads them again, which cuts
lineage and survives lost executors.

Extra columns pass through every stage but the last, whatever their names.  Null or
empty texts go in the first stage, which asks for words; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import op2_ngram_jaccard as near
from marlstone.llm import op5_bpe_codec as bpe
from marlstone.llm import op7_quality_rules as quality
from marlstone.llm import op8_decontaminate as benchmark
from marlstone.llm import op10_language_id as language
from marlstone.llm.scratch import Scratch

#: Least share of a text's n-grams that its language must know.
LEAST_LANGUAGE_SCORE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text a learned language explains."""
    model = language.fit(docs.filter(~language.held_out()))
    if not model.languages:
        return docs
    return language.keep(docs, model, LEAST_LANGUAGE_SCORE)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id; rows without words all stay."""
    return near.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return benchmark.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Language models, edit distances and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(before)
    return docs
