"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import jaccard_join, language_id, line_dedup, mixing, packing
from tidewright.llm.common import discard, staged, table
from tidewright.llm.queries import tokenizer_json


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents that no language model accepts go (no letters at all, or far from every language)."""
    scored = language_id.predict(docs, language_id.train(docs), ("_lang_pred", "_lang_score", "_lang_entropy", "_lang_accepted"))
    return scored.filter("_lang_accepted").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines with an earlier line alike are taken out; every document stays, if without text."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each group of linked documents the smallest id stays."""
    return jaccard_join.first_of_components(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents come as often (0, 1 or 2 times) as the mix takes their words, rounded."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document in its sequence."""
    return packing.pack_documents(docs, tokenizer_json())


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The language models, the edit distances and the tokenizer cannot be expressed in SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder before the next begins, and go when that has ended."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(before, "staged_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
