"""A corpus from raw documents: languages, near copies, leaks, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next.  All but the last
return the columns of ``documents``.  The order in which mixing writes its rows is that of its part files and the rows in them; the token files follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import jaccard, language, leaks, mixing, tokens
from tidewatch.llm.common import in_file_order, stored, table
from tidewatch.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those no nearer to any language than chance."""
    return language.kept_languages(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard.representatives(docs, percent=80, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the rows in the order in which sources interleave to their target weights; all rows stay."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, as its files have it; doc_id, start, n_tokens and checksum of each document as read back."""
    return tokens.digest(in_file_order(docs, "_place"), vocabulary(), order_by="_place")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Hyperdimensional profiles, SimHash and a tokenizer's vocabulary are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
