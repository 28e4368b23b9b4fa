"""A corpus pipeline of the operators in tessera.llm.

Quality rules, near-duplicates, repeated passages, secrets, packing. Each stage works on all
rows that the one before kept, and all but the last return the columns of documents. What a
stage returns is to be written before the next one runs, as run() does: a stage begins by
deleting the intermediate tables of the one before it. Tables of other queries stay, and so do
those of the last stage, which its rows are read from.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import dedup, packing, quality, secrets, simhash
from tessera.llm.common import materialise, owned, release, table
from tessera.llm.queries import SINGLE, SINGLE_FILE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    with owned("quality_rules"):
        return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: texts whose shingles of five words have a Jaccard similarity of 0.8 or more."""
    release(spark, "quality_rules")
    with owned("near_duplicates"):
        return simhash.keep_one(docs, words=5, similarity=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again go, from every text that has them."""
    release(spark, "near_duplicates")
    with owned("suffix_array_dedup"):
        return dedup.remove_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    release(spark, "suffix_array_dedup")
    with owned("secret_scan"):
        return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens of the remaining texts."""
    release(spark, "secret_scan")
    with owned("best_fit_packing"):
        return packing.pack_documents(docs, public_tokenizers.path(SINGLE), added=packing.added_tokens(public_tokenizers.path(SINGLE_FILE)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
#: The stages hash shingles and parse encodings, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. What a stage returns is written, and deleted when the next one's is; the last but one is kept for the result."""
    docs, this, before = table(spark, sf_dir, "documents"), f"run-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        with owned(f"{this}-{name}"):
            docs = materialise(kept, name)
        if before:
            release(spark, before)
        before = f"{this}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
