"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, licenses, media, packing, phrases, quality, secrets, simhash, toxicity, trie, urlfilter, warc
from .common import table

MULTI = "byte_bpe_multi_50k.tiktoken"
#: The ranks of the vocabulary in byte_bpe_50k.json; the ids are the same.
SINGLE = "byte_bpe_50k.tiktoken"
#: The tokenizer file of the same vocabulary; its added tokens count within texts.
SINGLE_FILE = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both derivatives of every page; the records themselves as SHA-256."""
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.evaluate(urlfilter.captures_of(pages), urlfilter.entries_of(pages))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(SINGLE), added=packing.added_tokens(public_tokenizers.path(SINGLE_FILE)))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(licenses.scan(table(spark, sf_dir, "documents")))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_dedup": op5_dedup,
    "op6_media": op6_media,
    "op7_secrets": op7_secrets,
    "op8_urlfilter": op8_urlfilter,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_phrases": op11_phrases,
    "op12_licenses": op12_licenses,
    "op13_trie": op13_trie,
}
ORACLES: dict[str, str] = {"op4_quality": quality.SQL, "op8_urlfilter": urlfilter.SQL, "op11_phrases": phrases.SQL, "op13_trie": trie.SQL}
