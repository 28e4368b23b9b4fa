"""Tokens that the tokenizer file adds, against the tokenizers library with its default settings."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, queries

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext|", "it's <|ENDOFTEXT|> <<|endoftext|>>", "word " * 2047 + "<|endoftext|>" + " tail" * 30, ""]


@pytest.mark.parametrize("run", ["op10", "stage"])
def test_added_tokens_within_texts(spark, tmp_path, run):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op10_packing(spark, str(tmp_path)) if run == "op10" else corpus_pipeline.best_fit_packing(spark, docs, "")
    want = []
    for doc_id, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want)
