"""Encoding of a corpus with a public byte-level BPE, and token counts (problem 8)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.bpe import encoded_batches, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row: no special tokens, whole texts, one map over the input.

    A null or empty text gives an empty list; literal markup of special tokens is plain text; repeated
    rows stay repeated; other columns are ignored, whatever their names. An empty table gives none.
    """
    path = tokenizer_path(vocabulary, folder)
    rows = df.select(F.col(key), F.col(text).alias("_text"))

    def run(batches):
        for batch, ids, offsets in encoded_batches(batches, "_text", path):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(key, n_tokens int) for every row; 0 for a null or empty text."""
    path = tokenizer_path(vocabulary, folder)
    rows = df.select(F.col(key), F.col(text).alias("_text"))

    def run(batches):
        for batch, _, offsets in encoded_batches(batches, "_text", path):
            counts = pa.array((offsets[1:] - offsets[:-1]).astype("int32"))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[key, "n_tokens"])

    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens int")
