"""Encoding of a whole corpus with a public byte-level tokenizer, and token counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR, byte_bpe, counter

#: Characters that are encoded at a time.
CHUNK_CHARS = 1 << 20


def chunks(batch: pa.RecordBatch, column: str, chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch whose texts sum up to about `chars` characters, with the texts."""
    texts = batch.column(column).to_pylist()
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or k - begin >= 4096:
            yield batch.slice(begin, k + 1 - begin), texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids) of every row: the list of integers the tokenizer gives, without special tokens.

    Null and empty texts have the empty list. Names of special tokens in a text are ordinary
    text. Rows that come again are encoded again, texts of any length are encoded whole, an
    empty table gives no rows, and other columns are ignored.
    """
    rows = df.select(F.col(key).alias(key), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer, folder)
        for batch in batches:
            for part, texts in chunks(batch, "__text"):
                ids, counts = bpe.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.record_batch([part.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def with_token_counts(df: DataFrame, text: str, keep: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns `keep` and n_tokens, the length of each text in tokens (0 for null and empty texts)."""
    rows = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, folder)
        for batch in batches:
            n = pa.array(count(batch.column("__text").to_pylist()), pa.int64())
            yield pa.record_batch([*[batch.column(c) for c in keep], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__text")
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint")
