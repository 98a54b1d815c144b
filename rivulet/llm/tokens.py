"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file: ranks of a byte-level BPE, one 'base64 rank' a line.  Read on the executors, never copied.
VOCABULARY = os.environ.get("RIVULET_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> list[int | None]:
    """Token counts; a null text has none, an empty one 0.  Strings of special tokens are ordinary text."""
    encode = encoder(path).encode_ordinary
    return [None if t is None else len(encode(t)) for t in texts]


def sized(df: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (bigint) of every row whose text is not null."""
    kept = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.select(*keep).dtypes) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = pa.array(count_tokens(batch.column("_text").to_pylist(), path), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [counts], keep + ["n_tokens"])

    return kept.mapInArrow(run, schema)
