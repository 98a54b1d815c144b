"""Model slots and their offline stand-ins: the same input gives the same output on every machine.

An embedder, a reranker or a language model is a function over lists; ``apply_model`` runs it in Arrow batches with one
instance a Python worker.  Failures are soft: a batch that fails gives nulls.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """Unit vector of hashed words; all zero for a text without words."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def lexical_score(query: str, text: str) -> float:
    """Share of the query's words that the text holds."""
    q = set(re.findall(r"\w+", (query or "").lower()))
    return len(q & set(re.findall(r"\w+", (text or "").lower()))) / len(q) if q else 0.0


def apply_model(make: Callable[[], Callable], returns: str, *columns: Column) -> Column:
    """``make()`` once a worker; its result maps equally long lists, one a column, to a list of values."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            given = batch if isinstance(batch, tuple) else (batch,)
            try:
                yield pd.Series(list(model(*[list(c) for c in given])))
            except Exception:  # noqa: BLE001 - the fallback of every model stage is "no answer"
                yield pd.Series([None] * len(given[0]))

    return run(*columns)


def embed(text: Column, dim: int = 64) -> Column:
    return apply_model(lambda: lambda ts: [hash_embedding(t, dim) for t in ts], "array<double>", text)


def rerank(query: Column, text: Column) -> Column:
    return apply_model(lambda: lambda qs, ts: [lexical_score(q, t) for q, t in zip(qs, ts)], "double", query, text)
