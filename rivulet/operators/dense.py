"""Dense and sparse top-k of a batch of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.lexical import block_search
from rivulet.session import materialize

#: Queries and vectors that one task compares at a time, and least number of vector blocks.
QUERY_BLOCK, VECTOR_BLOCK, LEAST_BLOCKS = 4_096, 65_536, 8


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def dense_scores(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: exact cosine top-k by (rounded score, key).

    ``queries`` is ``(query_id, v)``, ``vectors`` ``(chunk_id, v)``; null vectors and those with null elements take no part, all-zero ones score 0;
    all have one length.  Both are hashed to blocks, and each block of queries meets each block of vectors in a task,
    which gives its own best k (with all ties of the last); one window merges them.  No row per pair is ever shuffled,
    and neither side is collected or broadcast.
    """
    usable = lambda df: df.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    asked = usable(queries).select("query_id", F.col("v").cast("array<double>").alias("v"))
    held = usable(vectors).select("chunk_id", F.col("v").cast("array<double>").alias("v"))
    n_asked, n_held = asked.count(), held.count()
    asks, blocks = max(1, -(-n_asked // QUERY_BLOCK)), max(LEAST_BLOCKS, -(-n_held // VECTOR_BLOCK))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(own("query_id", asks).alias("ask"), every(blocks).alias("block"), "query_id", "v")
    right = held.select(every(asks).alias("ask"), own("chunk_id", blocks).alias("block"), "chunk_id", "v")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, x = _matrix(asked), _matrix(held)
        rows, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(q) and len(x):
            qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            keep = min(k, len(x))
            for at in range(0, len(q), 256):
                scale = qn[at : at + 256, None] * xn
                s = np.round(np.divide(q[at : at + 256] @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0), 6)
                least = np.partition(s, len(x) - keep, axis=1)[:, len(x) - keep]
                i, j = np.nonzero(s >= (least[:, None] if min_score is None else np.maximum(least, min_score)[:, None]))
                rows.append(i + at)
                found.append(j)
                scores.append(s[i, j])
        take = lambda t, c, i: t.column(c).take(pa.array(np.concatenate(i)))
        return pa.table({"query_id": take(asked, "query_id", rows), "chunk_id": take(held, "chunk_id", found), "score": pa.array(np.concatenate(scores))})

    scored = left.groupBy("ask", "block").cogroup(right.groupBy("ask", "block")).applyInArrow(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    # k rows a query, written once: in a plan that reads a Python stage twice, it would run twice
    return materialize(scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k), "found")


def sparse_scores(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: dot product of sparse maps ``w`` (position to weight), entries of 0 and less dropped.

    Positions are the terms of a block search, so a position that nearly all vectors hold is spread over their blocks.
    """
    entries = lambda df, key, name: df.select(key, F.explode("w").alias("t", name)).withColumn("t", F.col("t").cast("bigint"))
    n = vectors.count()
    return block_search(entries(queries, "query_id", "qtf"), entries(vectors, "chunk_id", "w"), n, k)
