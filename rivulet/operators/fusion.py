"""Fusing ranked lists ``(query_id, leg, chunk_id, score, rank)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal-rank fusion; over-fetch of a store-level hybrid.
RRF_K, OVERFETCH, POOL = 60, 3, 50


def candidate_cap(k: int, boosted: bool = False) -> int:
    """Candidates a leg fetches for a final k."""
    return min(OVERFETCH * k, 150 if boosted else POOL)


def rrf(ranked: DataFrame, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: sum of weight / (60 + rank) over the legs; ties by first leg, its rank, then key.

    A chunk repeated within a leg counts each time; legs without a weight count 1.
    """
    weight: Column = F.lit(1.0)
    for leg, w in (weights or {}).items():
        weight = F.when(F.col("leg") == leg, F.lit(float(w))).otherwise(weight)
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 8).alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen.leg", "seen.rank", "chunk_id")
    out = fused.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("seen")
    return out if k is None else out.where(F.col("rank") <= k)


def min_max(ranked: DataFrame) -> DataFrame:
    """``norm``: scores of each list between 0 and 1; 0 where all are equal."""
    one = Window.partitionBy("query_id", "leg")
    low, span = F.min("score").over(one), F.max("score").over(one) - F.min("score").over(one)
    return ranked.withColumn("norm", (F.col("score") - low) / F.when(span == 0, F.lit(1.0)).otherwise(span))


def linear(ranked: DataFrame, alpha: float, first: str, second: str) -> DataFrame:
    """``(query_id, chunk_id, score)``: alpha times the first leg's normalised score plus the rest of the second's, missing as 0."""
    n = min_max(ranked)
    part = lambda leg: F.coalesce(F.max(F.when(F.col("leg") == leg, F.col("norm"))), F.lit(0.0))
    return n.groupBy("query_id", "chunk_id").agg(F.round(alpha * part(first) + (1 - alpha) * part(second), 6).alias("score"))


def first_view(ranked: DataFrame) -> DataFrame:
    """One row a chunk of a query: the view of its first leg, with the legs that hold it."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.min_by("score", "leg").alias("score"), F.min("leg").alias("leg"), F.count_distinct("leg").alias("n_legs"))


def merged_views(views: dict[str, DataFrame]) -> DataFrame:
    """One row a chunk of a query with the columns of all views ``(query_id, chunk_id, ...)``; where several have a column, the first view's non-null value counts.

    ``leg`` is the first view that holds the chunk, ``n_legs`` how many do.
    """
    columns = list(dict.fromkeys(c for df in views.values() for c in df.columns if c not in ("query_id", "chunk_id")))
    every = None
    for at, (name, df) in enumerate(views.items()):
        one = df.select("query_id", "chunk_id", F.lit(name).alias("leg"), F.lit(at).alias("_at"), *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
        every = one if every is None else every.unionByName(one)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in columns]
    return every.groupBy("query_id", "chunk_id").agg(F.min_by("leg", "_at").alias("leg"), F.count_distinct("leg").alias("n_legs"), *first)


def feedback_boost(ranked: DataFrame, feedback: DataFrame, multiplier: float) -> DataFrame:
    """Scores raised by positive feedback totals, ranked again; negative totals and unknown chunks change nothing."""
    raised = ranked.join(feedback, "chunk_id", "left").withColumn("boosted", F.round(F.col("score") + multiplier * F.greatest(F.coalesce("feedback", F.lit(0.0)), F.lit(0.0)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank")
    return raised.select("query_id", "chunk_id", "boosted", F.row_number().over(order).cast("bigint").alias("new_rank"))
