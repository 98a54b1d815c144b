"""One retrieval: legs, fusion, feedback, rerank, diversity, segments, parents, grading, compression, final cap.

Every stage is a function over tables for the whole batch of queries; ``Config`` switches stages on, and ``retrieve`` composes the plan.  A leg that
is absent only takes itself out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import context, fusion, quality, stages
from rivulet.session import materialize


@dataclass
class Config:
    """``weights`` by leg; the numbers are how many rows each stage passes on; None, or a table that is not given, leaves a stage out."""

    k: int = 5
    candidates: int = 30
    weights: dict[str, float] = field(default_factory=dict)
    feedback: float = 0.0
    rerank: int | None = 10
    diversity: float | None = None
    segment_tokens: int | None = None
    parents: bool = True
    least_grade: float | None = None
    budget: int | None = None


def fused(legs: dict[str, DataFrame | None], config: Config) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` of the legs that are there, each ``(query_id, chunk_id, rank)``."""
    there = [df.select("query_id", F.lit(name).alias("leg"), "chunk_id", F.col("rank").cast("bigint").alias("rank")).where(F.col("rank") <= config.candidates) for name, df in legs.items() if df is not None]
    if not there:
        raise ValueError("no leg")
    return fusion.rrf(reduce(DataFrame.unionByName, there), config.weights, config.candidates)


def retrieve(legs: dict[str, DataFrame | None], chunks: DataFrame, config: Config, feedback: DataFrame | None = None, rescores: DataFrame | None = None, vectors: DataFrame | None = None, grades: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, rank, context)`` of a batch of queries.

    ``chunks`` is ``(chunk_id, document_id, chunk_index, chunk_type, parent_id, text)``; ``rescores`` ``(query_id, chunk_id, rescore)``, where a missing
    score makes its query keep the fused order; ``grades`` ``(query_id, chunk_id, grade)``; ``vectors`` ``(chunk_id, v)``.
    """
    hits = fused(legs, config)
    if feedback is not None and config.feedback > 0:
        hits = fusion.feedback_boost(hits, feedback, config.feedback).select("query_id", "chunk_id", F.col("new_rank").alias("rank"))
    if rescores is not None and config.rerank is not None:
        hits = stages.reranked(hits.join(rescores, ["query_id", "chunk_id"], "left"), config.rerank)
    elif config.rerank is not None:
        hits = hits.where(F.col("rank") <= config.rerank)
    if vectors is not None and config.diversity is not None:
        hits = context.mmr(hits.join(vectors, "chunk_id"), config.diversity, config.rerank or config.candidates).select("query_id", "chunk_id", F.col("mmr_rank").alias("rank"))
    # up to here only ids and ranks went through, now written once; texts are joined to what is left
    shown = materialize(hits.select("query_id", "chunk_id", "rank"), "hits").join(chunks, "chunk_id")
    if config.segment_tokens is not None:
        merged = context.merge_segments(shown, config.segment_tokens)
        shown = merged.join(chunks.select("chunk_id", "document_id", "parent_id"), "chunk_id")
    if config.parents:
        shown = context.without_redundant_parents(context.with_parents(shown, chunks.select("chunk_id", "text")))
        passage = F.when(F.col("enriched"), F.col("parent_id")).otherwise(F.col("chunk_id"))
    else:
        shown, passage = shown.withColumn("context", F.col("text")), F.col("chunk_id")
    shown = shown.select("query_id", "chunk_id", passage.alias("passage"), "context", "rank")
    if grades is not None and config.least_grade is not None:
        shown = quality.relevance_gate(shown, grades, config.least_grade).select("query_id", "chunk_id", "passage", "context", "rank")
    if config.budget is not None:
        shown = context.compress(shown.select("query_id", "chunk_id", "passage", F.col("context").alias("text"), "rank"), config.budget).withColumnRenamed("text", "context")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return shown.select("query_id", "chunk_id", F.row_number().over(order).cast("bigint").alias("rank"), "context").where(F.col("rank") <= config.k)
