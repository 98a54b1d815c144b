"""Grading of retrieved passages and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevance_gate(hits: DataFrame, grades: DataFrame, least: float) -> DataFrame:
    """Hits ``(query_id, passage, chunk_id, rank)`` of passages whose representative, the hit of best rank, is graded at least so.

    ``grades`` is ``(query_id, chunk_id, grade)``; ungraded passages are dropped, groups stay whole.
    """
    rep = hits.groupBy("query_id", "passage").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    kept = rep.join(grades, ["query_id", "chunk_id"]).where(F.col("grade") >= least).select("query_id", "passage", "grade")
    return hits.join(kept, ["query_id", "passage"])


def corrective_action(score: Column, lower: float, upper: float) -> Column:
    """'use' above the upper threshold, 'web' below the lower, else 'combine'; ungraded retrieval is used as it is."""
    return F.when(score.isNull(), "use").when(score > upper, "use").when(score < lower, "web").otherwise("combine")


def supported_share(claims: Column) -> Column:
    """Faithfulness from judged claims ``array<struct<supported>>``: no claims count as faithful."""
    good = F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False))))
    return F.when(F.coalesce(F.size(claims), F.lit(0)) <= 0, F.lit(1.0)).otherwise(good / F.size(claims))


def first_resolved(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(row_id, chunk_id, modality)``: of each row's ids in order the first that exists."""
    return ids.join(chunks, "chunk_id").groupBy("row_id").agg(F.min_by(F.struct("chunk_id", "modality"), "pos").alias("s")).select("row_id", "s.chunk_id", "s.modality")
