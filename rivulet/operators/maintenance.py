"""Keeping an index: removals, updates, reads and the small projections around them.

Tables are immutable: every function gives the next version, which ``LexicalIndex.save`` or a plain write makes the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remove_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks without those of ``(chunk_id)``; no ids change nothing."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def remove_documents(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(document_id, chunk_id)`` of the chunks that leave with ``(document_id)``, and the chunks that stay."""
    gone = documents.select("document_id").distinct()
    return chunks.join(gone, "document_id", "left_semi").select("document_id", "chunk_id"), chunks.join(gone, "document_id", "left_anti")


def merge_columns(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of ``updates``; unknown keys are ignored, so the number of rows stays."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != key])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c != key and c in updates.columns else F.col(c) for c in rows.columns])


def present(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``asked`` with ``present``: whether the index has the chunk."""
    return asked.join(chunks.select("chunk_id").distinct().withColumn("_there", F.lit(True)), "chunk_id", "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def with_feedback(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``feedback``, 0 where nothing was said."""
    return rows.join(totals.select(key, F.col("feedback").alias("_f")), key, "left").withColumn("feedback", F.coalesce("_f", F.lit(0.0))).drop("_f")


def feedback_value(value: Column) -> Column:
    """A stored feedback value as a number: true and false are none, what is no number is 0."""
    text = F.lower(value.cast("string"))
    return F.when(text.isin("true", "false"), 0.0).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.0)))


def checked_votes(votes: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """``votes`` with the chunk they are for, and ``refused`` where the index has none."""
    known = chunks.withColumn("_there", F.lit(True))
    return votes.join(known, key, "left").withColumn("refused", F.col("_there").isNull()).drop("_there")


def distinct_models(rows: DataFrame, column: str) -> DataFrame:
    """One row ``(n_models, mixed)``."""
    return rows.agg(F.count_distinct(column).alias("n_models")).select("n_models", (F.col("n_models") > 1).alias("mixed"))


def live_hits(asked: DataFrame, cache: DataFrame, now: Column, days: int) -> DataFrame:
    """``asked`` with ``hit``: whether ``cache(key, stored_at)`` holds the key and the entry is not older than ``days``."""
    live = cache.where(F.col("stored_at") >= now - F.make_dt_interval(F.lit(days))).select("key").distinct().withColumn("_hit", F.lit(True))
    return asked.join(live, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def section(own: Column, sections: Column, headings: Column) -> Column:
    """A chunk's section: its own, else the first of the document's sections, else of its headings."""
    return F.coalesce(own, F.get(sections, 0), F.get(headings, 0))


def protected(path: Column, method: Column, guarded: list[str], exempt: list[str]) -> Column:
    """Whether a request is counted by the limiter: a guarded path or one below it, not exempt, and no OPTIONS request."""
    below = lambda p: (path == p) | path.startswith(p.rstrip("/") + "/")
    hit, spared = F.lit(False), F.lit(False)
    for p in guarded:
        hit = hit | below(p)
    for p in exempt:
        spared = spared | (path == p)
    return hit & ~spared & (F.upper(method) != "OPTIONS")


def resolved_vectors(hits: DataFrame, stored: DataFrame, made: Column) -> DataFrame:
    """``hits(query_id, chunk_id, v)`` with a vector each, its own, the stored one or ``made``, and ``complete``: whether all of a query have one."""
    joined = hits.join(stored.select("chunk_id", F.col("v").alias("_stored")), "chunk_id", "left").withColumn("v", F.coalesce("v", "_stored", made)).drop("_stored")
    whole = joined.groupBy("query_id").agg(F.bool_and(F.col("v").isNotNull()).alias("complete"))
    return joined.join(whole, "query_id")


def request_filter(**given: Column) -> Column:
    """A struct of the filters a request sets, null where it sets none."""
    some = F.lit(False)
    for c in given.values():
        some = some | c.isNotNull()
    return F.when(some, F.struct(*[c.alias(n) for n, c in given.items()]))
