"""Incremental ingestion as joins of arriving documents with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ingest_status(arriving: DataFrame, catalogue: DataFrame, key: str = "source_path", digest: str = "digest") -> DataFrame:
    """``arriving`` with ``status``: 'new', 'changed' or 'unchanged' against the catalogue's row of the same key.

    A null digest counts as changed: its content cannot be vouched for.
    """
    known = catalogue.select(key, F.col(digest).alias("_known"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "new").when(F.col(digest) == F.col("_known"), "unchanged").otherwise("changed")
    return arriving.join(known, key, "left").withColumn("status", status).drop("_known", "_there")


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order (descending expressions, then tie keys)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def superseded(old_links: DataFrame, new_links: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """``(document_id, chunk_id)`` of a document's old chunks that its new version neither has nor retains.

    Documents that are not in the new version lose nothing.
    """
    again = old_links.join(new_links.select("document_id").distinct(), "document_id", "left_semi")
    gone = again.join(new_links, ["document_id", "chunk_id"], "left_anti")
    return gone if retained is None else gone.join(retained, "chunk_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; ``keep`` columns survive from the old row where it has them."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    take = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[take(c).alias(c) for c in columns])


def needs_upsert(built: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Built chunks that are not stored yet, or with another text."""
    s = stored.select(key, F.col(text).alias("_stored"), F.lit(True).alias("_there"))
    return built.join(s, key, "left").where(F.col("_there").isNull() | ~F.col(text).eqNullSafe(F.col("_stored"))).drop("_stored", "_there")


def stale_structured(known: DataFrame, built: DataFrame) -> DataFrame:
    """``(document_id, chunk_id)`` of known structured chunks to delete: those a document's complete build no longer has.

    ``built`` is ``(document_id, chunk_id, ok)``; where any chunk of a document failed, its old chunks are retained.
    """
    complete = built.groupBy("document_id").agg(F.bool_and("ok").alias("ok")).where("ok")
    return known.join(complete, "document_id", "left_semi").join(built, ["document_id", "chunk_id"], "left_anti")


def cache_split(texts: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``texts`` with ``hit``: whether the cache holds their key."""
    return texts.join(cache.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
