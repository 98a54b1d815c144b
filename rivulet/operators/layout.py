"""Chunks from a document's layout: tables, captions and figures, with ids that stay the same from load to load.

A document is ``(document_id, source, content, tables, figures)``: ``tables`` is an array of (table_id, text), ``figures`` of
(figure_id, caption, asset_path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespaces of the ids, and the text of a figure without a caption.
TABLE_SPACE = "a3f8c2e17b4d4e9f8c1a2d6e5f0b9a37"
FIGURE_TEXT = "[figure]"
#: Namespaces of captions and figures, of our own making.
CAPTION_SPACE, FIGURE_SPACE = "5d0c8a4c2f0e5b6a9c3d7e1f4a8b2c60", "7b1e9f3a6c2d5e80a4b7c9d1e3f50627"
#: A table of pipes: a row of cells, a row of dashes, further rows.
TABLE = r"(?m)(^\|.+\|\n\|(?: *:?-+:? *\|)+(?:\n\|.+\|)+)"


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a namespace of 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def content_tables(content: Column) -> Column:
    """The tables of a text in their order."""
    return F.transform(F.regexp_extract_all(content, F.lit(TABLE), F.lit(1)), lambda t: F.trim(t))


def _id(namespace: str, source: Column, own: Column) -> Column:
    return uuid5(namespace, F.concat(source, F.lit(":"), own))


def table_chunks(documents: DataFrame) -> DataFrame:
    """``(chunk_id, document_id, table_id, text)``: a table's own text, else for 'table-N' the N-th table of the content; tables without an id or text give none."""
    each = documents.select("document_id", "source", content_tables(F.col("content")).alias("found"), F.explode("tables").alias("t")).select("*", "t.table_id", "t.text").where("table_id != ''")
    nth = F.regexp_extract("table_id", r"^table-(\d{1,9})$", 1).try_cast("int")
    text = F.coalesce(F.when(F.trim("text") != "", F.trim("text")), F.when(nth >= 1, F.get("found", nth - 1)))
    return each.select(_id(TABLE_SPACE, F.col("source"), F.col("table_id")).alias("chunk_id"), "document_id", "table_id", text.alias("text")).where("text != ''")


def caption_chunks(documents: DataFrame) -> DataFrame:
    """``(chunk_id, document_id, figure_id, asset_path, text)`` of the figures with a caption."""
    each = documents.select("document_id", "source", F.explode("figures").alias("f")).select("document_id", "source", "f.*").where("figure_id != ''")
    return each.select(_id(CAPTION_SPACE, F.col("source"), F.col("figure_id")).alias("chunk_id"), "document_id", "figure_id", "asset_path", F.trim("caption").alias("text")).where("text != ''")


def figure_chunks(documents: DataFrame) -> DataFrame:
    """``(chunk_id, document_id, figure_id, asset_path, text)`` of the figures with an asset: its caption, else a fixed text."""
    each = documents.select("document_id", "source", F.explode("figures").alias("f")).select("document_id", "source", "f.*").where("figure_id != '' AND asset_path != ''")
    text = F.coalesce(F.when(F.trim("caption") != "", F.trim("caption")), F.lit(FIGURE_TEXT))
    return each.select(_id(FIGURE_SPACE, F.col("source"), F.col("figure_id")).alias("chunk_id"), "document_id", "figure_id", "asset_path", text.alias("text"))


def asset_path(root: str, source: Column, figure_id: Column, extension: Column) -> Column:
    """Where a figure's picture is kept: below the stem of its source and a digest of the whole source."""
    name = F.regexp_replace(F.substring_index(F.replace(source, F.lit("\\"), F.lit("/")), "/", -1), r"(.)\.[^.]*$", "$1")
    return F.concat(F.lit(root.rstrip("/") + "/"), name, F.lit("-"), F.substring(F.sha2(source, 256), 1, 16), F.lit("/"), figure_id, F.lit("."), extension)


def cached_captions(figures: DataFrame, cache: DataFrame, vision: Column) -> DataFrame:
    """``(figure_id, caption, origin)`` of ``(figure_id, asset_hash, caption)``: the cached caption if it was made for this asset, else the model's, else its own.

    ``cache`` is ``(figure_id, asset_hash, cached)``; a figure without an asset keeps its own caption.
    """
    c = cache.select("figure_id", F.col("asset_hash").alias("_for"), "cached")
    joined = figures.join(c, "figure_id", "left").withColumn("_vision", vision)
    there = F.col("asset_hash").isNotNull()
    cached = F.when(there & (F.col("_for") == F.col("asset_hash")) & (F.trim("cached") != ""), F.col("cached"))
    seen = F.when(there & (F.trim("_vision") != ""), F.trim("_vision"))
    origin = F.when(cached.isNotNull(), "cache").when(seen.isNotNull(), "vision").otherwise("own")
    return joined.select("figure_id", F.coalesce(cached, seen, "caption").alias("caption"), origin.alias("origin"))


def structured_ids(built: DataFrame, known: DataFrame) -> DataFrame:
    """``(document_id, chunk_id, fate)`` of chunks built now ``(document_id, chunk_id, ok)`` and known before ``(document_id, chunk_id)``.

    'new', 'kept', 'failed' (built but not embedded), 'stale' (known, no longer built, all others well) or 'retained' (known, no longer built, but some failed).
    """
    well = built.groupBy("document_id").agg(F.bool_and("ok").alias("well"))
    joined = built.join(known.select("document_id", "chunk_id", F.lit(True).alias("was")), ["document_id", "chunk_id"], "full").join(well, "document_id", "left")
    fate = F.when(F.col("ok").isNull(), F.when(F.coalesce("well", F.lit(False)), "stale").otherwise("retained")).when(~F.col("ok"), "failed").when(F.col("was"), "kept").otherwise("new")
    return joined.select("document_id", "chunk_id", fate.alias("fate"))
