"""Chunks that stand for others: questions, summaries, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.text import entity_names
from rivulet.operators.lexical import word_search
from rivulet.session import materialize, release

#: Chunk types and the indexes they go to.
VECTOR_ONLY = ("hype_question", "summary")
MODALITY = {"table": "table", "figure": "figure", "caption": "caption", "page": "page"}


def modality(explicit: Column, kind: Column) -> Column:
    """An explicit modality other than text, else what the type implies, else text."""
    implied = F.lit("text")
    for name, value in MODALITY.items():
        implied = F.when(kind == name, value).otherwise(implied)
    return F.when(explicit.isNotNull() & (explicit != "text"), explicit).otherwise(implied)


def routes(kind: Column) -> Column:
    """'vector' or 'both': where a chunk of this type is indexed."""
    return F.when(kind.isin(*VECTOR_ONLY), "vector").otherwise("both")


def resolve_questions(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Hits on questions as hits on the chunks they were made from: ``(query_id, chunk_id, score, rank)``.

    ``links`` is ``(chunk_id, source_id)``; a hit without a link stands for itself, one whose source is null is
    dropped.  Of several questions of one source the best score and rank count; order by rank, then key.
    """
    joined = hits.join(links.withColumn("linked", F.lit(True)), "chunk_id", "left").withColumn("to", F.when(F.col("linked"), F.col("source_id")).otherwise(F.col("chunk_id"))).where("to IS NOT NULL")
    best = joined.groupBy("query_id", F.col("to").alias("chunk_id")).agg(F.max("score").alias("score"), F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "chunk_id")
    return best.select("query_id", "chunk_id", "score", F.row_number().over(order).cast("bigint").alias("rank"))


def scoped(summaries: DataFrame, details: DataFrame, n: int = 3) -> DataFrame:
    """Detail hits in the documents of a query's first ``n`` summary hits."""
    scope = summaries.where(F.col("rank") <= n).select("query_id", "document_id").distinct()
    return details.join(scope, ["query_id", "document_id"], "left_semi")


def mentions(chunks: DataFrame) -> DataFrame:
    """``(entity, chunk_id, document_id)`` edges from the capitalised words of texts."""
    return chunks.select(F.explode(entity_names(F.col("text"))).alias("entity"), "chunk_id", "document_id")


def entity_hits(queries: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: share of a query's entities that a chunk mentions.

    A search whose words are the entities, all of one weight: a row per query and chunk that share a common name is never made.
    """
    asked = queries.select("query_id", F.explode(entity_names(F.col("query"))).alias("entity")).distinct()
    held = materialize(edges.groupBy("chunk_id").agg(F.collect_set(F.xxhash64("entity")).alias("ts")), "mentions")
    terms = asked.select("query_id", F.xxhash64("entity").alias("t"), F.lit(1.0).alias("qtf"), F.lit(1.0).alias("idf"))
    found = word_search(terms, held, held.count(), k)
    release(held)
    count = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    return found.join(count, "query_id").select("query_id", "chunk_id", F.round(F.col("score") / F.col("n"), 6).alias("score"), "rank")
