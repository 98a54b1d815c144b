"""Stages that a language model takes part in.

What the model wrote comes as a column or table ``response``, made by a model slot or recorded; a stage reads it and has its effect on the
tables.  A response that is null or can't be read leads to the stage's fallback, as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import answers as A

#: Fixed value: what is answered where there is no context.
NO_CONTEXT = "I don't have enough information in the provided documents to answer this question."


def query_variants(queries: DataFrame, n: int) -> DataFrame:
    """``(query_id, variant_no, text)`` of ``(query_id, query, expansion, step_back)``: the question, up to ``n`` expansions, the broader question; each text once."""
    expansions = F.slice(F.coalesce(A.string_list(F.col("expansion")), F.array().cast("array<string>")), 1, n)
    texts = F.concat(F.array(F.trim("query")), expansions, F.array(F.coalesce(F.trim("step_back"), F.lit(""))))
    once = F.array_distinct(F.filter(texts, lambda t: t != ""))
    return queries.select("query_id", F.posexplode(once).alias("variant_no", "text")).withColumn("variant_no", F.col("variant_no").cast("bigint"))


def classified(queries: DataFrame) -> DataFrame:
    """``queries`` with ``kind`` and its retrieval settings; what can't be read is factual."""
    kind = F.lower(A.json_object(F.col("response"), "struct<category:string>")["category"])
    known = F.when(kind.isin(*A.STRATEGIES), kind).otherwise("factual")
    return queries.withColumn("kind", known).select("*", A.strategy(F.col("kind")).alias("s")).select("*", "s.*").drop("s")


def propositions(segments: DataFrame, least: int = 7) -> DataFrame:
    """``(document_id, proposition_index, text)`` of ``(document_id, segment_no, response, graded)``.

    ``response`` lists a segment's propositions, ``graded`` is an array of the answers that grade them, in order.  Those with all four grades
    of at least ``least`` stay, each wording once a document, its first.
    """
    listed = F.coalesce(A.string_list(F.col("response")), F.array().cast("array<string>"))
    each = segments.select("document_id", "segment_no", "graded", F.posexplode(listed).alias("pos", "text"))
    graded = each.withColumn("g", A.grades(F.get("graded", F.col("pos")))).where(F.least(*[F.col(f"g.{a}") for a in A.AXES]) >= least)
    first = graded.groupBy("document_id", A.proposition_key(F.col("text")).alias("key")).agg(F.min(F.struct("segment_no", "pos", "text")).alias("f"))
    order = Window.partitionBy("document_id").orderBy("f.segment_no", "f.pos")
    return first.select("document_id", (F.row_number().over(order) - 1).cast("bigint").alias("proposition_index"), F.col("f.text").alias("text"))


def question_chunks(chunks: DataFrame) -> DataFrame:
    """``(source_chunk_id, question_no, text)`` of ``(chunk_id, response)``: a chunk's synthetic questions; a chunk without a readable answer has none."""
    return chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.posexplode(F.array_distinct(A.string_list(F.col("response")))).alias("question_no", "text")).withColumn("question_no", F.col("question_no").cast("bigint"))


def with_summaries(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """``(document_id, chunk_id, type, text)``: every chunk as 'detail', and for each document with a non-blank ``response`` a 'summary' chunk."""
    details = chunks.select("document_id", "chunk_id", F.lit("detail").alias("type"), "text")
    made = responses.where(F.trim("response") != "").select("document_id", F.concat(F.lit("summary:"), "document_id").alias("chunk_id"), F.lit("summary").alias("type"), F.trim("response").alias("text"))
    return details.unionByName(made)


def graph_edges(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, subject, relation, object)`` of ``(chunk_id, response)``, each edge once."""
    return chunks.select("chunk_id", F.explode(A.triples(F.col("response"))).alias("t")).select("chunk_id", "t.subject", "t.relation", "t.object").distinct()


def self_check(rows: DataFrame, need: Column, support: Column, utility: Column) -> DataFrame:
    """``rows`` with ``retrieve``, ``supported``, ``score`` and ``action`` of the three checks; unread ones retrieve, support and accept at 0.5."""
    needed = A.json_object(need, "struct<need_retrieval:boolean>")["need_retrieval"]
    supported = A.json_object(support, "struct<supported:boolean>")["supported"]
    useful = A.json_object(utility, "struct<score:double,action:string,refined_query:string>")
    valid = useful["score"].between(0, 1) & useful["action"].isin("accept", "re_retrieve", "refuse")
    return rows.select(
        "*", F.coalesce(needed, F.lit(True)).alias("retrieve"), F.coalesce(supported, F.lit(True)).alias("supported"),
        F.coalesce(F.when(valid, useful["score"]), F.lit(0.5)).alias("score"), F.coalesce(F.when(valid, useful["action"]), F.lit("accept")).alias("action"),
    )


def spread_to_group(given: DataFrame, hits: DataFrame, value: str) -> DataFrame:
    """``(query_id, chunk_id, value)``: what was said of a passage's representative, else of its best sibling, for all its members.

    ``hits`` is ``(query_id, passage, chunk_id, rank)``, ``given`` ``(query_id, chunk_id, value)``; passages nothing was said of are left out.
    """
    said = hits.join(given, ["query_id", "chunk_id"]).groupBy("query_id", "passage").agg(F.min_by(value, "rank").alias(value))
    return hits.join(said, ["query_id", "passage"]).select("query_id", "chunk_id", value)


def citations(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, source_id, chunk_id, pos)``: what each cited id stands for, a chunk itself or the chunk it was merged into; each id once, ids that lead nowhere left out.

    ``sources`` is ``(query_id, pos, source_id)``, ``chunks`` ``(query_id, chunk_id, merged_ids)``.
    """
    own = chunks.select("query_id", F.col("chunk_id").alias("source_id"), "chunk_id", F.lit(0).alias("way"))
    merged = chunks.select("query_id", F.explode("merged_ids").alias("source_id"), "chunk_id", F.lit(1).alias("way"))
    first = sources.groupBy("query_id", "source_id").agg(F.min("pos").alias("pos"))
    return first.join(own.unionByName(merged), ["query_id", "source_id"]).groupBy("query_id", "source_id", "pos").agg(F.min_by("chunk_id", F.struct("way", "chunk_id")).alias("chunk_id"))


def answered(questions: DataFrame) -> DataFrame:
    """``(query_id, answer, token_count)`` of ``(query_id, context, response)``: without context a fixed reply, whatever the model says."""
    text = F.when(F.coalesce(F.trim("context"), F.lit("")) == "", NO_CONTEXT).otherwise(F.coalesce("response", F.lit("")))
    return questions.select("query_id", text.alias("answer"), A.word_count(text).alias("token_count"))


def corrected_context(rows: DataFrame) -> DataFrame:
    """``(query_id, action, context)`` of ``(query_id, action, retrieved, web)``: use what was retrieved, put the web below it, or take the web alone."""
    web = F.coalesce(F.trim("web"), F.lit(""))
    both = F.when(web == "", F.col("retrieved")).otherwise(F.concat(F.col("retrieved"), F.lit("\n\n"), web))
    context = F.when(F.col("action") == "use", F.col("retrieved")).when(F.col("action") == "combine", both).otherwise(web)
    return rows.select("query_id", "action", context.alias("context"))


def reranked(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, rank)`` of ``(query_id, chunk_id, rank, rescore)``: by the new score; a query that lacks one for any hit keeps its first k."""
    group = Window.partitionBy("query_id")
    failed = F.max(F.when(F.col("rescore").isNull(), 1).otherwise(0)).over(group) == 1
    judged = hits.withColumn("key", F.when(failed, F.lit(0.0)).otherwise(-F.col("rescore")))
    order = group.orderBy("key", "rank", "chunk_id")
    return judged.select("query_id", "chunk_id", F.row_number().over(order).cast("bigint").alias("rank")).where(F.col("rank") <= k)
