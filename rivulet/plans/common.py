"""Inputs that several plans share, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.text import SPACE, strip
from rivulet.functions.vectors import sparse
from rivulet.operators import lexical
from rivulet.operators.dense import dense_scores, sparse_scores
from rivulet.operators.references import clean_key
from rivulet.sources.tables import table

#: SPACE for DuckDB's regex dialect is the same text.
SQL_SPACE = SPACE


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk once, its id as ``chunk_id``, without vectors."""
    return table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "text", "chunk_type", "modality", "parent_id", "page_no", "created_at", "deleted_at").distinct()


def brief(spark: SparkSession, sf_dir: str, **made: Column) -> DataFrame:
    """``chunks`` with columns made from the text in its place.  Texts are told apart by digests, so none is shuffled."""
    digest = F.unhex(F.md5(F.col("text"))).alias("_digest")
    rows = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", digest, "chunk_type", "modality", "parent_id", "page_no", "created_at", "deleted_at", *[c.alias(name) for name, c in made.items()])
    return rows.distinct().drop("_digest")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions with text, once each."""
    return table(spark, sf_dir, "retrieval_dataset").select(F.col("id").alias("query_id"), "query").where(strip(F.col("query")) != "").distinct()


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, chunk_id)`` of the golden questions, ids in comparable form."""
    rows = table(spark, sf_dir, "retrieval_dataset").where(strip(F.col("query")) != "")
    return rows.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("c")).where("c IS NOT NULL").select("query_id", clean_key(F.col("c")).alias("chunk_id")).distinct()


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """The index over all chunks, once an application."""
    texts = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "text")
    return lexical.open_index(texts)


def bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.search(lexical_index(spark, sf_dir), lexical.query_terms(questions(spark, sf_dir)), k)


def bm25_relevant(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """``bm25`` for metrics at k: queries whose k best hold no relevant chunk, which score 0, may be left out."""
    return lexical.search_wanted(lexical_index(spark, sf_dir), lexical.query_terms(questions(spark, sf_dir)), relevant(spark, sf_dir), k)


def vector_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of ``embeddings``, and as queries those whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    return rows, rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "v", F.col("label").alias("query_label"))


def legs(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Ranked lists of the vector queries: leg '1dense' by cosine, leg '2sparse' by entries over 0.1."""
    rows, asked = vector_rows(spark, sf_dir)
    dense = dense_scores(asked, rows, k).select("query_id", F.lit("1dense").alias("leg"), "chunk_id", "score", "rank")
    weights = lambda df, key: df.select(key, sparse(F.transform("v", lambda x: x.cast("double")), 0.1).alias("w"))
    second = sparse_scores(weights(asked, "query_id"), weights(rows, "chunk_id"), k).select("query_id", F.lit("2sparse").alias("leg"), "chunk_id", "score", "rank")
    return dense.unionByName(second)


def ranked(scores: DataFrame) -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")


SQL_CHUNKS = "ch AS (SELECT DISTINCT id AS chunk_id, document_id, chunk_index, text, chunk_type, modality, parent_id, page_no, created_at, deleted_at FROM chunks)"
SQL_QUESTIONS = f"""qs AS (SELECT DISTINCT id AS query_id, query FROM retrieval_dataset WHERE regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g') <> '')"""
SQL_RELEVANT = f"""rel AS (SELECT DISTINCT query_id, lower(regexp_replace(c, '^\\s+|\\s+$', '', 'g')) AS chunk_id
  FROM (SELECT id AS query_id, unnest(relevant_chunk_ids) AS c FROM retrieval_dataset WHERE regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g') <> '') WHERE c IS NOT NULL)"""


def sql_index(source: str = "SELECT chunk_id, text FROM ch WHERE text IS NOT NULL") -> str:
    return f"""
words AS MATERIALIZED (SELECT chunk_id, list_filter(string_split_regex(lower(text), '{SPACE}+'), lambda x: x <> '') AS ws FROM ({source})),
dlen AS MATERIALIZED (SELECT chunk_id, len(ws) AS dl FROM words),
postings AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM words) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n_chunks, CAST(coalesce(sum(dl), 0) AS BIGINT) AS total_len, avg(dl) AS avg_len FROM dlen),
rawidf AS (SELECT term, count(*) AS df, ln(any_value(n_chunks) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw FROM postings, corpus GROUP BY term),
stats AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf)"""


def sql_bm25(queries: str = "qs") -> str:
    return f"""
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '{SPACE}+'), lambda x: x <> '')) AS term FROM {queries}) GROUP BY 1, 2),
weights AS MATERIALIZED (SELECT term, chunk_id, idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avg_len)) AS w
  FROM postings JOIN stats USING (term) JOIN dlen USING (chunk_id), corpus WHERE term IN (SELECT term FROM qterms)),
scored AS MATERIALIZED (SELECT query_id, chunk_id, round(sum(w * qtf), 6) AS score FROM weights JOIN qterms USING (term) GROUP BY 1, 2 HAVING round(sum(w * qtf), 6) > 0)"""


def sql_top(k: int, scored: str = "scored") -> str:
    return f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {scored}) WHERE rank <= {k}"


SQL_COSINE = """
v AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT chunk_id AS query_id, v AS qv, label AS query_label FROM v WHERE chunk_id % 50 = 0),
cosines AS MATERIALIZED (SELECT query_id, chunk_id, label, query_label, round(list_cosine_similarity(qv, v), 6) AS score FROM q, v)"""
SQL_SPARSE = """
entries AS (SELECT chunk_id, i, CAST(embedding[i] AS DOUBLE) AS w FROM (SELECT vec_id AS chunk_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) WHERE embedding[i] > 0.1e0),
dots AS MATERIALIZED (SELECT a.chunk_id AS query_id, b.chunk_id, round(sum(a.w * b.w), 6) AS score FROM entries a JOIN entries b USING (i) WHERE a.chunk_id % 50 = 0 GROUP BY 1, 2)"""


def sql_legs(k: int) -> str:
    return f"""{SQL_COSINE}, {SQL_SPARSE},
legs AS MATERIALIZED (SELECT query_id, '1dense' AS leg, chunk_id, score, rank FROM ({sql_top(k, "cosines")}) UNION ALL SELECT query_id, '2sparse', chunk_id, score, rank FROM ({sql_top(k, "dots")}))"""
