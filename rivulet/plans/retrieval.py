"""Queries of search, fusion and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.text import content_hash, context_header, entity_names, token_estimate
from rivulet.operators import context, dense, enrich, fusion, lexical
from rivulet.plans import common as C
from rivulet.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


HITS = f"WITH {C.SQL_CHUNKS}, {C.SQL_QUESTIONS}, {C.sql_index()}, {C.sql_bm25()}"


@query(f"WITH {C.SQL_CHUNKS}, {C.sql_index()} SELECT term, df, round(idf, 6) AS idf FROM stats")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.lexical_index(spark, d).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {C.SQL_CHUNKS}, {C.sql_index()} SELECT n_chunks, total_len, round(avg_len, 6) AS avg_len FROM corpus")
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.lexical_index(spark, d).corpus.select("n_chunks", "total_len", F.round("avg_len", 6).alias("avg_len"))


@query(f"{HITS} {C.sql_top(10)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return C.bm25(spark, d, 10)


@query(f"{HITS}, kept AS (SELECT s.* FROM scored s JOIN ch USING (chunk_id) WHERE modality = 'table') {C.sql_top(5, 'kept')}")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes after scoring with the statistics of the whole index, and before the limit."""
    tables = table(spark, d, "chunks").where("modality = 'table'").select(F.col("id").alias("chunk_id"))
    return lexical.search(C.lexical_index(spark, d), lexical.query_terms(C.questions(spark, d)), 5, tables)


#: The published lexical benchmark: rows of its corpus, its needle, and its searches as one batch.
FIXTURE_ROWS, NEEDLE, SEARCHES = 100_000, 42_000, 20


def fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    text = F.concat(F.when(i == NEEDLE, "unique needle xyzzy scale fixture marker ").otherwise(""), F.lit("token"), (i % 97).cast("string"), F.lit(" document row "), i.cast("string"), F.lit(" content payload"))
    corpus = spark.range(0, FIXTURE_ROWS, 1, 8).select(F.concat(F.lit("chunk-"), i.cast("string")).alias("chunk_id"), text.alias("text"))
    asked = F.when(i % 2 == 0, "unique needle xyzzy").otherwise(F.concat(F.lit("token"), (i % 97).cast("string"), F.lit(" document")))
    return corpus, spark.range(SEARCHES).select(i.cast("string").alias("query_id"), asked.alias("query"))


_FIXTURE = f"""WITH ch AS (SELECT 'chunk-' || i AS chunk_id, (CASE WHEN i = {NEEDLE} THEN 'unique needle xyzzy scale fixture marker ' ELSE '' END) || 'token' || (i % 97) || ' document row ' || i || ' content payload' AS text FROM range({FIXTURE_ROWS}) t(i)),
qs AS (SELECT CAST(i AS VARCHAR) AS query_id, CASE WHEN i % 2 = 0 THEN 'unique needle xyzzy' ELSE 'token' || (i % 97) || ' document' END AS query FROM range({SEARCHES}) t(i))"""


@query(f"{_FIXTURE}, {C.sql_index()}, {C.sql_bm25()} {C.sql_top(5)}")
def bm25_100k(spark: SparkSession, d: str) -> DataFrame:
    corpus, asked = fixture(spark)
    return lexical.search(lexical.build_index(corpus), lexical.query_terms(asked), 5)


@query(f"""WITH {C.SQL_CHUNKS}, {C.sql_index("SELECT chunk_id, text FROM ch WHERE text IS NOT NULL AND deleted_at IS NULL")} SELECT term, df FROM stats""")
def soft_view_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies after the deletions, from those before and the deleted chunks alone."""
    chunks = C.chunks(spark, d)
    base = C.lexical_index(spark, d).term_stats
    gone = lexical.build_index(chunks.where("deleted_at IS NOT NULL"), persist=False).postings
    return lexical.soft_view(base, gone.select("term", F.lit(-1).alias("sign")))


_HALF = "created_at >= TIMESTAMP '2025-07-01 00:00:00'"


@query(f"""WITH {C.SQL_CHUNKS}, old AS (SELECT chunk_id, document_id, 'old' AS version FROM ch), new AS (SELECT chunk_id, document_id, 'new' AS version FROM ch WHERE {_HALF})
SELECT version, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM (SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT * FROM new) GROUP BY 1""")
def index_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.chunks(spark, d)
    old = chunks.select("chunk_id", "document_id", F.lit("old").alias("version"))
    new = chunks.where(_HALF).select("chunk_id", "document_id", F.lit("new").alias("version"))
    return lexical.last_write_wins(old, new).groupBy("version").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"))


# --- dense, sparse, fusion


@query(f"WITH {C.SQL_COSINE} {C.sql_top(10, 'cosines')}")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = C.vector_rows(spark, d)
    return dense.dense_scores(asked, rows, 10)


@query(f"WITH {C.SQL_COSINE}, kept AS (SELECT * FROM cosines WHERE score >= 0.35) {C.sql_top(10, 'kept')}")
def dense_min_score(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = C.vector_rows(spark, d)
    return dense.dense_scores(asked, rows, 10, min_score=0.35)


@query(f"WITH {C.SQL_COSINE}, kept AS (SELECT * FROM cosines WHERE label NOT IN (8, 9) OR label IS NULL) {C.sql_top(10, 'kept')}")
def dense_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Types are excluded before the search; a null type is a plain chunk and stays."""
    rows, asked = C.vector_rows(spark, d)
    return dense.dense_scores(asked, rows.where("label NOT IN (8, 9) OR label IS NULL"), 10)


@query(f"WITH {C.SQL_SPARSE} {C.sql_top(10, 'dots')}")
def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return C.legs(spark, d, 10).where("leg = '2sparse'").drop("leg")


def _sql_rrf(weight: str, k: int) -> str:
    return f"""WITH {C.sql_legs(30)}, fused AS (SELECT query_id, chunk_id, round(sum({weight} / (60 + rank)), 8) AS score, min({{'leg': leg, 'rank': rank}}) AS seen FROM legs GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.leg, seen.rank, chunk_id) AS rank FROM fused) WHERE rank <= {k}"""


@query(_sql_rrf("1.0e0", 10))
def rrf_two_leg(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(C.legs(spark, d, fusion.candidate_cap(10)), k=10)


@query(_sql_rrf("(CASE WHEN leg = '2sparse' THEN 0.4e0 ELSE 1.0e0 END)", 10))
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(C.legs(spark, d, fusion.candidate_cap(10)), {"2sparse": 0.4}, 10)


_NORM = """n AS (SELECT *, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0e0 ELSE max(score) OVER w - min(score) OVER w END) AS norm FROM legs WINDOW w AS (PARTITION BY query_id, leg))"""


@query(f"WITH {C.sql_legs(30)}, {_NORM} SELECT query_id, leg, chunk_id, rank, round(norm, 6) AS norm FROM n")
def leg_min_max(spark: SparkSession, d: str) -> DataFrame:
    return fusion.min_max(C.legs(spark, d, 30)).select("query_id", "leg", "chunk_id", "rank", F.round("norm", 6).alias("norm"))


@query(f"""WITH {C.sql_legs(30)}, {_NORM}, f AS (SELECT query_id, chunk_id, round(0.7e0 * coalesce(max(norm) FILTER (leg = '1dense'), 0.0e0) + (1 - 0.7e0) * coalesce(max(norm) FILTER (leg = '2sparse'), 0.0e0), 6) AS score FROM n GROUP BY 1, 2)
{C.sql_top(10, 'f')}""")
def linear_fusion(spark: SparkSession, d: str) -> DataFrame:
    return lexical.top_k(fusion.linear(C.legs(spark, d, 30), 0.7, "1dense", "2sparse"), 10)


@query(f"""WITH {C.sql_legs(30)}, p AS (SELECT query_id // 200 AS query_id, CAST(query_id AS VARCHAR) || leg AS leg, chunk_id, rank FROM legs),
fused AS (SELECT query_id, chunk_id, round(sum(1.0e0 / (60 + rank)), 8) AS score, min({{'leg': leg, 'rank': rank}}) AS seen FROM p GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.leg, seen.rank, chunk_id) AS rank FROM fused) WHERE rank <= 10""")
def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Variants of one question are further legs of it."""
    legs = C.legs(spark, d, 30)
    variants = legs.withColumn("leg", F.concat(F.col("query_id").cast("string"), "leg")).withColumn("query_id", F.floor(F.col("query_id") / 200).cast("bigint"))
    return fusion.rrf(variants, k=10)


@query(f"""WITH {C.sql_legs(30)} SELECT query_id, chunk_id, arg_min(score, leg) AS score, min(leg) AS leg, count(DISTINCT leg) AS n_legs FROM legs GROUP BY 1, 2""")
def first_view_union(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_view(C.legs(spark, d, 30))


_FEEDBACK = "fb AS (SELECT user_id AS chunk_id, sum(CASE WHEN event_type = 'click' THEN 1.0e0 ELSE -1.0e0 END) AS feedback FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.streaming.limiter import feedback_totals

    return feedback_totals(table(spark, d, "events").where("event_type IN ('click', 'error')").select(F.col("user_id").alias("chunk_id"), (F.col("event_type") == "click").alias("relevant")))


@query(f"WITH {_FEEDBACK} SELECT chunk_id, feedback FROM fb")
def feedback_scores(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d)


@query(f"""WITH {C.SQL_COSINE}, {_FEEDBACK}, hits AS ({C.sql_top(10, 'cosines')}),
b AS (SELECT query_id, h.chunk_id, rank, round(score + 0.05e0 * greatest(coalesce(feedback, 0.0e0), 0.0e0), 6) AS boosted FROM hits h LEFT JOIN fb USING (chunk_id))
SELECT query_id, chunk_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS new_rank FROM b""")
def feedback_boost(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = C.vector_rows(spark, d)
    return fusion.feedback_boost(dense.dense_scores(asked, rows, 10), _votes(spark, d), 0.05)


@query(f"""{HITS}, hits AS ({C.sql_top(10)}) SELECT query_id, chunk_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS new_rank
FROM (SELECT query_id, chunk_id, rank, round(score + CASE WHEN modality = 'table' THEN 0.5e0 ELSE 0.0e0 END, 6) AS boosted FROM hits JOIN ch USING (chunk_id))""")
def modality_boost(spark: SparkSession, d: str) -> DataFrame:
    hits = C.bm25(spark, d, 10).join(C.chunks(spark, d).select("chunk_id", "modality"), "chunk_id")
    boosted = hits.withColumn("boosted", F.round(F.col("score") + F.when(F.col("modality").isin("table", "caption"), 0.5).otherwise(0.0), 6))
    return boosted.select("query_id", "chunk_id", "boosted", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank")).cast("bigint").alias("new_rank"))


@query()
def mmr(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = C.vector_rows(spark, d)
    hits = dense.dense_scores(asked, rows, 50).join(rows.select("chunk_id", "v"), "chunk_id")
    return context.mmr(hits, 0.6, 10)


# --- context


def _hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return C.bm25(spark, d, k).join(C.chunks(spark, d), "chunk_id")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    """Hits with parents, digests in place of all texts that are not blank."""
    chunks = C.brief(spark, d, text=F.when(F.trim("text") == "", "").otherwise(F.md5("text")))
    return context.with_parents(C.bm25(spark, d, 10).join(chunks, "chunk_id"), chunks.select("chunk_id", "text"))


_WITH_HITS = f"{HITS}, hits AS (SELECT h.*, document_id, chunk_index, text, chunk_type, parent_id, page_no FROM ({C.sql_top(10)}) h JOIN ch USING (chunk_id))"
_ENRICHED = """e AS (SELECT h.*, coalesce(trim(p.text) <> '', false) AS enriched, CASE WHEN trim(p.text) <> '' THEN p.text ELSE h.text END AS context FROM hits h LEFT JOIN ch p ON p.chunk_id = h.parent_id)"""


@query(f"{_WITH_HITS}, {_ENRICHED} SELECT query_id, chunk_id, rank, enriched, md5(context) AS context FROM e")
def parent_context(spark: SparkSession, d: str) -> DataFrame:
    return context.with_parents(_hits(spark, d), C.chunks(spark, d).select("chunk_id", "text")).select("query_id", "chunk_id", "rank", F.coalesce("enriched", F.lit(False)).alias("enriched"), F.md5("context").alias("context"))


@query(f"{_WITH_HITS}, {_ENRICHED} SELECT query_id, chunk_id, rank FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.enriched AND b.query_id = a.query_id AND b.parent_id = a.chunk_id)")
def redundant_parent_drop(spark: SparkSession, d: str) -> DataFrame:
    return context.without_redundant_parents(_parents(spark, d)).select("query_id", "chunk_id", "rank")


@query(f"""{_WITH_HITS}, m AS (SELECT *, CASE WHEN chunk_index = lag(chunk_index) OVER w + 1 THEN 0 ELSE 1 END AS new FROM hits WHERE chunk_index IS NOT NULL AND chunk_type IS DISTINCT FROM 'proposition' WINDOW w AS (PARTITION BY query_id, document_id, parent_id ORDER BY chunk_index, rank)),
r AS (SELECT *, sum(new) OVER (PARTITION BY query_id, document_id, parent_id ORDER BY chunk_index, rank ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT query_id, document_id, parent_id, CAST(min(chunk_index) AS BIGINT) AS first_index, CAST(max(chunk_index) AS BIGINT) AS last_index, count(*) AS n_chunks, min(rank) AS rank FROM r GROUP BY query_id, document_id, parent_id, run""")
def rse_islands(spark: SparkSession, d: str) -> DataFrame:
    return context.islands(_hits(spark, d))


@query(f"""{_WITH_HITS}, {_ENRICHED}, k AS (SELECT query_id, CASE WHEN enriched THEN parent_id ELSE chunk_id END AS passage, rank, chunk_id FROM e)
SELECT query_id, passage, min(rank) AS first_rank, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM k GROUP BY 1, 2""")
def passage_groups(spark: SparkSession, d: str) -> DataFrame:
    hits = _parents(spark, d)
    key = context.passage_key(F.col("parent_id"), F.col("enriched"), F.array().cast("array<string>"), F.col("chunk_id"))
    return context.passages(hits.withColumn("key", key), "key")


@query()
def rse_segments(spark: SparkSession, d: str) -> DataFrame:
    return context.merge_segments(_hits(spark, d), 1000)


@query()
def compression_budget(spark: SparkSession, d: str) -> DataFrame:
    passage = F.when(F.col("enriched"), F.col("parent_id")).otherwise(F.col("chunk_id"))
    hits = _parents(spark, d).select("query_id", "chunk_id", passage.alias("passage"), F.col("context").alias("digest"), "rank")
    # texts move once, and of a long one only what the budget can take
    texts = table(spark, d, "chunks").where("text IS NOT NULL").groupBy(F.col("id").alias("passage"), F.md5("text").alias("digest")).agg(F.first(context.within("text", 400)).alias("text"))
    return context.compress(hits.join(texts, ["passage", "digest"]), 400)


@query(f"""{_WITH_HITS}, u AS (SELECT query_id, chunk_id, rank, CAST(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM hits) SELECT * FROM u WHERE used <= 600""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    hits = C.bm25(spark, d, 10).join(C.brief(spark, d, tokens=token_estimate(F.col("text"))), "chunk_id")
    return context.fits_whole(hits, 600, F.col("tokens")).select("query_id", "chunk_id", "rank", "used")


@query(f"""WITH {C.SQL_CHUNKS}, doc AS (SELECT DISTINCT id AS document_id, source FROM documents)
SELECT chunk_id, '[Document: ' || coalesce(nullif(regexp_replace(source, '^{C.SQL_SPACE}+|{C.SQL_SPACE}+$', '', 'g'), ''), '—') || ' | Section: ' || coalesce(chunk_type, '—') || ' | Page: ' || coalesce(CAST(page_no AS VARCHAR), '—') || ']' AS header
FROM ch LEFT JOIN doc USING (document_id)""")
def context_headers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("id").alias("document_id"), "source").distinct()
    return C.chunks(spark, d).join(docs, "document_id", "left").select("chunk_id", context_header(F.col("source"), F.col("chunk_type"), F.col("page_no")).alias("header"))


# --- enrichment


@query(f"""WITH {C.SQL_CHUNKS}, {C.SQL_QUESTIONS}, {C.sql_index()}, {C.sql_bm25()}, top AS ({C.sql_top(10)}), hits AS (SELECT t.*, parent_id, chunk_type FROM top t JOIN ch USING (chunk_id)),
r AS (SELECT query_id, CASE WHEN chunk_type = 'child' THEN parent_id ELSE chunk_id END AS target, score, rank FROM hits),
g AS (SELECT query_id, target AS chunk_id, max(score) AS score, min(rank) AS best FROM r WHERE target IS NOT NULL GROUP BY 1, 2)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY best, chunk_id) AS rank FROM g""")
def question_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Hits on child chunks stand for their source; several of one source count once."""
    links = C.chunks(spark, d).where("chunk_type = 'child'").select("chunk_id", F.col("parent_id").alias("source_id"))
    return enrich.resolve_questions(C.bm25(spark, d, 10), links)


@query(f"""{_WITH_HITS}, s AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits WHERE chunk_type = 'parent'),
scope AS (SELECT DISTINCT query_id, document_id FROM s WHERE r <= 3)
SELECT query_id, chunk_id, rank FROM hits h WHERE chunk_type IS DISTINCT FROM 'parent' AND EXISTS (SELECT 1 FROM scope s WHERE s.query_id = h.query_id AND s.document_id = h.document_id)""")
def hierarchical(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    tops = hits.where("chunk_type = 'parent'").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return enrich.scoped(tops, hits.where("chunk_type IS DISTINCT FROM 'parent'")).select("query_id", "chunk_id", "rank")


def _sql_entities(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[,;.!?\\s]+'), lambda w: length(w) > 1 AND regexp_matches(w, '^\\p{{Lu}}'))"


@query(f"""WITH {C.SQL_CHUNKS}, {C.SQL_QUESTIONS}, asked AS (SELECT DISTINCT query_id, unnest({_sql_entities('query')}) AS entity FROM qs),
edges AS (SELECT DISTINCT chunk_id, unnest({_sql_entities('text')}) AS entity FROM ch WHERE text IS NOT NULL), n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY 1),
f AS (SELECT query_id, chunk_id, round(count(DISTINCT entity) / any_value(n), 6) AS score FROM asked JOIN edges USING (entity) JOIN n USING (query_id) GROUP BY 1, 2)
{C.sql_top(10, 'f')}""")
def graph_hits(spark: SparkSession, d: str) -> DataFrame:
    return enrich.entity_hits(C.questions(spark, d), enrich.mentions(C.chunks(spark, d)), 10)


@query("""SELECT doc_id, list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(text, '[,;.!?\\s]+'), lambda w: length(w) > 1 AND regexp_matches(w, '^\\p{Lu}')))), 'string_agg', '|') AS names
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) WHERE len(list_filter(string_split_regex(text, '[,;.!?\\s]+'), lambda w: length(w) > 1 AND regexp_matches(w, '^\\p{Lu}'))) > 0""")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL").distinct()
    return docs.select("doc_id", F.array_join(entity_names(F.col("text")), "|").alias("names")).where("names != ''")


@query(f"""WITH {C.SQL_CHUNKS} SELECT CASE WHEN chunk_type IN ('hype_question', 'summary') THEN 'vector' ELSE 'both' END AS route,
CASE WHEN modality IS NOT NULL AND modality <> 'text' THEN modality WHEN chunk_type IN ('table', 'figure', 'caption', 'page') THEN chunk_type ELSE 'text' END AS modality, count(*) AS n_chunks FROM ch GROUP BY 1, 2""")
def index_routing(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.chunks(spark, d)
    routed = chunks.select(enrich.routes(F.coalesce("chunk_type", F.lit(""))).alias("route"), enrich.modality(F.col("modality"), F.coalesce("chunk_type", F.lit(""))).alias("modality"))
    return routed.groupBy("route", "modality").agg(F.count("*").alias("n_chunks"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, substring(sha256(regexp_replace(text, '^{C.SQL_SPACE}+|{C.SQL_SPACE}+$', '', 'g') || '|' || source), 1, 16) AS digest FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT digest, count(*) AS n_docs, min(doc_id) AS first_doc FROM s GROUP BY 1""")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", content_hash(F.col("text"), F.col("source")).alias("digest")).distinct()
    return docs.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
