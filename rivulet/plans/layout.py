"""Queries of layout chunks and catalogue projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import answers as A
from rivulet.operators import layout, maintenance
from rivulet.plans import common as C
from rivulet.plans.stages import _h, _sql_h
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


def _sql_uuid5(space: str, name: str) -> str:
    h = f"sha1(unhex('{space}') || encode({name}))"
    return f"substring({h}, 1, 8) || '-' || substring({h}, 9, 4) || '-5' || substring({h}, 14, 3) || '-' || translate(substring({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring({h}, 18, 3) || '-' || substring({h}, 21, 12)"


#: The driver's documents with a layout made up from their digests.
_LAYOUT = f"""d AS (SELECT doc_id AS document_id, source_path AS source, text AS content, {_sql_h('doc_id')} AS h FROM (SELECT DISTINCT doc_id, source_path, text FROM documents WHERE source_path IS NOT NULL)),
t AS (SELECT document_id, source, content, unnest([{{'table_id': 'table-1', 'text': ' '}}, {{'table_id': 'table-' || (h % 3), 'text': NULL}}, {{'table_id': 'extra', 'text': CASE WHEN h % 2 = 0 THEN ' own text ' END}}, {{'table_id': '', 'text': 'lost'}}]) AS t FROM d),
f AS (SELECT document_id, source, unnest([{{'figure_id': 'figure-1', 'caption': CASE WHEN h % 2 = 0 THEN ' A pump ' END, 'asset_path': '/a/1.png'}}, {{'figure_id': 'figure-2', 'caption': 'Caption ' || h, 'asset_path': CASE WHEN h % 3 = 0 THEN '/a/2.png' END}}, {{'figure_id': NULL, 'caption': 'x', 'asset_path': 'y'}}]) AS f FROM d)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source_path IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.col("source_path").alias("source"), F.col("text").alias("content")).distinct().withColumn("h", _h(F.col("document_id")))
    t = lambda i, text: F.struct(i.alias("table_id"), text.cast("string").alias("text"))
    f = lambda i, caption, path: F.struct(F.lit(i).cast("string").alias("figure_id"), caption.cast("string").alias("caption"), path.cast("string").alias("asset_path"))
    tables = F.array(t(F.lit("table-1"), F.lit(" ")), t(F.concat(F.lit("table-"), (F.col("h") % 3).cast("string")), F.lit(None)), t(F.lit("extra"), F.when(F.col("h") % 2 == 0, " own text ")), t(F.lit(""), F.lit("lost")))
    figures = F.array(f("figure-1", F.when(F.col("h") % 2 == 0, " A pump "), F.lit("/a/1.png")), f("figure-2", F.concat(F.lit("Caption "), F.col("h").cast("string")), F.when(F.col("h") % 3 == 0, "/a/2.png")), f(None, F.lit("x"), F.lit("y")))
    return docs.select("document_id", "source", "content", "h", tables.alias("tables"), figures.alias("figures"))


@query(f"""WITH {_LAYOUT}, x AS (SELECT document_id, source, t.table_id, CASE WHEN trim(t.text) <> '' THEN trim(t.text) WHEN regexp_full_match(t.table_id, 'table-[1-9]') THEN trim(regexp_extract_all(content, '{layout.TABLE}')[CAST(substring(t.table_id, 7) AS INTEGER)]) END AS text FROM t WHERE t.table_id <> '')
SELECT {_sql_uuid5(layout.TABLE_SPACE, "source || ':' || table_id")} AS chunk_id, document_id, table_id, md5(text) AS text FROM x WHERE text <> ''""")
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return layout.table_chunks(_documents(spark, d)).withColumn("text", F.md5("text"))


@query(f"""WITH {_LAYOUT} SELECT {_sql_uuid5(layout.CAPTION_SPACE, "source || ':' || f.figure_id")} AS chunk_id, document_id, f.figure_id, f.asset_path, trim(f.caption) AS text FROM f WHERE f.figure_id <> '' AND trim(f.caption) <> ''""")
def caption_chunks(spark: SparkSession, d: str) -> DataFrame:
    return layout.caption_chunks(_documents(spark, d))


@query(f"""WITH {_LAYOUT} SELECT {_sql_uuid5(layout.FIGURE_SPACE, "source || ':' || f.figure_id")} AS chunk_id, document_id, f.figure_id, f.asset_path, CASE WHEN trim(f.caption) <> '' THEN trim(f.caption) ELSE '[figure]' END AS text FROM f WHERE f.figure_id <> '' AND f.asset_path <> ''""")
def figure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return layout.figure_chunks(_documents(spark, d))


@query(f"""WITH {_LAYOUT} SELECT document_id, '/assets/' || regexp_replace(regexp_replace(replace(source, '\\', '/'), '^.*/', ''), '(.)\\.[^.]*$', '\\1') || '-' || substring(sha256(source), 1, 16) || '/figure-1.png' AS path FROM d""")
def asset_paths(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("document_id", layout.asset_path("/assets", F.col("source"), F.lit("figure-1"), F.lit("png")).alias("path"))


@query(f"""WITH {C.SQL_CHUNKS}, f AS (SELECT chunk_id AS figure_id, {_sql_h('chunk_id')} AS h FROM ch WHERE modality = 'figure' OR chunk_type = 'figure' OR modality = 'table')
SELECT figure_id, CASE WHEN h % 4 <> 0 AND h % 3 = 0 THEN 'cached' WHEN h % 4 <> 0 AND h % 5 <> 0 THEN 'seen' ELSE 'own' END AS caption, CASE WHEN h % 4 <> 0 AND h % 3 = 0 THEN 'cache' WHEN h % 4 <> 0 AND h % 5 <> 0 THEN 'vision' ELSE 'own' END AS origin FROM f""")
def figure_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions from the cache where they were made for the same picture, else from a vision model, else the figure's own."""
    base = C.chunks(spark, d).where("modality = 'figure' OR chunk_type = 'figure' OR modality = 'table'").select(F.col("chunk_id").alias("figure_id"), _h(F.col("chunk_id")).alias("h"))
    figures = base.select("figure_id", F.when(F.col("h") % 4 != 0, F.md5("figure_id")).alias("asset_hash"), F.lit("own").alias("caption"), F.when(F.col("h") % 5 != 0, " seen ").alias("said"))
    cache = base.select("figure_id", F.when(F.col("h") % 3 == 0, F.md5("figure_id")).otherwise("other").alias("asset_hash"), F.lit("cached").alias("cached"))
    return layout.cached_captions(figures, cache, F.col("said"))


@query(f"""WITH {C.SQL_CHUNKS}, c AS (SELECT document_id, chunk_id, {_sql_h('chunk_id')} AS h FROM ch WHERE document_id IS NOT NULL), b AS (SELECT document_id, chunk_id, h % 29 <> 0 AS ok FROM c WHERE h % 3 <> 0), k AS (SELECT document_id, chunk_id FROM c WHERE h % 2 = 0), w AS (SELECT document_id, bool_and(ok) AS well FROM b GROUP BY 1),
j AS (SELECT coalesce(b.document_id, k.document_id) AS document_id, coalesce(b.chunk_id, k.chunk_id) AS chunk_id, ok, k.chunk_id IS NOT NULL AS was FROM b FULL JOIN k ON b.document_id = k.document_id AND b.chunk_id = k.chunk_id)
SELECT document_id, chunk_id, CASE WHEN ok IS NULL THEN CASE WHEN coalesce(well, false) THEN 'stale' ELSE 'retained' END WHEN NOT ok THEN 'failed' WHEN was THEN 'kept' ELSE 'new' END AS fate FROM j LEFT JOIN w USING (document_id)""")
def structured_ids(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunks(spark, d).where("document_id IS NOT NULL").select("document_id", "chunk_id", _h(F.col("chunk_id")).alias("h"))
    return layout.structured_ids(c.where("h % 3 != 0").select("document_id", "chunk_id", (F.col("h") % 29 != 0).alias("ok")), c.where("h % 2 = 0").select("document_id", "chunk_id"))


# --- catalogue and index maintenance


@query(f"""WITH {C.SQL_CHUNKS}, gone AS (SELECT chunk_id FROM ch WHERE deleted_at IS NOT NULL) SELECT document_id, count(*) AS n_left FROM ch WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) GROUP BY 1""")
def remove_by_ids(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.chunks(spark, d)
    return maintenance.remove_ids(chunks, chunks.where("deleted_at IS NOT NULL").select("chunk_id")).groupBy("document_id").agg(F.count("*").alias("n_left"))


@query(f"""WITH {C.SQL_CHUNKS}, t AS (SELECT DISTINCT id AS document_id FROM documents WHERE lang = 'fr') SELECT document_id, chunk_id FROM ch WHERE document_id IN (SELECT document_id FROM t)""")
def remove_by_document(spark: SparkSession, d: str) -> DataFrame:
    """The ids that leave with their documents."""
    removed, _ = maintenance.remove_documents(C.chunks(spark, d), table(spark, d, "documents").where("lang = 'fr'").select(F.col("id").alias("document_id")))
    return removed


@query(f"""WITH {C.SQL_CHUNKS}, u AS (SELECT chunk_id, {_sql_h('chunk_id')} AS h FROM ch) SELECT chunk_id, CASE WHEN h % 3 = 0 THEN 'revised' ELSE modality END AS modality, CASE WHEN h % 3 = 0 AND h % 2 = 0 THEN 99 ELSE page_no END AS page_no FROM ch JOIN u USING (chunk_id)""")
def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Given values overwrite, null ones leave what is there; updates of unknown chunks change nothing."""
    chunks = C.chunks(spark, d)
    h = _h(F.col("chunk_id"))
    updates = chunks.where(h % 3 == 0).select("chunk_id", F.lit("revised").alias("modality"), F.when(h % 2 == 0, 99).alias("page_no"))
    updates = updates.unionByName(spark.createDataFrame([("nowhere", "x", 1)], "chunk_id string, modality string, page_no int"))
    return maintenance.merge_columns(chunks.select("chunk_id", "modality", "page_no"), updates, "chunk_id")


@query(f"""WITH {C.SQL_CHUNKS}, a AS (SELECT DISTINCT lower(trim(chunk_id)) AS chunk_id FROM document_chunks WHERE chunk_id IS NOT NULL), f AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1.0e0 ELSE -1.0e0 END) AS s FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT chunk_id, chunk_id IN (SELECT chunk_id FROM ch) AS present, coalesce((SELECT s FROM f WHERE user_id = {_sql_h('a.chunk_id')} % 400), 0.0e0) AS feedback FROM a""")
def point_reads(spark: SparkSession, d: str) -> DataFrame:
    """Of asked ids: whether the index has them, and their feedback, 0 where there is none."""
    asked = table(spark, d, "document_chunks").where("chunk_id IS NOT NULL").select(F.lower(F.trim("chunk_id")).alias("chunk_id")).distinct()
    from rivulet.streaming.limiter import feedback_totals

    votes = feedback_totals(table(spark, d, "events").where("event_type IN ('click', 'error')").select(F.col("user_id").alias("chunk_id"), (F.col("event_type") == "click").alias("relevant"))).withColumnRenamed("chunk_id", "user_id")
    read = maintenance.present(asked, C.chunks(spark, d).select("chunk_id")).withColumn("user_id", (_h(F.col("chunk_id")) % 400).cast("bigint"))
    return maintenance.with_feedback(read, votes, "user_id").select("chunk_id", "present", "feedback")


@query(f"""WITH {C.SQL_CHUNKS}, v AS (SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'error')), c AS (SELECT {_sql_h('chunk_id')} % 120 AS n, min(chunk_id) AS chunk_id FROM ch GROUP BY 1)
SELECT event_id, coalesce(chunk_id, 'unknown') AS chunk_id, chunk_id IS NULL AS refused FROM v LEFT JOIN c ON n = user_id""")
def feedback_writes(spark: SparkSession, d: str) -> DataFrame:
    """Votes for chunks the index does not have are refused."""
    named = C.chunks(spark, d).groupBy((_h(F.col("chunk_id")) % 120).cast("bigint").alias("n")).agg(F.min("chunk_id").alias("chunk_id"))
    votes = table(spark, d, "events").where("event_type IN ('click', 'error')").select("event_id", F.col("user_id").alias("n"))
    return maintenance.checked_votes(votes, named, "n").select("event_id", F.coalesce("chunk_id", F.lit("unknown")).alias("chunk_id"), "refused")


@query("""SELECT count(DISTINCT len(embedding)) AS n_sizes, count(DISTINCT len(embedding)) > 1 AS mixed FROM chunks WHERE embedding IS NOT NULL""")
def distinct_models(spark: SparkSession, d: str) -> DataFrame:
    """Whether vectors of more than one model are stored; a model shows in the length of its vectors."""
    return maintenance.distinct_models(table(spark, d, "chunks").where("embedding IS NOT NULL").select(F.size("embedding").alias("model")), "model").select(F.col("n_models").alias("n_sizes"), "mixed")


@query(f"""WITH {C.SQL_CHUNKS}, c AS (SELECT DISTINCT id AS chunk_id, created_at FROM chunks), x AS (SELECT chunk_id, {_sql_h('chunk_id')} AS h, created_at FROM c) SELECT chunk_id, h % 3 <> 0 AND created_at >= TIMESTAMP '2025-06-01 00:00:00' AS hit FROM x""")
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose vector the cache holds; entries older than the time to live are as good as absent."""
    rows = table(spark, d, "chunks").select(F.col("id").alias("key"), "created_at").distinct()
    cache = rows.where(_h(F.col("key")) % 3 != 0).select("key", F.col("created_at").alias("stored_at"))
    return maintenance.live_hits(rows.select("key"), cache, F.expr("TIMESTAMP_NTZ '2025-06-08 00:00:00'"), 7).select(F.col("key").alias("chunk_id"), "hit")


@query(f"""WITH {C.SQL_CHUNKS} SELECT document_id, count(DISTINCT modality) > 1 AS mixed, count(*) AS n FROM ch GROUP BY 1""")
def mixed_modality(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(spark, d).groupBy("document_id").agg((F.count_distinct("modality") > 1).alias("mixed"), F.count("*").alias("n"))


@query(f"""WITH {C.SQL_CHUNKS}, m AS (SELECT chunk_id, {_sql_h('chunk_id')} AS h, chunk_type FROM ch) SELECT chunk_id, CASE WHEN h % 3 = 0 THEN 'own' WHEN h % 3 = 1 THEN 'first' WHEN h % 2 = 0 THEN 'head' END AS section FROM m""")
def section_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's section: its own, else the first of the document's sections, else of its headings."""
    h = _h(F.col("chunk_id"))
    rows = C.chunks(spark, d).select("chunk_id", F.when(h % 3 == 0, "own").alias("section"), F.when(h % 3 == 1, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array().cast("array<string>")).alias("sections"), F.when(h % 2 == 0, F.array(F.lit("head"))).alias("headings"))
    return rows.select("chunk_id", maintenance.section(F.col("section"), F.col("sections"), F.col("headings")).alias("section"))


@query(f"""WITH {C.SQL_CHUNKS} SELECT chunk_id, document_id, coalesce(CAST(page_no AS VARCHAR), '') AS page, {_sql_h('chunk_id')} % 4 = 0 AS protected, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM ch WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x20-\\x7e\\n]*')""")
def source_references(spark: SparkSession, d: str) -> DataFrame:
    """What an answer says of its sources, with a guard on the path it is asked for under."""
    h = _h(F.col("chunk_id"))
    path = F.when(h % 4 == 0, F.concat(F.lit("/chat/"), "chunk_id")).when(h % 4 == 1, "/health").when(h % 4 == 2, "/chatter").otherwise("/metrics/x")
    rows = C.chunks(spark, d).where("text IS NOT NULL").where(F.col("text").rlike(r"^[\x20-\x7e\n]*\z"))
    return rows.select("chunk_id", "document_id", F.coalesce(F.col("page_no").cast("string"), F.lit("")).alias("page"), maintenance.protected(path, F.lit("GET"), ["/chat", "/metrics"], ["/metrics/x", "/health"]).alias("protected"), A.word_count(F.col("text")).alias("words"))
