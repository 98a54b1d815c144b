"""Queries of ingestion, the catalogue, text functions, chunkers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions import text as T
from rivulet.operators import chunking, ingest
from rivulet.plans import common as C
from rivulet.sources.tables import table
from rivulet.streaming import limiter

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_DOCS = "docs AS (SELECT DISTINCT doc_id, id, batch_no, lower(source_path) AS source_path, sha256(text) AS digest FROM documents WHERE source_path IS NOT NULL)"
_CATALOGUE = "cat AS (SELECT source_path, arg_max(digest, doc_id) AS digest FROM docs WHERE batch_no = 0 GROUP BY 1)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source_path IS NOT NULL").select("doc_id", "id", "batch_no", F.lower("source_path").alias("source_path"), F.sha2("text", 256).alias("digest")).distinct()


@query(f"""WITH {_DOCS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY doc_id DESC) AS rn FROM docs WHERE batch_no = 0) WHERE rn = 1)
SELECT a.doc_id, a.batch_no, CASE WHEN l.source_path IS NULL THEN 'new' WHEN a.digest = l.digest THEN 'unchanged' ELSE 'changed' END AS status FROM docs a LEFT JOIN l ON a.source_path = l.source_path WHERE a.batch_no >= 1""")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    catalogue = ingest.latest(docs.where("batch_no = 0"), ["source_path"], [F.desc("doc_id")])
    return ingest.ingest_status(docs.where("batch_no >= 1"), catalogue).select("doc_id", "batch_no", "status")


@query("""WITH l AS (SELECT DISTINCT document_id, lower(trim(chunk_id)) AS chunk_id, linked_at FROM document_chunks WHERE chunk_id IS NOT NULL),
o AS (SELECT DISTINCT document_id, chunk_id FROM l WHERE linked_at < TIMESTAMP '2025-06-01 00:00:00'), n AS (SELECT DISTINCT document_id, chunk_id FROM l WHERE linked_at >= TIMESTAMP '2025-06-01 00:00:00')
SELECT o.* FROM o WHERE document_id IN (SELECT document_id FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE n.document_id = o.document_id AND n.chunk_id = o.chunk_id)""")
def superseded_purge(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "document_chunks").where("chunk_id IS NOT NULL").select("document_id", F.lower(F.trim("chunk_id")).alias("chunk_id"), "linked_at")
    part = lambda cond: links.where(cond).select("document_id", "chunk_id").distinct()
    return ingest.superseded(part("linked_at < TIMESTAMP '2025-06-01 00:00:00'"), part("linked_at >= TIMESTAMP '2025-06-01 00:00:00'"))


@query("""WITH c AS (SELECT DISTINCT id, document_id, modality, text FROM chunks WHERE modality = 'table'), ok AS (SELECT document_id FROM c GROUP BY 1 HAVING bool_and(length(text) > 0))
SELECT document_id, id AS chunk_id FROM c WHERE document_id IN (SELECT document_id FROM ok) AND id NOT IN (SELECT id FROM c WHERE length(text) > 300)""")
def stale_structured(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "chunks").where("modality = 'table'").select("document_id", F.col("id").alias("chunk_id"), "text").distinct()
    complete = known.select("document_id", F.when(F.length("text") > 300, F.col("chunk_id")).alias("chunk_id"), (F.length("text") > 0).alias("ok"))
    return ingest.stale_structured(known.select("document_id", "chunk_id"), complete)


@query("""WITH r AS (SELECT DISTINCT * FROM ingestion_runs), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM r) WHERE rn = 1)
SELECT document_id, status, chunks_added, coalesce(nullif(error, ''), '-') AS error FROM l""")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "ingestion_runs").distinct()
    last = ingest.latest(runs, ["document_id"], [F.desc("created_at"), F.desc("id")])
    return last.select("document_id", "status", "chunks_added", F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit("-")).alias("error"))


@query("""SELECT id, position FROM (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS position FROM (SELECT DISTINCT id, updated_at FROM documents)) WHERE position <= 50""")
def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most recently updated documents; the limit is the report."""
    docs = table(spark, d, "documents").select("id", "updated_at").distinct().orderBy(F.desc("updated_at"), "id").limit(50)
    return docs.withColumn("position", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("bigint")).select("id", "position")


@query(f"""WITH {C.SQL_CHUNKS}, o AS (SELECT chunk_id, document_id, md5(text) AS digest, 1 AS revision FROM ch WHERE created_at < TIMESTAMP '2025-07-01 00:00:00'), n AS (SELECT chunk_id, document_id, md5(text || '!') AS digest, 2 AS revision FROM ch WHERE created_at >= TIMESTAMP '2025-05-01 00:00:00')
SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.digest, o.digest) AS digest, coalesce(o.revision, n.revision) AS revision FROM o FULL JOIN n ON o.chunk_id = n.chunk_id""")
def upsert_keeps_feedback(spark: SparkSession, d: str) -> DataFrame:
    """New rows replace old ones, but a column the old row owns survives."""
    chunks = C.chunks(spark, d)
    old = chunks.where("created_at < TIMESTAMP '2025-07-01 00:00:00'").select("chunk_id", "document_id", F.md5("text").alias("digest"), F.lit(1).alias("revision"))
    new = chunks.where("created_at >= TIMESTAMP '2025-05-01 00:00:00'").select("chunk_id", "document_id", F.md5(F.concat("text", F.lit("!"))).alias("digest"), F.lit(2).alias("revision"))
    return ingest.upsert(old, new, "chunk_id", ["revision"])


@query(f"""WITH {C.SQL_CHUNKS}, b AS (SELECT chunk_id, CASE WHEN page_no % 2 = 0 THEN text || ' (revised)' ELSE text END AS text FROM ch)
SELECT b.chunk_id FROM b LEFT JOIN ch USING (chunk_id) WHERE ch.chunk_id IS NULL OR b.text IS DISTINCT FROM ch.text""")
def needs_upsert(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.chunks(spark, d)
    built = chunks.select("chunk_id", F.when(F.col("page_no") % 2 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")).alias("text"))
    return ingest.needs_upsert(built, chunks.select("chunk_id", "text"), "chunk_id", "text").select("chunk_id")


@query("""WITH t AS (SELECT DISTINCT doc_id, batch_no, sha256(text || '|model') AS key FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT key FROM t WHERE batch_no = 0)
SELECT batch_no, count(*) FILTER (key IN (SELECT key FROM c)) AS hits, count(*) FILTER (key NOT IN (SELECT key FROM c)) AS misses FROM t WHERE batch_no >= 1 GROUP BY 1""")
def cache_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "batch_no", F.sha2(F.concat("text", F.lit("|model")), 256).alias("key")).distinct()
    split = ingest.cache_split(rows.where("batch_no >= 1"), rows.where("batch_no = 0"))
    return split.groupBy("batch_no").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


# --- text functions over whole tables


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH h AS (SELECT doc_id, text, substring(text, 1, 200) AS head FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT *, length(head) - instr(reverse(head), '.') AS last FROM h)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(CASE WHEN contains(head, '.') AND last > 0 THEN left(head, last + 1) ELSE head END, '^{C.SQL_SPACE}+|{C.SQL_SPACE}+$', '', 'g') END AS head FROM l""")
def sentence_truncation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", T.truncate_sentence(F.col("text"), 50).alias("head"))


@query(r"""SELECT doc_id, pos, regexp_replace(line, '^\d+[.)]\s*|^[-•*]\s*', '') AS item FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
WHERE regexp_matches(line, '^(\d+[.)]|[-•*])\s')""")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"^(\d+[.)]|[-•*])\s")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.strip_list_prefix(F.col("line")).alias("item"))


@query(r"""SELECT doc_id, regexp_replace(p, '^.*/', '') AS base, regexp_replace(regexp_replace(p, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem, regexp_replace(regexp_replace(p, '^.*/', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS safe
FROM (SELECT DISTINCT doc_id, replace(source_path, '\', '/') AS p FROM documents WHERE source_path IS NOT NULL)""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("source_path")
    return table(spark, d, "documents").where("source_path IS NOT NULL").select("doc_id", T.basename(p).alias("base"), T.stem(p).alias("stem"), T.safe_segment(T.basename(p)).alias("safe")).distinct()


# a table is a row of cells, a row of dashes with optional colons, and further rows, each between pipes and on a line of its own
_ROW, _RULE = r"\|.+\|", r"\|(?: *:?-+:? *\|)+"
_TABLE = rf"(?m)(^{_ROW}\n{_RULE}(?:\n{_ROW})+)"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{_TABLE}')) AS n_tables, md5(regexp_extract(text, '{_TABLE}')) AS first_table FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(text, '{_TABLE}')""")
def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").rlike(_TABLE)).select("doc_id", "text").distinct()
    return rows.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_TABLE), F.lit(1))).cast("bigint").alias("n_tables"), F.md5(F.regexp_extract("text", _TABLE, 1)).alias("first_table"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT DISTINCT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, count(*) FILTER (regexp_matches(line, '^ {0,3}```')) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM l)
SELECT doc_id, pos, regexp_extract(line, '^#{1,6}\s+(.+)$', 1) AS title FROM f WHERE fences % 2 = 0 AND regexp_extract(line, '^#{1,6}\s+(.+)$', 1) <> ''""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of documents, those within fenced code left out; a fence that is never closed runs to the end."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct().select("doc_id", F.posexplode(T.heading_lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1).alias("title")).where("title != ''")


@query(r"""SELECT document_id, count(*) AS n_pages, bool_and(length(regexp_replace(text, '\s', '', 'g')) < 200) AS needs_ocr FROM (SELECT DISTINCT document_id, id, text FROM chunks WHERE page_no IS NOT NULL AND text IS NOT NULL) GROUP BY 1""")
def ocr_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents all of whose pages hold next to no text."""
    pages = table(spark, d, "chunks").where("page_no IS NOT NULL AND text IS NOT NULL").select("document_id", "id", "text").distinct()
    return pages.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.bool_and(F.length(F.regexp_replace("text", r"\s", "")) < 200).alias("needs_ocr"))


@query("""WITH c AS (SELECT DISTINCT id, document_id, chunk_index, text FROM chunks WHERE chunk_index IS NOT NULL AND text IS NOT NULL),
n AS (SELECT id, text, lead(text) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS following FROM c)
SELECT id AS chunk_id, coalesce(list_max(list_filter(generate_series(1, least(length(text), length(following), 512)), lambda k: right(text, CAST(k AS INTEGER)) = left(following, CAST(k AS INTEGER)))), 0) AS overlap FROM n WHERE following IS NOT NULL""")
def chunk_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("chunk_index IS NOT NULL AND text IS NOT NULL").select("id", "document_id", "chunk_index", "text").distinct()
    following = F.lead("text").over(Window.partitionBy("document_id").orderBy("chunk_index", "id"))
    pairs = rows.withColumn("following", following).where("following IS NOT NULL")
    return pairs.select(F.col("id").alias("chunk_id"), T.overlap_length(F.col("text"), F.col("following")).alias("overlap"))


@query(f"""WITH {C.SQL_CHUNKS}, s AS (SELECT DISTINCT id AS document_id, lang FROM documents WHERE lang IN ('de', 'fr')) SELECT lang, count(*) AS n_chunks FROM ch JOIN s USING (document_id) WHERE modality = 'text' AND deleted_at IS NULL GROUP BY 1""")
def scoped_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks within an explicit document scope and a metadata filter."""
    scope = table(spark, d, "documents").where("lang IN ('de', 'fr')").select(F.col("id").alias("document_id"), "lang").distinct()
    return C.chunks(spark, d).where("modality = 'text' AND deleted_at IS NULL").join(scope, "document_id").groupBy("lang").agg(F.count("*").alias("n_chunks"))


# --- chunkers


def _chunked(spark: SparkSession, d: str, **how) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text").distinct()
    return chunking.chunk_documents(docs, **how)


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d)


@query()
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, strategy="section")


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, strategy="semantic", threshold=0.9)


@query()
def parent_child_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, strategy="parent_child", size=400, overlap=40, parent_size=1500)


@query()
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d, strategy="page")


# --- streams


@query()
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Three requests a day a client over the events, by the sliding-window rule."""
    requests = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), "ts")
    return limiter.rate_limit(requests, 3, 86_400.0)


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    counts = limiter.tumbling_counts(table(spark, d, "events"), "1 day")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, count(DISTINCT session) AS n_sessions, count(*) AS n_events FROM s GROUP BY 1""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    windows = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return windows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))
