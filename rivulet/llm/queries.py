"""The pN_ queries of the operators in this subpackage, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm import history, mixing, neardup, packing, pairs, scans, splitting, tokens, truncation, vectors
from rivulet.operators.dense import dense_scores
from rivulet.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: size_limits 'split_item'
CAPACITY, OVERLAP = 2000, 200


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = splitting.oversized_items(table(spark, sf_dir, "documents"), "document", "doc_id", "text", CAPACITY)
    return documents.unionByName(splitting.oversized_items(table(spark, sf_dir, "chunks"), "chunk", "id", "text", CAPACITY))


@query
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and chunk, by its length and digest."""
    out = None
    for item, name, key in (("document", "documents", "doc_id"), ("chunk", "chunks", "id")):
        df = table(spark, sf_dir, name).select(F.lit(item).alias("item"), F.col(key).cast("string").alias("item_id"), "text").distinct()
        part = splitting.split_oversized(df, "text", CAPACITY, OVERLAP, ["item", "item_id"]).select(
            "item", "item_id", "boundary", "piece_no", F.length("piece").alias("n_chars"), F.md5("piece").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


ORACLE["p2_found"] = r"""
WITH t AS (SELECT DISTINCT 'document' AS item, CAST(doc_id AS VARCHAR) AS item_id, text FROM documents WHERE length(text) > 2000
           UNION SELECT DISTINCT 'chunk', id, text FROM chunks WHERE length(text) > 2000)
SELECT item, item_id, CASE
  WHEN list_max(list_transform(string_split_regex(text, '\n{2,}'), lambda x: length(x))) <= 2000 THEN 'paragraph'
  WHEN list_max(list_transform(string_split_regex(text, '\n+'), lambda x: length(x))) <= 2000 THEN 'line'
  WHEN list_max(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: length(x))) <= 2000 THEN 'sentence'
  WHEN list_max(list_transform(string_split_regex(text, '\s+'), lambda x: length(x))) <= 2000 THEN 'word'
  ELSE 'none' END AS boundary FROM t"""


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select(F.col("key").alias("doc_id"))


@query
def p10_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "qa_pairs")).select(F.col("key").alias("qa_id"), "defect")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = neardup.texts(table(spark, sf_dir, "documents"), "document", "doc_id", "text")
    return documents.unionByName(neardup.texts(table(spark, sf_dir, "chunks"), "chunk", "id", "text"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_texts(spark, sf_dir), shingle=3, similarity=0.7).pairs()


_RUNS = r"""w AS (SELECT item, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM t WHERE text IS NOT NULL), s AS (SELECT item, id, list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE len(ws) >= 3),
e AS (SELECT item, id, len(s) AS n, unnest(s) AS g FROM s)"""

ORACLE["p3_found"] = f"""WITH t AS (SELECT DISTINCT 'document' AS item, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION SELECT DISTINCT 'chunk', id, text FROM chunks), {_RUNS}
SELECT a.item, a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.item = b.item AND a.g = b.g AND a.id < b.id AND least(a.n, b.n) >= 0.7e0 * greatest(a.n, b.n) GROUP BY 1, 2, 3, a.n, b.n HAVING count(*) >= 0.7e0 * (a.n + b.n - count(*))"""


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the usual setting: runs of five words, similarity 0.8."""
    return neardup.NearDuplicates(_texts(spark, sf_dir)).groups()


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicates(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "dup_kind")


_UP = r"[^/]+/\.\.(/|$)"
#: As SQL has no fold over a path's parts, '..' is taken out step by step, four deep.
ORACLE["p6_found"] = rf"""WITH d AS (SELECT DISTINCT doc_id, coalesce(batch_no, 0) AS batch, text, content_hash, source_path FROM documents),
h AS (SELECT doc_id, batch, text, CASE WHEN regexp_matches(text, '\S') THEN md5(text) END AS tk, coalesce(md5(text), 'null ' || doc_id) AS version,
  nullif(regexp_replace(regexp_replace(lower(content_hash), '^\s*(sha-?\d+|md5|0x)\s*[:=]?\s*', ''), '[^0-9a-f]', '', 'g'), '') AS hk,
  '/' || array_to_string(list_filter(string_split(regexp_replace(lower(replace(trim(url_decode(replace(source_path, '+', '%2B'))), '\', '/')), '^[a-z][a-z0-9+.\-]*:/+', ''), '/'), lambda p: p NOT IN ('', '.')), '/') AS p0 FROM d),
k AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p0, '{_UP}', ''), '{_UP}', ''), '{_UP}', ''), '{_UP}', ''), '/'), '') AS pk FROM h),
t AS (SELECT 'document' AS item, doc_id AS id, text FROM k), {_RUNS}, near AS (SELECT DISTINCT b.id FROM e a JOIN e b ON a.g = b.g JOIN k x ON x.doc_id = a.id JOIN k y ON y.doc_id = b.id
  WHERE (x.batch < y.batch OR x.batch = y.batch AND a.id < b.id) AND y.batch >= 1 AND least(a.n, b.n) >= 0.7e0 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7e0 * (a.n + b.n - count(*)))
SELECT doc_id, dup_kind FROM (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM k x WHERE (x.tk = y.tk OR x.hk = y.hk) AND (x.batch < y.batch OR x.batch = y.batch AND x.doc_id < y.doc_id)) THEN 'exact' WHEN doc_id IN (SELECT id FROM near) THEN 'near'
  WHEN EXISTS (SELECT 1 FROM k x WHERE x.pk = y.pk AND x.version <> y.version AND (x.batch < y.batch OR x.batch = y.batch AND x.doc_id < y.doc_id)) THEN 'path' END AS dup_kind FROM k y WHERE batch >= 1) WHERE dup_kind IS NOT NULL"""


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vectors.VectorIndex(vectors.usable(table(spark, sf_dir, "chunks").select("id", "embedding"), "id", "embedding", 64), 64)
    return vectors.mutual(index.search(probes=3, at_least=0.9), 0.9)


@query
def p5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of every usable chunk vector."""
    index = vectors.VectorIndex(vectors.usable(table(spark, sf_dir, "chunks").select("id", "embedding"), "id", "embedding", 64), 64)
    return index.search(probes=max(12, index.n_lists // 32)).select("id_a", "id_b", F.round("similarity", 5).alias("similarity"), "rank")


@query
def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector of ``embeddings`` whose id is divisible by 50, against all of them."""
    rows = table(spark, sf_dir, "embeddings")
    index = vectors.VectorIndex(vectors.usable(rows.select("vec_id", "embedding"), "vec_id", "embedding", 64), 64)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("id"))
    return index.search(asked, probes=max(8, index.n_lists // 2)).select("id_a", "id_b", F.round("similarity", 5).alias("similarity"), "rank")


@query
def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of ``p5_topk`` at its setting, for the chunks whose id's hash is divisible by 50, against all of them by brute force."""
    rows = vectors.usable(table(spark, sf_dir, "chunks").select("id", "embedding"), "id", "embedding", 64)
    index = vectors.VectorIndex(rows, 64)
    asked = index.vectors.where(F.pmod(F.hash("id"), F.lit(50)) == 0).select("id")
    found = index.search(asked, probes=max(12, index.n_lists // 32))
    queries = index.vectors.join(asked, "id").select(F.col("id").alias("query_id"), "v")
    exact = dense_scores(queries, index.vectors.select(F.col("id").alias("chunk_id"), "v"), 11).where("query_id != chunk_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    best = exact.withColumn("place", F.row_number().over(order)).where("place <= 10").select(F.col("query_id").alias("id_a"), F.col("chunk_id").alias("id_b"))
    return vectors.recall(found, best)


#: size_limits 'container' and 'small_container'
CONTAINER, SMALL_CONTAINER = 2048, 512


def _packed(spark: SparkSession, sf_dir: str, capacity: int) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    return packing.pack(packing.items_of(tokens.sized(documents, ["doc_id"], "text"), "doc_id", capacity), capacity)


@query
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of every container of 2,048 tokens, with its unused space."""
    return _packed(spark, sf_dir, CONTAINER).select("container", "doc", "piece", "size", (F.lit(CONTAINER) - F.col("used")).alias("unused"))


@query
def p8_small_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_packed(spark, sf_dir, SMALL_CONTAINER), SMALL_CONTAINER)


@query
def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, partitions certified by their lower bound, and the gap to the bound of the total size."""
    return packing.certificate(_packed(spark, sf_dir, CONTAINER), CONTAINER)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tokens.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id", "source"], "text"), table(spark, sf_dir, "mix_targets"))


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _scans(spark: SparkSession, sf_dir: str) -> scans.ScanRepair:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("id").alias("doc"), "text")
    return scans.ScanRepair(documents, table(spark, sf_dir, "chunks").select(F.col("id").alias("key"), F.col("document_id").alias("doc"), "text"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).noise()


@query
def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).repaired()
