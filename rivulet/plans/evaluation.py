"""Queries of metrics, gates, quality decisions and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.text import json_rescue
from rivulet.functions.vectors import cosine
from rivulet.operators import context, evals, quality, sweep
from rivulet.plans import common as C
from rivulet.plans.retrieval import HITS
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


_METRICS = f"""{HITS}, top AS ({C.sql_top(10)}), {C.SQL_RELEVANT}, size AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
h AS (SELECT query_id, count(DISTINCT chunk_id) AS found, count(*) AS n, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM top JOIN rel USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY 1),
m AS (SELECT query_id, round(coalesce(found / n_rel, 0), 6) AS recall, round(coalesce(n / 5, 0), 6) AS precision,
  round(coalesce(dcg / list_sum(list_transform(generate_series(1, least(n_rel, 5)), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM size LEFT JOIN h USING (query_id))"""


@query(f"{_METRICS} SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evals.retrieval_metrics(C.bm25(spark, d, 10), C.relevant(spark, d), 5)


@query(f"{_METRICS} SELECT count(*) AS n, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr FROM m")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    return evals.means(evals.retrieval_metrics(C.bm25_relevant(spark, d, 5), C.relevant(spark, d), 5), ["recall", "precision", "ndcg", "mrr"])


@query(f"""{_METRICS}, mods AS (SELECT query_id, min(modality) AS modality FROM rel JOIN (SELECT DISTINCT lower(chunk_id) AS chunk_id, modality FROM ch) USING (chunk_id) GROUP BY 1)
SELECT modality, count(*) AS n, round(avg(recall), 5) AS recall FROM m JOIN mods USING (query_id) GROUP BY 1""")
def modality_recall(spark: SparkSession, d: str) -> DataFrame:
    scores = evals.retrieval_metrics(C.bm25(spark, d, 10), C.relevant(spark, d), 5)
    kinds = C.chunks(spark, d).select(F.lower("chunk_id").alias("chunk_id"), "modality").distinct()
    by_query = C.relevant(spark, d).join(kinds, "chunk_id").groupBy("query_id").agg(F.min("modality").alias("modality"))
    return evals.means(scores.join(by_query, "query_id"), ["recall"], ["modality"])


@query("""SELECT DISTINCT id AS query_id, CASE WHEN coalesce(len(list_filter(list_distinct(relevant_chunk_ids), lambda x: x IS NOT NULL)), 0) > 0
THEN round(least(len(list_filter(list_distinct(relevant_chunk_ids), lambda x: x IS NOT NULL)), 5) / len(list_filter(list_distinct(relevant_chunk_ids), lambda x: x IS NOT NULL)), 6) ELSE 0 END AS ceiling FROM retrieval_dataset""")
def oracle_recall(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size(F.filter(F.array_distinct("relevant_chunk_ids"), lambda x: x.isNotNull())), F.lit(0))
    n = F.when(F.col("relevant_chunk_ids").isNull(), 0).otherwise(n)
    return table(spark, d, "retrieval_dataset").select(F.col("id").alias("query_id"), F.round(evals.oracle_recall(n, 5), 6).alias("ceiling")).distinct()


@query("""SELECT qa_id, coalesce(trim(question), '') <> '' AND coalesce(len(list_filter(relevant_chunks, lambda x: x IS NOT NULL)), 0) > 0 AS evaluable,
coalesce(len(relevant_chunks) > 0 AND len(list_filter(relevant_chunks, lambda x: coalesce(starts_with(x, 'chunk_id_'), false))) = len(relevant_chunks), false) AS placeholder
FROM (SELECT DISTINCT qa_id, question, relevant_chunks FROM qa_pairs)""")
def golden_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_pairs").select("qa_id", "question", "relevant_chunks").distinct()
    n = F.size(F.filter("relevant_chunks", lambda x: x.isNotNull()))
    real = F.coalesce(F.when(F.col("relevant_chunks").isNotNull(), n > 0), F.lit(False))
    return rows.select("qa_id", ((F.coalesce(F.trim("question"), F.lit("")) != "") & real).alias("evaluable"), F.coalesce(evals.placeholder(F.col("relevant_chunks")), F.lit(False)).alias("placeholder"))


@query(f"""{_METRICS}, g AS (SELECT count(*) AS n, count(*) FILTER (recall = 0) AS n_zero, round(avg(recall), 5) AS mean_recall FROM m),
e AS (SELECT count(*) AS n_empty FROM (SELECT DISTINCT id, query, relevant_chunk_ids FROM retrieval_dataset) WHERE coalesce(trim(query), '') = '' OR coalesce(len(relevant_chunk_ids), 0) = 0)
SELECT n, n_empty, mean_recall, CASE WHEN n = 0 THEN 'SKIPPED' WHEN n < 20 THEN 'FAILED: samples' WHEN n_empty > 0 THEN 'FAILED: empty rows' WHEN mean_recall < 0.5 THEN 'FAILED: recall' ELSE 'PASSED' END AS status FROM g, e""")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    means = evals.means(evals.retrieval_metrics(C.bm25_relevant(spark, d, 5), C.relevant(spark, d), 5), ["recall"]).withColumnRenamed("recall", "mean_recall")
    rows = table(spark, d, "retrieval_dataset").select("id", "query", "relevant_chunk_ids").distinct()
    blank = (F.coalesce(F.trim("query"), F.lit("")) == "") | F.col("relevant_chunk_ids").isNull() | (F.size("relevant_chunk_ids") == 0)
    empty = rows.where(blank).agg(F.count("*").alias("n_empty"))
    return means.crossJoin(empty).select("n", "n_empty", "mean_recall", evals.gate(F.col("n"), F.col("n_empty"), F.lit(True), F.col("mean_recall"), 20, 0.5).alias("status"))


@query("""WITH a AS (SELECT DISTINCT id, query FROM retrieval_dataset), b AS (SELECT DISTINCT question AS query FROM qa_pairs)
SELECT (SELECT count(*) FROM (SELECT DISTINCT query FROM a WHERE query IS NOT NULL) x WHERE x.query NOT IN (SELECT query FROM b WHERE query IS NOT NULL)) AS only_retrieval,
(SELECT count(*) FROM b WHERE query IS NOT NULL AND query NOT IN (SELECT query FROM a WHERE query IS NOT NULL)) AS only_qa""")
def goldens_in_sync(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "retrieval_dataset").select("query").where("query IS NOT NULL").distinct()
    b = table(spark, d, "qa_pairs").select(F.col("question").alias("query")).where("query IS NOT NULL").distinct()
    return a.subtract(b).agg(F.count("*").alias("only_retrieval")).crossJoin(b.subtract(a).agg(F.count("*").alias("only_qa")))


@query("""SELECT status, count(duration_ms) AS n, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, count(*) FILTER (error <> '') AS failures
FROM (SELECT DISTINCT * FROM ingestion_runs) GROUP BY 1""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "ingestion_runs").distinct()
    times = evals.quantiles(runs, ["status"], "duration_ms", {"p50": 0.5, "p95": 0.95})
    counts = runs.groupBy("status").agg(F.count("duration_ms").alias("n"), F.count_if(F.col("error") != "").alias("failures"))
    return counts.join(times.drop("n"), "status", "left").select("status", "n", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "failures")


_HALVES = """r AS (SELECT DISTINCT * FROM ingestion_runs), half AS (SELECT created_at >= TIMESTAMP '2025-07-01 00:00:00' AS late, status, quantile_cont(duration_ms, 0.95) AS p95, count(*) FILTER (status = 'failed') AS failures FROM r GROUP BY 1, 2)"""


@query(f"""WITH {_HALVES}, n AS (SELECT * FROM half WHERE late), b AS (SELECT * FROM half WHERE NOT late)
SELECT coalesce(n.status, b.status) AS status, round(100 * (n.p95 - b.p95) / b.p95, 4) AS change_pct,
CASE WHEN n.p95 IS NULL OR b.p95 IS NULL THEN 'skipped' WHEN round(100 * (n.p95 - b.p95) / b.p95, 4) > 10 OR n.failures > b.failures THEN 'regressed' ELSE 'ok' END AS verdict FROM n FULL JOIN b ON n.status = b.status""")
def latency_regression(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "ingestion_runs").distinct().withColumn("late", F.expr("created_at >= TIMESTAMP '2025-07-01 00:00:00'"))
    runs = runs.withColumn("kind", F.col("status"))
    times = evals.quantiles(runs, ["late", "kind"], "duration_ms", {"p95": 0.95}).drop("n")
    half = runs.groupBy("late", "kind").agg(F.count_if(F.col("status") == "failed").alias("failures")).join(times, ["late", "kind"], "left")
    out = evals.regression(half.where("late"), half.where("NOT late"), "kind")
    return out.select(F.col("kind").alias("status"), "change_pct", F.col("status").alias("verdict"))


@query("""SELECT status, le, n FROM (SELECT status, count(*) FILTER (duration_ms <= 100) AS b0, count(*) FILTER (duration_ms <= 500) AS b1, count(*) FILTER (duration_ms <= 1000) AS b2, count(*) FILTER (duration_ms <= 5000) AS b3, count(*) AS b4
FROM (SELECT DISTINCT * FROM ingestion_runs) WHERE duration_ms IS NOT NULL GROUP BY 1), LATERAL (VALUES ('100', b0), ('500', b1), ('1000', b2), ('5000', b3), ('+Inf', b4)) t(le, n)""")
def duration_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evals.histogram(table(spark, d, "ingestion_runs").distinct(), "duration_ms", [100, 500, 1000, 5000], ["status"])


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(gap) AS n_gaps, round(quantile_cont(gap, 0.5) / 1000, 1) AS p50_ms, round(quantile_cont(gap, 0.95) / 1000, 1) AS p95_ms FROM g GROUP BY 1""")
def inter_event_latency(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = table(spark, d, "events").select("user_id", gap.alias("gap"))
    times = evals.quantiles(gaps, ["user_id"], "gap", {"p50": 0.5, "p95": 0.95}).drop("n")
    counts = gaps.groupBy("user_id").agg(F.count("gap").alias("n_gaps"))
    return counts.join(times, "user_id", "left").select("user_id", "n_gaps", F.round(F.col("p50") / 1000, 1).alias("p50_ms"), F.round(F.col("p95") / 1000, 1).alias("p95_ms"))


@query("""WITH d AS (SELECT CASE WHEN chunk_index < 3 THEN 200 WHEN chunk_index < 8 THEN 400 ELSE 800 END AS size, length(text) AS n FROM (SELECT DISTINCT id, chunk_index, text FROM chunks WHERE chunk_index IS NOT NULL)),
s AS (SELECT size, avg(n) AS quality, stddev_pop(n) AS latency FROM d GROUP BY 1),
w AS (SELECT size, round(0.6e0 * quality / max(quality) OVER () + 0.4e0 * (1 - (latency - min(latency) OVER ()) / greatest(max(latency) OVER () - min(latency) OVER (), 1e-9)), 6) AS score FROM s)
SELECT size, score, row_number() OVER (ORDER BY score DESC, size) = 1 AS recommended FROM w""")
def size_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score of sizes: quality, and latency turned round; the best is recommended."""
    rows = table(spark, d, "chunks").where("chunk_index IS NOT NULL").select("id", "chunk_index", "text").distinct()
    sizes = rows.select(F.when(F.col("chunk_index") < 3, 200).when(F.col("chunk_index") < 8, 400).otherwise(800).alias("size"), F.length("text").alias("n"))
    stats = sizes.groupBy("size").agg(F.avg("n").alias("quality"), F.stddev_pop("n").alias("latency"))
    # one row a size
    best = stats.crossJoin(stats.agg(F.max("quality").alias("mq"), F.min("latency").alias("lo"), F.max("latency").alias("hi")))
    score = F.round(0.6 * F.col("quality") / F.col("mq") + 0.4 * (1 - (F.col("latency") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))), 6)
    scored = best.select("size", score.alias("score"))
    top = scored.agg(F.max(F.struct(F.col("score"), (-F.col("size")).alias("s"))).alias("t"))
    return scored.crossJoin(top).select("size", "score", ((F.col("score") == F.col("t.score")) & (-F.col("size") == F.col("t.s"))).alias("recommended"))


# --- quality

_GRADES = "g AS (SELECT query_id, chunk_id, (hash_part % 11) / 10 AS grade FROM (SELECT query_id, chunk_id, CAST('0x' || substring(md5(query_id || chunk_id), 1, 4) AS INTEGER) AS hash_part FROM top) WHERE hash_part % 7 <> 0)"


def _graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hits, and grades of most of them from a digest: a stand-in for a judge that gives the same grades everywhere."""
    top = C.bm25(spark, d, 10)
    part = F.conv(F.substring(F.md5(F.concat("query_id", "chunk_id")), 1, 4), 16, 10).cast("int")
    grades = top.withColumn("p", part).where("p % 7 != 0").select("query_id", "chunk_id", (F.col("p") % 11 / 10).alias("grade"))
    return top, grades


@query(f"""{HITS}, top AS ({C.sql_top(10)}), {_GRADES}, p AS (SELECT t.*, coalesce(CASE WHEN chunk_type = 'child' THEN parent_id END, chunk_id) AS passage FROM top t JOIN ch USING (chunk_id)),
rep AS (SELECT query_id, passage, arg_min(chunk_id, rank) AS chunk_id FROM p GROUP BY 1, 2), kept AS (SELECT query_id, passage, grade FROM rep JOIN g USING (query_id, chunk_id) WHERE grade >= 0.5)
SELECT p.query_id, p.passage, p.chunk_id, p.rank, grade FROM p JOIN kept USING (query_id, passage)""")
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    top, grades = _graded(spark, d)
    kinds = C.brief(spark, d).select("chunk_id", F.coalesce(F.when(F.col("chunk_type") == "child", F.col("parent_id")), "chunk_id").alias("passage"))
    return quality.relevance_gate(top.join(kinds, "chunk_id"), grades, 0.5).select("query_id", "passage", "chunk_id", "rank", "grade")


@query(f"""{HITS}, top AS ({C.sql_top(10)}), {_GRADES} SELECT query_id, round(avg(grade), 6) AS score, CASE WHEN avg(grade) IS NULL OR round(avg(grade), 6) > 0.55 THEN 'use' WHEN round(avg(grade), 6) < 0.4 THEN 'web' ELSE 'combine' END AS action
FROM top LEFT JOIN g USING (query_id, chunk_id) GROUP BY 1""")
def corrective_action(spark: SparkSession, d: str) -> DataFrame:
    top, grades = _graded(spark, d)
    scored = top.join(grades, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.round(F.avg("grade"), 6).alias("score"))
    return scored.select("query_id", "score", quality.corrective_action(F.col("score"), 0.4, 0.55).alias("action"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_rescue_props(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object within a chatty answer."""
    chatty = F.concat(F.lit("Sure, here it is:\n"), "props", F.lit("\nAnything else?"))
    return table(spark, d, "events").select("event_id", json_rescue(chatty, "k bigint")["k"].alias("k"))


@query(f"""WITH {C.SQL_CHUNKS}, ids AS (SELECT qa_id, generate_subscripts(relevant_chunks, 1) AS pos, unnest(relevant_chunks) AS c FROM (SELECT DISTINCT qa_id, relevant_chunks FROM qa_pairs)),
r AS (SELECT qa_id, pos, ch.chunk_id, modality FROM ids JOIN ch ON ch.chunk_id = lower(regexp_replace(c, '^\\s+|\\s+$', '', 'g')))
SELECT qa_id, arg_min(chunk_id, pos) AS chunk_id, arg_min(modality, pos) AS modality FROM r GROUP BY 1""")
def golden_modality(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.operators.references import clean_key

    ids = table(spark, d, "qa_pairs").select("qa_id", "relevant_chunks").distinct().select(F.col("qa_id").alias("row_id"), F.posexplode("relevant_chunks").alias("pos", "c")).select("row_id", "pos", clean_key(F.col("c")).alias("chunk_id"))
    return quality.first_resolved(ids, C.chunks(spark, d).select("chunk_id", "modality")).withColumnRenamed("row_id", "qa_id")


@query(r"""WITH RECURSIVE p AS (SELECT qa_id, list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS ws FROM (SELECT DISTINCT qa_id, question FROM qa_pairs WHERE question IS NOT NULL)),
e AS (SELECT a.qa_id AS a, b.qa_id AS b FROM (SELECT qa_id, ws, unnest(ws) AS w FROM p) a JOIN (SELECT qa_id, ws, unnest(ws) AS w FROM p) b USING (w) WHERE a.qa_id < b.qa_id GROUP BY a.qa_id, b.qa_id, len(a.ws), len(b.ws) HAVING count(*) >= 0.8e0 * (len(a.ws) + len(b.ws) - count(*))),
r(round, open, kept) AS (SELECT 0, (SELECT list(DISTINCT x) FROM (SELECT a AS x FROM e UNION SELECT b FROM e)), CAST([] AS BIGINT[])
  UNION ALL SELECT round + 1, list_filter(open, lambda x: NOT list_contains(k, x) AND NOT list_contains(g, x)), list_concat(kept, k)
  FROM (SELECT round, open, kept, k, (SELECT coalesce(list(b), []) FROM e WHERE list_contains(k, a)) AS g FROM (SELECT round, open, kept, list_filter(open, lambda x: NOT list_contains(waits, x)) AS k FROM (SELECT round, open, kept, (SELECT coalesce(list(b), []) FROM e WHERE list_contains(open, a) AND list_contains(open, b)) AS waits FROM r WHERE len(open) > 0))))
SELECT qa_id FROM p WHERE qa_id NOT IN (SELECT x FROM (SELECT a AS x FROM e UNION SELECT b FROM e)) OR qa_id IN (SELECT unnest(kept) FROM (SELECT kept FROM r ORDER BY round DESC LIMIT 1))""")
def deduplicated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that stay when, in order, each drops the later ones whose words are 0.8 the same."""
    rows = table(spark, d, "qa_pairs").where("question IS NOT NULL").select("qa_id", "question").distinct()
    words = rows.select(F.col("qa_id").alias("key"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("words"))
    return sweep.greedy_keep(words.select("key"), sweep.similar_sets(words, 0.8)).select(F.col("key").alias("qa_id"))


@query(f"""WITH {C.SQL_CHUNKS}, v AS (SELECT DISTINCT id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
o AS (SELECT document_id, chunk_index, chunk_id, v, lag(v) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS p FROM ch JOIN v USING (chunk_id) WHERE chunk_index IS NOT NULL)
SELECT document_id, chunk_id, round(1 - list_cosine_similarity(p, v), 5) AS distance, 1 - list_cosine_similarity(p, v) > 0.9e0 AS breaks FROM o WHERE p IS NOT NULL""")
def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each chunk's vector from the one before it in its document, and whether a segment breaks there."""
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table(spark, d, "chunks").where(F.col("embedding").isNotNull() & F.col("chunk_index").isNotNull()).where(ok).select("document_id", "chunk_index", F.col("id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v")).distinct()
    before = F.lag("v").over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    pairs = rows.withColumn("p", before).where("p IS NOT NULL").withColumn("d", 1 - cosine(F.col("p"), F.col("v")))
    return pairs.select("document_id", "chunk_id", F.round("d", 5).alias("distance"), (F.col("d") > 0.9).alias("breaks"))
