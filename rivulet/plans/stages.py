"""Queries of model stages, judged metrics and golden tooling.  The model's answers are made from digests, so every engine sees the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import answers as A
from rivulet.operators import dense, enrich, fusion, judged, lexical, pipeline, quality, stages, sweep
from rivulet.operators.references import clean_key
from rivulet.plans import common as C
from rivulet.plans.retrieval import HITS
from rivulet.session import materialize
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


def _h(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int")


def _sql_h(key: str) -> str:
    return f"CAST('0x' || substring(md5(CAST({key} AS VARCHAR)), 1, 4) AS INTEGER)"


def _list(n: Column, element) -> Column:
    """JSON list text of ``n`` elements that ``element`` makes from 0, 1, ..."""
    return F.concat(F.lit("["), F.array_join(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), element)).otherwise(F.array().cast("array<string>")), ", "), F.lit("]"))


_SAMPLES = f"""s AS (SELECT qa_id, question, answer, coalesce(len(list_filter(relevant_chunks, lambda x: x IS NOT NULL)), 0) AS n_passages, {_sql_h('qa_id')} AS h FROM (SELECT DISTINCT qa_id, question, answer, relevant_chunks FROM qa_pairs)),
p AS (SELECT *, h % 9 = 0 AS parametric, coalesce(answer <> '', false) AS answered FROM s)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_pairs").select("qa_id", "question", "answer", "relevant_chunks").distinct().withColumn("h", _h(F.col("qa_id")))
    passages = F.coalesce(F.filter("relevant_chunks", lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return rows.select("qa_id", "question", "answer", passages.alias("passages"), "h", (F.col("h") % 9 == 0).alias("parametric"))


def _said(json: Column) -> Column:
    """A judge that wraps its JSON in prose, and sometimes gives none."""
    return F.when(F.col("h") % 11 == 0, "I cannot judge {this").otherwise(F.concat(F.lit("Here you are:\n```json\n"), json, F.lit("\n```\nAnything else?")))


def _metric(name: str, rows: DataFrame, score: Column) -> DataFrame:
    return rows.select("qa_id", F.round(score, 6).alias("score")).withColumn("passed", judged.passed(name, F.col("score")))


@query(f"""WITH {_SAMPLES}, q AS (SELECT qa_id, round(CASE WHEN parametric THEN 1.0e0 WHEN NOT answered OR n_passages = 0 OR h % 11 = 0 THEN 0.0e0 WHEN h % 5 = 0 THEN 1.0e0
ELSE list_sum(list_transform(generate_series(0, h % 5 - 1), lambda i: (h >> CAST(i AS INTEGER)) & 1)) / CAST(h % 5 AS DOUBLE) END, 6) AS score FROM p) SELECT qa_id, score, score > 0.8e0 AS passed FROM q""")
def judge_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d)
    bit = lambda i: F.call_function("shiftright", F.col("h"), i).bitwiseAND(1) == 1
    claims = _list(F.col("h") % 5, lambda i: F.concat(F.lit('{"claim": "c", "supported": '), bit(i).cast("string"), F.lit("}")))
    return _metric("faithfulness", rows, judged.faithfulness(_said(F.concat(F.lit('{"claims": '), claims, F.lit("}")))))


@query(f"WITH {_SAMPLES}, q AS (SELECT qa_id, round(CASE WHEN NOT answered OR h % 11 = 0 THEN 0.0e0 ELSE least(1.0e0, greatest(0.0e0, (h % 17 - 3) / 10.0e0)) END, 6) AS score FROM p) SELECT qa_id, score, score > 0.75e0 AS passed FROM q")
def judge_relevance(spark: SparkSession, d: str) -> DataFrame:
    score = ((F.col("h") % 17 - 3) / F.lit(10.0)).cast("string")
    return _metric("relevance", _samples(spark, d), judged.relevance(_said(F.concat(F.lit('{"score": '), score, F.lit("}")))))


@query(f"""WITH {_SAMPLES}, q AS (SELECT qa_id, round(CASE WHEN parametric THEN 1.0e0 WHEN n_passages = 0 OR coalesce(question, '') = '' OR h % 11 = 0 OR h % 6 = 0 THEN 0.0e0
ELSE list_sum(list_transform(generate_series(0, n_passages - 1), lambda i: (h >> CAST(i AS INTEGER)) & 1)) / CAST(n_passages AS DOUBLE) END, 6) AS score FROM p) SELECT qa_id, score, score > 0.7e0 AS passed FROM q""")
def judge_precision(spark: SparkSession, d: str) -> DataFrame:
    """One judge in six forgets a passage; its verdicts don't count."""
    rows = _samples(spark, d)
    n = F.size("passages") + F.when(F.col("h") % 6 == 0, 1).otherwise(0)
    verdicts = _list(n, lambda i: (F.call_function("shiftright", F.col("h"), i).bitwiseAND(1) == 1).cast("string"))
    return _metric("precision", rows, judged.context_precision(_said(F.concat(F.lit('{"relevant": '), verdicts, F.lit("}")))))


@query(f"WITH {_SAMPLES}, q AS (SELECT qa_id, round(CASE WHEN parametric OR NOT answered OR n_passages = 0 THEN 0.0e0 WHEN h % 11 = 0 THEN 1.0e0 ELSE h % 10 / 40.0e0 END, 6) AS score FROM p) SELECT qa_id, score, score < 0.1e0 AS passed FROM q")
def judge_hallucination(spark: SparkSession, d: str) -> DataFrame:
    return _metric("hallucination", _samples(spark, d), judged.hallucination(F.when(F.col("h") % 11 != 0, F.col("h") % 10 / F.lit(40.0))))


@query(f"""WITH {C.SQL_CHUNKS}, ids AS (SELECT qa_id, generate_subscripts(relevant_chunks, 1) AS pos, unnest(relevant_chunks) AS c FROM (SELECT DISTINCT qa_id, relevant_chunks FROM qa_pairs)),
k AS (SELECT qa_id, arg_min(modality, pos) AS modality FROM ids JOIN ch ON ch.chunk_id = lower(regexp_replace(c, '^\\s+|\\s+$', '', 'g')) GROUP BY 1),
g AS (SELECT modality, CASE WHEN qa_id % 2 = 0 THEN 3 ELSE 9 END AS n_relevant, qa_id % 4 AS variant FROM k WHERE modality IN ('table', 'figure')),
v AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 1000000), (3, 1)) t(gate_no, least_samples)),
o AS (SELECT gate_no, least_samples, count(*) FILTER (modality = 'table') AS n_table, count(*) FILTER (modality = 'figure') AS n_figure, min(least(n_relevant, 5) / n_relevant) FILTER (modality = 'table') AS lt, min(least(n_relevant, 5) / n_relevant) FILTER (modality = 'figure') AS lf
  FROM v LEFT JOIN g ON (gate_no <> 0) AND (gate_no = 3 OR n_relevant = 3) GROUP BY 1, 2)
SELECT gate_no, n_table, n_figure, CASE WHEN n_table + n_figure = 0 THEN 'SKIPPED' WHEN n_table > 0 AND n_table < least_samples THEN 'FAILED: table samples' WHEN n_table > 0 AND lt < 0.6e0 THEN 'FAILED: table recall'
WHEN n_figure > 0 AND n_figure < least_samples THEN 'FAILED: figure samples' WHEN n_figure > 0 AND lf < 0.6e0 THEN 'FAILED: figure recall' ELSE 'PASSED' END AS status FROM o""")
def modality_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gate of table and figure goldens in four settings: no samples, all well, too few, and rows that no ranking could satisfy."""
    ids = table(spark, d, "qa_pairs").select("qa_id", "relevant_chunks").distinct().select(F.col("qa_id").alias("row_id"), F.posexplode("relevant_chunks").alias("pos", "c")).select("row_id", "pos", clean_key(F.col("c")).alias("chunk_id"))
    kinds = quality.first_resolved(ids, C.chunks(spark, d).select("chunk_id", "modality")).where("modality IN ('table', 'figure')")
    goldens = kinds.select("modality", F.when(F.col("row_id") % 2 == 0, 3).otherwise(9).alias("n_relevant"))
    out = None
    for gate_no, some, least in ((0, "false", 0), (1, "n_relevant = 3", 1), (2, "n_relevant = 3", 1_000_000), (3, "true", 1)):
        one = judged.modality_gate(goldens.where(some), {"table": least, "figure": least}, {"table": 0.6, "figure": 0.6}).select(F.lit(gate_no).alias("gate_no"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {C.SQL_CHUNKS}, g AS (SELECT DISTINCT qa_id, answer, relevant_chunks FROM qa_pairs), ids AS (SELECT qa_id, lower(regexp_replace(unnest(relevant_chunks), '^\\s+|\\s+$', '', 'g')) AS c FROM g),
there AS (SELECT DISTINCT qa_id, chunk_id FROM ids JOIN ch ON ch.chunk_id = c), lost AS (SELECT DISTINCT qa_id, lower(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) AS needle FROM g WHERE qa_id NOT IN (SELECT qa_id FROM there))
SELECT * FROM there UNION SELECT qa_id, chunk_id FROM lost JOIN ch ON contains(lower(text), needle) WHERE needle <> ''""")
def remapped_goldens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_pairs").select(F.col("qa_id").alias("row_id"), "answer", F.transform("relevant_chunks", clean_key).alias("ids")).distinct()
    return judged.remap_goldens(rows, C.chunks(spark, d).select("chunk_id", "text")).withColumnRenamed("row_id", "qa_id")


_Q = f"q AS (SELECT query_id, query, {_sql_h('query_id')} AS h FROM qs)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return C.questions(spark, d).withColumn("h", _h(F.col("query_id")))


@query(f"""WITH {C.SQL_QUESTIONS}, {_Q}, v AS (SELECT query_id, query, h, CASE WHEN h % 11 = 0 OR h % 4 = 0 THEN [] ELSE list_transform(generate_series(0, least(h % 4, 3) - 1), lambda i: 'variant ' || i || ' of ' || query_id) END AS e FROM q),
t AS (SELECT query_id, list_concat(list_concat([trim(query)], CASE WHEN h % 3 = 0 THEN list_concat(e[:1], [trim(query)])[:2] ELSE e[:2] END), CASE WHEN h % 2 = 0 THEN ['broader ' || query_id] ELSE [] END) AS l FROM v),
o AS (SELECT query_id, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM t), f AS (SELECT query_id, text, min(pos) AS pos FROM o WHERE text <> '' GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS variant_no, text FROM f""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Two expansions and a broader question at most; the model repeats the question now and then, or gives nothing that can be read."""
    rows = _asked(spark, d)
    made = F.when(F.col("h") % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.least(F.col("h") % 4, F.lit(3)) - 1), lambda i: F.concat(F.lit("variant "), i.cast("string"), F.lit(" of "), F.col("query_id"))))
    made = F.when(F.col("h") % 3 == 0, F.concat(F.when(F.col("h") % 11 == 0, F.array().cast("array<string>")).otherwise(F.slice(made, 1, 1)), F.array(F.trim("query")))).otherwise(made)
    response = F.when((F.col("h") % 11 == 0) & (F.col("h") % 3 != 0), "none [really").otherwise(F.concat(F.lit("Variants: "), F.to_json(made)))
    given = rows.select("query_id", "query", response.alias("expansion"), F.when(F.col("h") % 2 == 0, F.concat(F.lit("broader "), "query_id")).alias("step_back"))
    return stages.query_variants(given, 2)


@query(f"""WITH {C.SQL_QUESTIONS}, {_Q}, k AS (SELECT query_id, CASE WHEN h % 11 = 0 THEN 'factual' ELSE ['factual', 'analytical', 'opinion', 'contextual', 'factual'][h % 5 + 1] END AS kind FROM q)
SELECT query_id, kind, s.top_k, s.n_variants, s.hyde, s.compression FROM k JOIN (VALUES ('factual', 30, 1, false, true), ('analytical', 50, 3, true, true), ('opinion', 20, 2, false, false), ('contextual', 40, 2, false, true)) s(kind, top_k, n_variants, hyde, compression) USING (kind)""")
def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("factual", "analytical", "opinion", "contextual", "riddle")]), F.col("h") % 5 + 1)
    rows = _asked(spark, d).withColumn("response", _said(F.concat(F.lit('{"category": "'), kind, F.lit('", "reasoning": "r"}'))))
    return stages.classified(rows).select("query_id", "kind", "top_k", "n_variants", "hyde", "compression")


@query(f"""WITH {C.SQL_QUESTIONS}, {_Q} SELECT query_id, CASE WHEN h % 11 = 0 THEN true ELSE h % 2 = 0 END AS retrieve, CASE WHEN h % 11 = 0 THEN true ELSE h % 3 <> 0 END AS supported,
CASE WHEN h % 11 = 0 OR h % 5 = 4 OR h % 13 > 10 THEN 0.5e0 ELSE h % 13 / 10.0e0 END AS score, CASE WHEN h % 11 = 0 OR h % 5 = 4 OR h % 13 > 10 THEN 'accept' ELSE ['accept', 're_retrieve', 'refuse', 'accept'][h % 5 + 1] END AS action FROM q""")
def self_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = _asked(spark, d)
    need = _said(F.concat(F.lit('{"need_retrieval": '), (F.col("h") % 2 == 0).cast("string"), F.lit(', "reasoning": ""}')))
    support = _said(F.concat(F.lit('{"supported": '), (F.col("h") % 3 != 0).cast("string"), F.lit(', "reasoning": ""}')))
    action = F.element_at(F.array(*[F.lit(x) for x in ("accept", "re_retrieve", "refuse", "accept", "shrug")]), F.col("h") % 5 + 1)
    utility = _said(F.concat(F.lit('{"score": '), (F.col("h") % 13 / F.lit(10.0)).cast("string"), F.lit(', "action": "'), action, F.lit('"}')))
    return stages.self_check(rows, need, support, utility).select("query_id", "retrieve", "supported", F.round("score", 6).alias("score"), "action")


@query(f"""WITH {C.SQL_QUESTIONS}, {_Q}, k AS (SELECT query_id, h, CASE WHEN h % 11 = 0 OR h % 6 = 5 THEN 'ANSWER' ELSE ['ANSWER', 'RETRIEVE_MORE', 'GRAPH_LOOKUP', 'CLARIFY', 'ANSWER'][h % 6 + 1] END AS action, h % 11 <> 0 AND h % 6 <> 5 AS read FROM q)
SELECT query_id, action, CASE WHEN read THEN 'more ' || query_id ELSE '' END AS refined_query, CASE WHEN read AND h % 2 = 0 THEN 2 ELSE 0 END AS n_entities FROM k""")
def agent_decisions(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(x) for x in ("answer", "RETRIEVE_MORE", "graph_lookup", "Clarify", "ANSWER", "DANCE")]), F.col("h") % 6 + 1)
    entities = F.when(F.col("h") % 2 == 0, ', "entities": ["A", "B"]').otherwise("")
    said = _said(F.concat(F.lit('{"action": "'), action, F.lit('", "refined_query": "more '), F.col("query_id"), F.lit('"'), entities, F.lit("}")))
    return _asked(spark, d).select("query_id", A.decision(said).alias("s")).select("query_id", "s.action", "s.refined_query", F.size("s.entities").alias("n_entities"))


_CH = f"c AS (SELECT chunk_id, document_id, chunk_index, text, {_sql_h('chunk_id')} AS h FROM ch)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(spark, d).withColumn("h", _h(F.col("chunk_id")))


@query(f"""WITH {C.SQL_CHUNKS}, {_CH}, e AS (SELECT chunk_id, unnest(generate_series(0, h % 4 - 1)) AS i, h FROM c WHERE h % 11 <> 0 AND h % 4 > 0)
SELECT DISTINCT chunk_id, 'S' || (h % 50) AS subject, 'rel' || (i % 2) AS relation, 'O' || ((h + i) % 50) AS object FROM e WHERE (h + i) % 5 <> 0""")
def graph_triples(spark: SparkSession, d: str) -> DataFrame:
    """Edges from listed triples; those without an object are none."""
    item = lambda i: F.concat(F.lit('{"subject": " S'), (F.col("h") % 50).cast("string"), F.lit('", "relation": "rel'), (i % 2).cast("string"), F.when((F.col("h") + i) % 5 == 0, F.lit('"}')).otherwise(F.concat(F.lit('", "object": "O'), ((F.col("h") + i) % 50).cast("string"), F.lit('"}'))))
    listed = _list(F.col("h") % 4, item)
    return stages.graph_edges(_chunks(spark, d).select("chunk_id", F.when(F.col("h") % 11 == 0, "no [triples").otherwise(F.concat(F.lit("Triples: "), listed)).alias("response")))


@query(f"""WITH {C.SQL_CHUNKS}, {_CH}, e AS (SELECT chunk_id, h, unnest(generate_series(0, h % 4 - 1)) AS i FROM c WHERE h % 11 <> 0 AND h % 4 > 0) SELECT chunk_id AS source_chunk_id, i AS question_no, 'What is ' || ((h + i) % 9) || '?' AS text FROM e""")
def synthetic_questions(spark: SparkSession, d: str) -> DataFrame:
    listed = _list(F.col("h") % 4, lambda i: F.concat(F.lit('"What is '), ((F.col("h") + i) % 9).cast("string"), F.lit('? "')))
    return stages.question_chunks(_chunks(spark, d).select("chunk_id", F.when(F.col("h") % 11 == 0, "none").otherwise(listed).alias("response")))


@query(f"""WITH {C.SQL_CHUNKS}, s AS (SELECT DISTINCT document_id, {_sql_h('document_id')} AS h FROM ch WHERE document_id IS NOT NULL), a AS (SELECT document_id, 'detail' AS type, count(*) AS n FROM ch GROUP BY 1)
SELECT document_id, type, n FROM a UNION ALL SELECT document_id, 'summary', 1 FROM s WHERE h % 3 <> 0""")
def document_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary chunk beside the details of each document whose model call gave one."""
    chunks = C.chunks(spark, d)
    responses = chunks.where("document_id IS NOT NULL").select("document_id").distinct().select("document_id", F.when(_h(F.col("document_id")) % 3 == 0, " ").otherwise(F.concat(F.lit("Summary of "), "document_id")).alias("response"))
    return stages.with_summaries(chunks, responses).groupBy("document_id", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {C.SQL_CHUNKS}, {_CH}, e AS (SELECT document_id, chunk_index, h, unnest(generate_series(0, h % 4 - 1)) AS i FROM c WHERE h % 11 <> 0 AND h % 4 > 0 AND chunk_index IS NOT NULL),
g AS (SELECT document_id, chunk_index, i, 'fact ' || ((h + i) % 7) AS k FROM e WHERE (h + i) % 10 >= 6 AND (h + i) % 13 <> 0), f AS (SELECT document_id, k, min({{'s': chunk_index, 'i': i}}) AS place FROM g GROUP BY 1, 2)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY place.s, place.i) - 1 AS proposition_index, k AS text FROM f""")
def proposition_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Graded propositions, each once a document; a grade of 6 and less, or one that can't be read, drops it."""
    rows = _chunks(spark, d).where("chunk_index IS NOT NULL").select("document_id", F.col("chunk_index").alias("segment_no"), "h").dropDuplicates(["document_id", "segment_no", "h"])
    listed = _list(F.col("h") % 4, lambda i: F.concat(F.lit('"fact '), F.when(i % 2 == 1, F.lit(" ")).otherwise(F.lit("")), ((F.col("h") + i) % 7).cast("string"), F.lit('"')))
    grade = lambda i: (F.col("h") + i) % 10 + 1
    graded = F.when(F.col("h") % 4 > 0, F.transform(F.sequence(F.lit(0), F.col("h") % 4 - 1), lambda i: F.when((F.col("h") + i) % 13 == 0, F.lit("{}")).otherwise(F.concat(F.lit('Grades: {"accuracy": '), grade(i).cast("string"), F.lit(', "clarity": "9", "completeness": 8.0, "conciseness": 10}')))))
    out = stages.propositions(rows.select("document_id", "segment_no", F.when(F.col("h") % 11 == 0, "none").otherwise(listed).alias("response"), graded.alias("graded")))
    return out.withColumn("text", A.proposition_key(F.col("text")))


_TOP = f"{HITS}, top AS ({C.sql_top(10)}), p AS (SELECT t.*, coalesce(CASE WHEN chunk_type = 'child' THEN parent_id END, chunk_id) AS passage, {_sql_h('query_id || chunk_id')} AS h FROM top t JOIN ch USING (chunk_id))"


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    kinds = C.brief(spark, d).select("chunk_id", F.coalesce(F.when(F.col("chunk_type") == "child", F.col("parent_id")), "chunk_id").alias("passage"))
    return C.bm25(spark, d, 10).join(kinds, "chunk_id").withColumn("h", _h(F.concat("query_id", "chunk_id")))


@query(f"{_TOP}, r AS (SELECT query_id, passage, arg_min('reason ' || h, rank) AS reason FROM p WHERE h % 3 <> 0 GROUP BY 1, 2) SELECT query_id, chunk_id, reason FROM p JOIN r USING (query_id, passage)")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    """What the model said of one chunk of a passage holds for all of them."""
    hits = _grouped(spark, d)
    given = hits.where("h % 3 != 0").select("query_id", "chunk_id", F.concat(F.lit("reason "), F.col("h").cast("string")).alias("reason"))
    return stages.spread_to_group(given, hits.select("query_id", "passage", "chunk_id", "rank"), "reason")


@query(f"""{_TOP}, ids AS (SELECT query_id, rank AS pos, CASE WHEN h % 5 = 0 THEN 'nowhere' WHEN h % 2 = 0 THEN passage ELSE chunk_id END AS source_id FROM p), f AS (SELECT query_id, source_id, min(pos) AS pos FROM ids GROUP BY 1, 2),
ways AS (SELECT query_id, chunk_id AS source_id, chunk_id, 0 AS way FROM p UNION ALL SELECT query_id, passage, chunk_id, 1 FROM p)
SELECT query_id, source_id, pos, arg_min(chunk_id, {{'w': way, 'c': chunk_id}}) AS chunk_id FROM f JOIN ways USING (query_id, source_id) GROUP BY 1, 2, 3""")
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    hits = _grouped(spark, d)
    source = F.when(F.col("h") % 5 == 0, "nowhere").when(F.col("h") % 2 == 0, F.col("passage")).otherwise(F.col("chunk_id"))
    return stages.citations(hits.select("query_id", F.col("rank").alias("pos"), source.alias("source_id")), hits.select("query_id", "chunk_id", F.array("passage").alias("merged_ids")))


@query(f"""WITH {C.SQL_CHUNKS}, {_CH}, s AS (SELECT chunk_id, text, h, array_to_string(string_split_regex(trim(substring(regexp_replace(text, '\\s+', ' ', 'g'), 11, 40)), '\\s+'), ' ') AS want FROM c WHERE text IS NOT NULL)
SELECT chunk_id, want <> '' AND h % 7 <> 0 AS found FROM s WHERE regexp_full_match(text, '[\\x20-\\x7e\\n]*')""")
def verbatim_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans quoted with other white space are found word for word; invented ones are not."""
    rows = _chunks(spark, d).where("text IS NOT NULL").where(F.col("text").rlike(r"^[\x20-\x7e\n]*\z"))
    span = F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 11, 40))
    span = F.when(F.col("h") % 7 == 0, F.concat(F.lit("☃ "), span)).otherwise(span)
    return rows.select("chunk_id", (A.verbatim(span, F.col("text")).isNotNull()).alias("found"))


@query(f"""{HITS}, top AS ({C.sql_top(10)}), t AS (SELECT query_id, count(*) AS n, {_sql_h('query_id')} AS h FROM qs LEFT JOIN top USING (query_id) GROUP BY query_id)
SELECT query_id, h % 4 = 0 AS refused, CASE WHEN h % 4 = 0 THEN 13 ELSE 3 END AS token_count FROM t""")
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Without context the reply is fixed."""
    rows = _asked(spark, d).select("query_id", F.when(F.col("h") % 4 == 0, " ").otherwise("context").alias("context"), F.lit(" an answer  here").alias("response"))
    return stages.answered(rows).select("query_id", (F.col("answer") == stages.NO_CONTEXT).alias("refused"), "token_count")


@query(f"""WITH {C.SQL_QUESTIONS}, {_Q} SELECT query_id, ['use', 'combine', 'web'][h % 3 + 1] AS action, CASE h % 3 WHEN 0 THEN 'found' WHEN 1 THEN CASE WHEN h % 2 = 0 THEN 'found' ELSE 'found' || chr(10) || chr(10) || 'web' END ELSE CASE WHEN h % 2 = 0 THEN '' ELSE 'web' END END AS context FROM q""")
def corrected_context(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(x) for x in ("use", "combine", "web")]), F.col("h") % 3 + 1)
    return stages.corrected_context(_asked(spark, d).select("query_id", action.alias("action"), F.lit("found").alias("retrieved"), F.when(F.col("h") % 2 == 1, " web ").alias("web")))


@query(f"""{_TOP}, r AS (SELECT *, bool_or(h % 97 = 0) OVER (PARTITION BY query_id) AS failed FROM p), o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE -(h % 40) END, rank, chunk_id) AS rank FROM r) SELECT * FROM o WHERE rank <= 5""")
def rerank_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """New scores decide the order; where the model failed for a query its first five stay."""
    return stages.reranked(_grouped(spark, d).select("query_id", "chunk_id", "rank", F.when(F.col("h") % 97 != 0, (F.col("h") % 40).cast("double")).alias("rescore")), 5)


@query(f"""WITH {C.SQL_COSINE}, a AS (SELECT chunk_id - 1 AS query_id, v AS qv FROM v WHERE (chunk_id - 1) % 50 = 0 AND {_sql_h('chunk_id - 1')} % 5 <> 0), s AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qv, v), 6) AS score FROM a, v) {C.sql_top(10, 's')}""")
def hypothetical_passages(spark: SparkSession, d: str) -> DataFrame:
    """Dense search with the vector of a hypothetical passage (here the next row's) in place of the query's; no passage, no leg."""
    rows, _ = C.vector_rows(spark, d)
    made = rows.where("(chunk_id - 1) % 50 = 0").select((F.col("chunk_id") - 1).alias("query_id"), "v").where(_h(F.col("query_id")) % 5 != 0)
    return dense.dense_scores(made, rows.select("chunk_id", "v"), 10)


# --- the whole retrieval, and comparisons of its settings

_ENT = "list_filter(string_split_regex({t}, '[,;.!?\\s]+'), lambda w: length(w) > 1 AND regexp_matches(w, '^\\p{{Lu}}'))"
_LEGS = f"""{HITS}, lex AS ({C.sql_top(30)}), asked AS (SELECT DISTINCT query_id, unnest({_ENT.format(t='query')}) AS entity FROM qs), edges AS (SELECT DISTINCT chunk_id, unnest({_ENT.format(t='text')}) AS entity FROM ch WHERE text IS NOT NULL),
n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY 1), gs AS (SELECT query_id, chunk_id, round(count(DISTINCT entity) / any_value(n), 6) AS score FROM asked JOIN edges USING (entity) JOIN n USING (query_id) GROUP BY 1, 2), gr AS ({C.sql_top(30, 'gs')}),
both_legs AS (SELECT query_id, '1lexical' AS leg, chunk_id, rank FROM lex UNION ALL SELECT query_id, '2graph', chunk_id, rank FROM gr),
fs AS (SELECT query_id, chunk_id, round(sum((CASE WHEN leg = '2graph' THEN 0.5e0 ELSE 1.0e0 END) / (60 + rank)), 8) AS score, min({{'leg': leg, 'rank': rank}}) AS seen FROM both_legs GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen.leg, seen.rank, chunk_id) AS rank FROM fs) WHERE rank <= 30),
fh AS (SELECT *, {_sql_h('query_id || chunk_id')} AS h FROM fused), fl AS (SELECT *, bool_or(h % 397 = 0) OVER (PARTITION BY query_id) AS failed FROM fh),
re AS (SELECT * FROM (SELECT query_id, chunk_id, h, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN failed THEN 0 ELSE -(h % 40) END, rank, chunk_id) AS rank FROM fl) WHERE rank <= 10)"""


def _legs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    asked = C.questions(spark, d)
    return {"1lexical": lexical.search(C.lexical_index(spark, d), lexical.query_terms(asked), 30), "2graph": enrich.entity_hits(asked, enrich.mentions(C.chunks(spark, d)), 30)}


def _rescored(hits: DataFrame) -> DataFrame:
    h = _h(F.concat("query_id", "chunk_id"))
    return hits.select("query_id", "chunk_id", F.when(h % 397 != 0, (h % 40).cast("double")).alias("rescore"))


@query(f"""{_LEGS}, e AS (SELECT r.*, ch.parent_id, ch.text, coalesce(trim(p.text) <> '', false) AS enriched, p.text AS parent_text FROM re r JOIN ch USING (chunk_id) LEFT JOIN ch p ON p.chunk_id = ch.parent_id),
k AS (SELECT query_id, chunk_id, rank, h, CASE WHEN enriched THEN parent_id ELSE chunk_id END AS passage, CASE WHEN enriched THEN parent_text ELSE text END AS context FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.enriched AND b.query_id = a.query_id AND b.parent_id = a.chunk_id)),
rep AS (SELECT query_id, passage, arg_min(h, rank) AS h FROM k GROUP BY 1, 2), ok AS (SELECT query_id, passage FROM rep WHERE h % 10 >= 4)
SELECT query_id, chunk_id, rank, md5(context) AS context FROM (SELECT query_id, chunk_id, context, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM k JOIN ok USING (query_id, passage)) WHERE rank <= 5""")
def retrieve_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and graph legs fused, reranked (with failures), given their parents, graded and cut to five."""
    config = pipeline.Config(weights={"2graph": 0.5}, least_grade=0.4)
    legs = _legs(spark, d)
    # written once, as rescores and grades both read it
    hits = materialize(pipeline.fused(legs, config), "fused")
    grades = hits.select("query_id", "chunk_id", (_h(F.concat("query_id", "chunk_id")) % 10 / 10).alias("grade"))
    return pipeline.retrieve(legs, C.chunks(spark, d), config, rescores=_rescored(hits), grades=grades).withColumn("context", F.md5("context"))


@query(f"""{_LEGS}, {C.SQL_RELEVANT}, runs AS (SELECT 'lexical' AS setting, query_id, chunk_id, rank FROM lex UNION ALL SELECT 'graph', query_id, chunk_id, rank FROM gr UNION ALL SELECT 'fused', query_id, chunk_id, rank FROM fused UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM re),
names AS (SELECT unnest(['lexical', 'graph', 'fused', 'reranked', 'none']) AS setting), size AS (SELECT setting, query_id, count(*) AS n_rel FROM rel, names GROUP BY 1, 2),
h AS (SELECT setting, query_id, count(DISTINCT chunk_id) AS found, count(*) AS n, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM runs JOIN rel USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY 1, 2),
m AS (SELECT setting, round(coalesce(found / n_rel, 0), 6) AS recall, round(coalesce(n / 5, 0), 6) AS precision, round(coalesce(dcg / list_sum(list_transform(generate_series(1, least(n_rel, 5)), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM size LEFT JOIN h USING (setting, query_id))
SELECT setting, count(*) AS n, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr FROM m GROUP BY 1""")
def technique_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of each technique, one that gives nothing among them."""
    legs = _legs(spark, d)
    # written once, as four of the settings read it
    hits = materialize(pipeline.fused(legs, pipeline.Config(weights={"2graph": 0.5})), "fused")
    reranked = stages.reranked(hits.join(_rescored(hits), ["query_id", "chunk_id"]), 10)
    runs = {"lexical": legs["1lexical"], "graph": legs["2graph"], "fused": hits, "reranked": reranked, "none": hits.where("false")}
    return sweep.compare(runs, C.relevant(spark, d), 5)


@query(f"""{_LEGS}, votes AS (SELECT 'c' AS side, chunk_id, {_sql_h('chunk_id')} AS h FROM ch) SELECT query_id, chunk_id, min(leg) AS leg, count(DISTINCT leg) AS n_legs, max(CASE WHEN leg = '1lexical' THEN rank END) AS lexical_rank, max(CASE WHEN leg = '2graph' THEN rank END) AS graph_rank FROM both_legs GROUP BY 1, 2""")
def merged_views(spark: SparkSession, d: str) -> DataFrame:
    """The view of the first leg, with what only later ones know added."""
    legs = _legs(spark, d)
    return fusion.merged_views({"1lexical": legs["1lexical"].select("query_id", "chunk_id", F.col("rank").alias("lexical_rank")), "2graph": legs["2graph"].select("query_id", "chunk_id", F.col("rank").alias("graph_rank"))})
