"""Queries on hits move digests, flags and sizes of texts in place of the texts."""

from pyspark.sql import functions as F

from rivulet.operators import context
from rivulet.plans import common, evaluation, retrieval
from rivulet.plans import stages as stage_plans


def _moved(df) -> str:
    """What the exchanges of a plan are keyed by or carry."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(line for line in plan.splitlines() if "Aggregate" in line or "Exchange" in line)


def _tables(spark, folder):
    row = "id string, document_id string, chunk_index int, text string, chunk_type string, modality string, parent_id string, page_no int, created_at timestamp, deleted_at timestamp"
    rows = [("c", "d", 0, t, "child", "text", p, 1, None, None) for t, p in (("one cat", "p"), ("one cat", "p"), ("another cat", "p"))]
    rows += [("p", "d", 1, "a parent cat", "parent", "text", None, 1, None, None), ("b", "d", 2, "  ", "parent", "text", None, 1, None, None), ("k", "d", 3, "kid cat", "child", "text", "b", 1, None, None)]
    spark.createDataFrame(rows, row).coalesce(1).write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([("q", "cat", ["c"])], "id string, query string, relevant_chunk_ids array<string>").coalesce(1).write.parquet(f"{folder}/retrieval_dataset.parquet")
    return str(folder)


def test_brief_chunks_tell_texts_apart_but_move_none(spark, tmp_path):
    d = _tables(spark, tmp_path)
    short = common.brief(spark, d, size=F.length("text"))
    assert sorted((r.chunk_id, r["size"]) for r in short.collect()) == sorted((r.chunk_id, len(r.text)) for r in common.chunks(spark, d).collect())
    assert "text#" in _moved(common.chunks(spark, d)) and "text#" not in _moved(short)


def _never(*_):
    raise AssertionError("whole texts are asked for")


def test_passages_of_hits_move_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "chunks", _never)
    groups = retrieval.passage_groups(spark, _tables(spark, tmp_path))
    # both texts of c are the same passage, its parent; a blank parent is none
    assert sorted((r.passage, r.chunk_ids) for r in groups.collect()) == [("k", "k"), ("p", "c,c,p")]


def test_redundant_parents_are_found_in_one_pass_over_the_hits(spark):
    rows = [("q", "k", "p", True), ("q", "p", None, False), ("q", "s", "p", False), (None, "k", "p", True), (None, "p", None, False), ("r", "p", None, None)]
    out = context.without_redundant_parents(spark.createDataFrame(rows, "query_id string, chunk_id string, parent_id string, enriched boolean"))
    assert sorted((str(r.query_id), r.chunk_id) for r in out.collect()) == [("None", "k"), ("None", "p"), ("q", "k"), ("q", "s"), ("r", "p")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_compression_takes_no_more_of_a_text_than_the_budget_and_starts_no_task_per_query(spark):
    long = "word one. " * 50
    rows = [("q", "a", "a", long, 1), ("q", "b", "b", "rest.", 2), ("r", "n", "n", None, 1), ("r", "c", "c", "short", 2), ("r", "d", "c", "short", 3)]
    out = context.compress(spark.createDataFrame(rows, "query_id string, chunk_id string, passage string, text string, rank int"), 20)
    assert sorted((r.query_id, r.chunk_id, r.text, r["rank"]) for r in out.collect()) == [("q", "a", context.cut(long, 20), 1), ("q", "b", "rest", 2), ("r", "c", "short", 2), ("r", "d", "short", 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and ", 81)" in plan


def test_a_budget_counts_sizes_that_are_given(spark):
    hits = spark.createDataFrame([("q", "a", 1, 3), ("q", "b", 2, 4), ("q", "c", 3, 1)], "query_id string, chunk_id string, rank bigint, tokens bigint")
    assert [(r.chunk_id, r.used) for r in context.fits_whole(hits, 7, F.col("tokens")).orderBy("rank").collect()] == [("a", 3), ("b", 7)]


def test_the_relevance_gate_moves_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "chunks", _never)
    assert {r.passage for r in evaluation.relevance_gate(spark, _tables(spark, tmp_path)).collect()} <= {"p", "b"}


def test_reranking_moves_no_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "chunks", _never)
    assert stage_plans.rerank_with_fallback(spark, _tables(spark, tmp_path)).count() == 4
