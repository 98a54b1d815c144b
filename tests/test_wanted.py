"""Metrics search no further than relevant chunks can come in; repeated keys are told apart without their texts."""

import random

import pytest

from rivulet.operators import lexical
from rivulet.plans import common, evaluation


@pytest.mark.parametrize("few", [500_000, 3])
def test_hits_of_wanted_chunks_are_those_of_the_whole_search_and_hopeless_queries_are_left_out(spark, monkeypatch, few):
    monkeypatch.setattr(lexical, "FRONT", 50)
    monkeypatch.setattr(lexical, "FEW_WORDS", few)
    monkeypatch.setattr(lexical, "FEW_IDS", few)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(f"c{i:03d}", " ".join(draw.choices(words, range(60, 0, -1), k=draw.randint(0, 30)))) for i in range(400)]
    queries = [(f"q{i:02d}", " ".join([*draw.choices(words, k=4), "w0"])) for i in range(60)]
    index = lexical.build_index(spark.createDataFrame(texts, "chunk_id string, text string"))
    terms = lexical.query_terms(spark.createDataFrame(queries, "query_id string, query string"))
    hits = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in lexical.search(index, terms, 5).collect()}
    # a third has a hit, the last of five among these, a third a drawn chunk, a third none or one that is not there
    fifth = {q: c for (q, c), (_, rank) in hits.items() if rank == 5}
    wanted = [(q, fifth[q]) for q, _ in queries[:20]] + [(q, draw.choice(texts)[0]) for q, _ in queries[:40]] + [(q, "gone") for q, _ in queries[40:50]]
    out = lexical.search_wanted(index, terms, spark.createDataFrame(wanted, "query_id string, chunk_id string").distinct(), 5)
    found = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in out.collect()}
    assert {x: found.get(x) for x in wanted} == {x: hits.get(x) for x in wanted}
    assert found.items() <= hits.items()
    searched = {q for q, _ in found}
    assert searched >= {q for q, _ in queries[:20]} and len(searched) < 40


def test_a_repeated_key_counts_once_with_a_text_that_is_not_null(spark, monkeypatch):
    rows = [("a", "x y"), ("a", "x y"), ("b", None), ("b", "z"), ("c", None), ("d", "w"), (None, "n"), (None, "n")]
    frame = spark.createDataFrame(rows, "chunk_id string, text string")
    right = [("None", "n"), ("a", "x y"), ("b", "z"), ("c", None), ("d", "w")]
    for few in (500_000, 1):
        monkeypatch.setattr(lexical, "FEW_IDS", few)
        assert sorted((str(r.chunk_id), r.text) for r in lexical.single_texts(frame).collect()) == right


def test_means_and_gate_take_the_search_for_relevant_chunks(spark, tmp_path, monkeypatch):
    row = "id string, document_id string, chunk_index int, text string, chunk_type string, modality string, parent_id string, page_no int, created_at timestamp, deleted_at timestamp"
    rows = [(f"c{i}", "d", i, "cat " * (i + 1) + f"t{i}", "child", "text", None, 1, None, None) for i in range(40)]
    spark.createDataFrame([*rows, rows[3]], row).coalesce(1).write.parquet(f"{tmp_path}/chunks.parquet")
    golden = [("near", "cat t3", ["C3 ", "c4"]), ("far", "cat", ["c0"]), ("none", "cat", [])]
    spark.createDataFrame(golden, "id string, query string, relevant_chunk_ids array<string>").coalesce(1).write.parquet(f"{tmp_path}/retrieval_dataset.parquet")
    monkeypatch.setattr(lexical, "FRONT", 5)
    by_query = {r.query_id: r for r in evaluation.retrieval_metrics(spark, str(tmp_path)).collect()}
    mean = lambda name: round(sum(r[name] for r in by_query.values()) / 2, 5)
    monkeypatch.setattr(common, "bm25", None)  # every hit of every query
    means = evaluation.metric_means(spark, str(tmp_path)).first()
    assert means.asDict() == {"n": 2} | {x: pytest.approx(mean(x), abs=1e-5) for x in ("recall", "precision", "ndcg", "mrr")} and means.mrr > 0
    gate = evaluation.gate_status(spark, str(tmp_path)).first()
    assert (gate.n, gate.n_empty, gate.mean_recall, gate.status) == (2, 1, pytest.approx(mean("recall"), abs=1e-5), "FAILED: samples")
