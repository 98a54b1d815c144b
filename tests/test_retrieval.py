import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.operators import context, dense, enrich, fusion
from rivulet.operators.chunking import headings, recursive_split, sections


def test_dense_equals_brute_force_and_keeps_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    x[5] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "chunk_id bigint, v array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 5, 7)], "query_id bigint, v array<double>")
    got = {}
    for r in dense.dense_scores(asked, rows, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    for q in (0, 5, 7):
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
        s = np.round(np.divide(x @ x[q], n, out=np.zeros(60), where=n > 0), 6)
        best = sorted(range(60), key=lambda i: (-s[i], i))[:5]
        assert [c for _, c, _ in sorted(got[q])] == best
    assert dense.dense_scores(asked.limit(0), rows, 5).count() == 0


def test_fusion_rules(spark):
    lists = [("q", "a", "x", 3.0, 1), ("q", "a", "y", 2.0, 2), ("q", "b", "y", 9.0, 1), ("q", "b", "z", 9.0, 2)]
    ranked = spark.createDataFrame(lists, "query_id string, leg string, chunk_id string, score double, rank bigint")
    assert [r.chunk_id for r in fusion.rrf(ranked).orderBy("rank").collect()] == ["y", "x", "z"]
    assert {(r.leg, r.chunk_id): r.norm for r in fusion.min_max(ranked).collect()} == {("a", "x"): 1, ("a", "y"): 0, ("b", "y"): 0, ("b", "z"): 0}
    assert {r.chunk_id: r.n_legs for r in fusion.first_view(ranked).collect()} == {"x": 1, "y": 2, "z": 1}
    hits = spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 0.9, 2)], "query_id string, chunk_id string, score double, rank bigint")
    votes = spark.createDataFrame([("y", 4.0), ("x", -9.0)], "chunk_id string, feedback double")
    assert [(r.chunk_id, r.boosted) for r in fusion.feedback_boost(hits, votes, 0.1).orderBy("new_rank").collect()] == [("y", 1.3), ("x", 1.0)]
    assert fusion.candidate_cap(10) == 30 and fusion.candidate_cap(50) == 50 and fusion.candidate_cap(60, True) == 150


def test_mmr_prefers_the_different(spark):
    rows = [("q", "best", 1, [1.0, 0.0]), ("q", "copy", 2, [1.0, 0.0]), ("q", "alt", 3, [0.0, 1.0]), ("q", "zero", 4, [0.0, 0.0])]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, rank bigint, v array<double>")
    pick = lambda w, k: [r.chunk_id for r in context.mmr(hits, w, k).orderBy("mmr_rank").collect()]
    assert pick(0.5, 2) == ["best", "alt"]
    assert pick(1.0, 3) == ["best", "copy", "alt"]


def test_segments_merge_adjacent_chunks_within_the_budget(spark):
    rows = [("q", "d", None, f"c{i}", i, None, t, r) for i, t, r in ((4, "alpha beta", 2), (5, "beta gamma", 1), (7, "x", 3))] + [("q", "d", None, "p", None, None, "plain", 4)]
    hits = spark.createDataFrame(rows, "query_id string, document_id string, parent_id string, chunk_id string, chunk_index int, chunk_type string, text string, rank bigint")
    out = {r.chunk_ids: (r.text, r["rank"]) for r in context.merge_segments(hits, 100).collect()}
    assert out == {"c4,c5": ("alpha beta gamma", 1), "c7": ("x", 3), "p": ("plain", 4)}
    assert {r.chunk_ids for r in context.merge_segments(hits, 2).collect()} == {"c4", "c5", "c7", "p"}
    assert {(r.first_index, r.last_index, r.n_chunks) for r in context.islands(hits).collect()} == {(4, 5, 2), (7, 7, 1)}


def test_parents_and_budget(spark):
    hits = spark.createDataFrame([("q", "k1", "p", "kid one", 1), ("q", "k2", "p", "kid two", 2), ("q", "p", None, "parent text", 3), ("q", "s", "gone", "single", 4)], "query_id string, chunk_id string, parent_id string, text string, rank bigint")
    chunks = spark.createDataFrame([("p", "parent text"), ("k1", "kid one")], "chunk_id string, text string")
    rich = context.with_parents(hits, chunks)
    assert {r.chunk_id: r.context for r in rich.collect()} == {"k1": "parent text", "k2": "parent text", "p": "parent text", "s": "single"}
    assert {r.chunk_id for r in context.without_redundant_parents(rich).collect()} == {"k1", "k2", "s"}
    passages = rich.selectExpr("query_id", "chunk_id", "CASE WHEN enriched THEN parent_id ELSE chunk_id END AS passage", "context AS text", "rank")
    assert [r.chunk_id for r in context.compress(passages, 2).orderBy("rank").collect()] == ["k1", "k2", "p"]  # the parent is the same passage


def test_questions_stand_for_their_source(spark):
    hits = spark.createDataFrame([("q", "h1", 0.9, 1), ("q", "s", 0.5, 2), ("q", "h2", 0.8, 3), ("q", "lost", 0.7, 4)], "query_id string, chunk_id string, score double, rank bigint")
    links = spark.createDataFrame([("h1", "s"), ("h2", "t"), ("lost", None)], "chunk_id string, source_id string")
    out = [(r.chunk_id, r.score) for r in enrich.resolve_questions(hits, links).orderBy("rank").collect()]
    assert out == [("s", 0.9), ("t", 0.8)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(2, 20))
def test_chunks_fit_and_lose_no_letter(text, size):
    chunks = recursive_split(text, size, 0)
    assert all(len(c) < 4 * (size + 1) for c in chunks)
    letters = lambda t: [c for c in t if c in "ab"]
    assert letters("".join(chunks)) == letters(text)


def test_headings_skip_fences():
    text = "# One\n```\n# no\n```\nbody\n## Two #\n~~~\n# never closed"
    assert headings(text) == [(0, "One"), (5, "Two #")]
    assert [t for t, _ in sections("lead\n# A\nx\n# B\n\n# C\ny")] == [None, "A", "B", "C"]


def test_entity_hits_count_an_entity_once_and_join_no_postings(spark, monkeypatch):
    queries = spark.createDataFrame([("a", "Where is Zol?"), ("a", "Zol in Bern"), ("b", "The The"), ("c", "nothing")], "query_id string, query string")
    texts = [(f"c{i:02d}", "d", "The Zol." if i % 3 else "The Bern, Zol") for i in range(20)] + [("c00", "e", "The end")]
    edges = enrich.mentions(spark.createDataFrame(texts, "chunk_id string, document_id string, text string"))
    written = []
    monkeypatch.setattr(enrich, "materialize", lambda df, name, write=enrich.materialize: written.append(name) or write(df, name))
    got = sorted(map(tuple, enrich.entity_hits(queries, edges, 3).collect()))
    assert written == ["mentions"]
    assert got == [("a", "c00", 0.666667, 1), ("a", "c03", 0.666667, 2), ("a", "c06", 0.666667, 3), ("b", "c00", 1.0, 1), ("b", "c01", 1.0, 2), ("b", "c02", 1.0, 3)]
