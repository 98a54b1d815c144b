import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rivulet.operators import lexical

DOCS = [("c0", "the cat sat on the mat"), ("c1", "the dog ate the cat food"), ("c2", "birds fly"), ("c3", None), ("c4", "   "), ("c5", "the the the")]


def brute(docs, query):
    toks = {i: t.lower().split() for i, t in docs if t is not None}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for ws in toks.values() for w in set(ws))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for i, ws in toks.items():
        tf = Counter(ws)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in query.lower().split() if w in tf)
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return out


def test_scores_equal_brute_force(spark):
    index = lexical.build_index(spark.createDataFrame(DOCS, "chunk_id string, text string"))
    asked = spark.createDataFrame([("q1", "The cat cat"), ("q2", "nothing here"), ("q3", "birds the")], "query_id string, query string")
    got = {}
    for r in lexical.bm25_scores(index, lexical.query_terms(asked)).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert got.get("q1", {}) == brute(DOCS, "the cat cat")
    assert "q2" not in got
    assert got.get("q3", {}) == brute(DOCS, "birds the")


def test_common_words_count_positively(spark):
    docs = [(f"d{i}", f"common word{i}") for i in range(6)]
    stats = {r.term: r.idf for r in lexical.build_index(spark.createDataFrame(docs, "chunk_id string, text string")).term_stats.collect()}
    assert 0 < stats["common"] < stats["word1"]


def test_soft_view_equals_a_rebuild(spark):
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string")
    base = lexical.build_index(frame(DOCS)).term_stats
    gone = lexical.build_index(frame(DOCS[:1]), persist=False).postings.selectExpr("term", "-1 AS sign")
    soft = {r.term: r.df for r in lexical.soft_view(base, gone).collect()}
    assert soft == {r.term: r.df for r in lexical.build_index(frame(DOCS[1:])).term_stats.collect()}


def test_empty_corpus_and_ties(spark):
    empty = lexical.build_index(spark.createDataFrame([], "chunk_id string, text string"))
    asked = spark.createDataFrame([("q", "cat")], "query_id string, query string")
    assert lexical.bm25_scores(empty, lexical.query_terms(asked)).count() == 0
    scored = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "query_id string, chunk_id string, score double")
    assert [(r.chunk_id, r["rank"]) for r in lexical.top_k(scored, 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    assert sorted(map(tuple, lexical.last_write_wins(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert lexical.last_write_wins(old, new.limit(0)).count() == 2


def test_block_best_equals_full_scores(monkeypatch):
    monkeypatch.setattr(lexical, "LONG_LIST", 1)
    rng = np.random.default_rng(3)
    for trial in range(40):
        n, terms, k = 60, 6, 5
        lists = [np.flatnonzero(rng.random(n) < p) for p in (0.03, 0.1, 0.3, 0.6, 0.9, 1.0)]
        weights = [np.full(len(x), 9.0 / (1 + t)) * rng.integers(1, 3, len(x)) for t, x in enumerate(lists)]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        qtf = rng.integers(1, 3, terms).astype(float)
        full = np.zeros(n)
        for x, w, q in zip(lists, weights, qtf):
            full[x] += w * q
        at, scores = lexical.block_best(starts, np.concatenate(lists), np.concatenate(weights), np.arange(terms), qtf, n, k)
        kth = np.sort(full)[-k]
        assert set(at) == set(np.flatnonzero(full >= kth - 1e-9)) and np.allclose(scores, full[at])


def test_search_equals_scored_pairs(spark):
    texts = [(f"c{i:03d}", " ".join(["common"] * (1 + i % 3) + [f"t{i % 7}", f"u{i % 11}"] + (["rare"] if i == 50 else []))) for i in range(120)] + [("empty", "")]
    index = lexical.build_index(spark.createDataFrame(texts, "chunk_id string, text string"))
    asked = lexical.query_terms(spark.createDataFrame([("a", "common t3"), ("b", "rare u2 t1"), ("c", "unknown"), ("d", "t1 t1 common")], "query_id string, query string"))
    want = lexical.top_k(lexical.bm25_scores(index, asked), 4)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    assert rows(lexical.search(index, asked, 4)) == rows(want)
    some = spark.createDataFrame([("c050",), ("c001",), ("c001",)], "chunk_id string")
    assert {(r.query_id, r.chunk_id) for r in lexical.search(index, asked, 4, some).collect()} == {("a", "c050"), ("a", "c001"), ("b", "c050"), ("b", "c001"), ("d", "c050"), ("d", "c001")}
    assert lexical.search(index, asked.limit(0), 4).count() == 0


def test_versions_additions_and_removals(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string")
    folder = f"file://{tmp_path}/index"
    lexical.build_index(frame(DOCS)).save(folder)
    first = lexical.LexicalIndex.load(spark, folder)
    changed = lexical.with_added(lexical.without(first, frame(DOCS[:1])), frame([(DOCS[1][0], "quite another text"), ("new", "one more text")]))
    changed.save(folder)
    lexical.drop_versions(spark, folder)
    again = lexical.LexicalIndex.load(spark, folder)
    fresh = lexical.build_index(frame([*DOCS[2:], (DOCS[1][0], "quite another text"), ("new", "one more text")]))
    for name in ("postings", "term_stats", "corpus"):
        rows = lambda ix, name=name: sorted(map(tuple, getattr(ix, name).collect()))
        assert [r[:2] for r in rows(again)] == [r[:2] for r in rows(fresh)]


def test_a_search_makes_no_row_per_posting_and_asks_alike_queries_once(spark, monkeypatch):
    texts = [(f"c{i:03d}", " ".join(["common"] * (1 + i % 3) + [f"t{i % 7}", f"u{i % 11}"])) for i in range(120)]
    index = lexical.build_index(spark.createDataFrame(texts, "chunk_id string, text string"))
    asked = lexical.query_terms(spark.createDataFrame([("a", "common t3"), ("b", "T3 common"), ("c", "u2 t1")], "query_id string, query string"))
    want = lexical.top_k(lexical.bm25_scores(index, asked), 5)
    written = {}
    monkeypatch.setattr(lexical, "materialize", lambda df, name, write=lexical.materialize: written.setdefault(name, write(df, name)))
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())
    monkeypatch.setattr(lexical, "release", lambda *tables: None)
    assert rows(lexical.search(index, asked, 5)) == rows(want)
    assert sorted(len(r.same) for r in written["asked"].collect()) == [1, 2]
    gathered = lexical.LexicalIndex(index.postings, index.doc_len, index.term_stats, index.corpus)
    assert sorted(len(r.ts) for r in gathered.hashed().collect()) == sorted(len(t.split()) for _, t in texts)
    written.clear()
    assert rows(lexical.search(gathered, asked, 5)) == rows(want)


def test_negative_weights_count(spark):
    # four of five words are in nearly all chunks, so the share of the mean is below zero
    texts = [(f"c{i}", "a b c d" if i else "a b c d rare") for i in range(9)]
    index = lexical.build_index(spark.createDataFrame(texts, "chunk_id string, text string"))
    asked = lexical.query_terms(spark.createDataFrame([("q", "a rare"), ("r", "a b")], "query_id string, query string"))
    want = [(r.query_id, r.chunk_id, r.score) for r in lexical.top_k(lexical.bm25_scores(index, asked), 3).collect()]
    assert [(r.query_id, r.chunk_id, r.score) for r in lexical.search(index, asked, 3).collect()] == want and len(want) == 1


def test_a_block_adds_lists_that_queries_share_once(monkeypatch):
    rng = np.random.default_rng(5)
    n, k = 300, 4
    chunks = [rng.integers(0, 12, rng.integers(1, 9)) for _ in range(n)]
    weights = np.array([0.2, 0.3, 0.1, 1.0, 0.5, 0.5, 2.0, 1.0, 1.5, 0.0, 3.0, 0.7])
    size = np.array([len(c) for c in chunks])
    block = lexical.Block(size, np.concatenate(chunks), np.arange(12), weights, size / size.mean(), k)
    queries = [np.unique(rng.integers(0, 12, 4)) for _ in range(60)]
    added = []
    monkeypatch.setattr(lexical.Block, "_add", lambda self, t, *rest, add=lexical.Block._add: added.append(t) or add(self, t, *rest))
    paths = sorted((block.path(q, np.ones(len(q))), i) for i, q in enumerate(queries))
    for (_, i), (at, scores) in zip(paths, list(block.best([p for p, _ in paths]))):
        full = np.zeros(n)
        for t in queries[i]:
            full[block.chunk[block.starts[t] : block.starts[t + 1]]] += block.weight[block.starts[t] : block.starts[t + 1]]
        best = np.lexsort((np.arange(n), -np.round(full, 6)))[:k]
        best = best[np.round(full[best], 6) > 0]
        assert at.tolist() == best.tolist() and np.allclose(scores, full[best], atol=1e-6)
    assert not block.scores.any() and len(added) == len({p[: j + 1] for p, _ in paths for j in range(len(p))})


def test_each_task_of_a_search_gets_one_block(spark):
    labels = lexical.block_labels(spark, 7)
    parts = spark.createDataFrame([(x,) for x in labels], "slot int").repartition(7, "slot").select(F.spark_partition_id()).collect()
    assert sorted(r[0] for r in parts) == list(range(7))


def test_shuffles_of_a_build_and_a_search_are_freed(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(lexical, "free_shuffles", freed.append)
    index = lexical.build_index(spark.createDataFrame(DOCS, "chunk_id string, text string"))
    assert len(freed) == 1
    lexical.search(index, lexical.query_terms(spark.createDataFrame([("q", "cat")], "query_id string, query string")), 2)
    assert len(freed) == 2
