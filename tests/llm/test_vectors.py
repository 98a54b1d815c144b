import numpy as np

from rivulet.llm import vectors


def clustered(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))
    x[1], x[3] = 2.5 * x[0], x[2]  # scaled, and equal
    return x.astype(np.float32)


def frame(spark, x):
    rows = [(f"{i:04}", v.tolist()) for i, v in enumerate(x)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * x.shape[1]), ("nan", [float("nan")] * x.shape[1]), ("inf", [float("inf")] + [0.0] * (x.shape[1] - 1)), (None, x[0].tolist()), rows[5]]
    return spark.createDataFrame(rows + bad, "id string, v array<float>")


def brute(x, k):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    return {i: [j for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j)) if j != i][:k] for i in range(len(x))}, s


def test_recall_and_mutual_pairs(spark):
    x = clustered()
    index = vectors.VectorIndex(vectors.usable(frame(spark, x), "id", "v", 16), 16, k=5)
    want, s = brute(x, 5)
    got = {}
    for r in index.search(probes=8).collect():
        got.setdefault(int(r.id_a), set()).add(int(r.id_b))
    assert len(got) == len(x)
    assert sum(len(got[i] & set(want[i])) for i in got) / (5 * len(x)) >= 0.9
    pairs = {(int(r.id_a), int(r.id_b)) for r in vectors.mutual(index.search(probes=4, at_least=0.97), 0.97).collect()}
    true = {(a, b) for a in want for b in want[a] if a < b and a in want[b] and s[a, b] >= 0.97}
    assert len(true & pairs) >= 0.95 * len(true) and {(0, 1), (2, 3)} <= pairs
    asked = spark.createDataFrame([("0002",), ("nobody",)], "id string")
    assert {r.id_a for r in index.search(asked, probes=4).collect()} == {"0002"}


def test_many_equal_vectors_and_empty(spark):
    rows = [(f"{i:03}", [1.0, 2.0, 3.0, 4.0]) for i in range(50)] + [("other", [4.0, -3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    index = vectors.VectorIndex(vectors.usable(df, "id", "v", 4), 4, k=3)
    got = {}
    for r in index.search(probes=4).collect():
        got.setdefault(r.id_a, []).append((r["rank"], r.id_b))
    assert [b for _, b in sorted(got["040"])] == ["000", "001", "002"] and [b for _, b in sorted(got["001"])] == ["000", "002", "003"]
    none = vectors.VectorIndex(vectors.usable(df.limit(0), "id", "v", 4), 4)
    assert none.search().count() == 0


def test_topk_recall_on_the_smallest_table(spark):
    from rivulet.llm import queries
    from rivulet.sources.tables import table

    sf_dir = "/root/testdata/sf0.001"
    rows = vectors.usable(table(spark, sf_dir, "chunks").select("id", "embedding"), "id", "embedding", 64).collect()
    x = vectors._unit(np.array([r.v for r in rows], np.float32)).astype(np.float64)
    s = np.round(x @ x.T, 5)
    np.fill_diagonal(s, -2)
    least = {r.id: np.sort(row)[-10] for r, row in zip(rows, s)}
    found = queries.p5_topk(spark, sf_dir).collect()
    assert sum(r.similarity >= least[r.id_a] - 2e-5 for r in found) >= 0.9 * 10 * len(rows)


def test_beam_search_beats_greedy():
    x = vectors._unit(clustered(400))
    codec = vectors.train(x, 4, codebooks=3, words=32)
    r = x - codec.centroids[codec.lists(x, 1)[:, 0]]
    error = lambda beam: ((r - codec.decode(codec.encode(r, beam))) ** 2).sum(1).mean()
    assert error(8) <= error(1)
