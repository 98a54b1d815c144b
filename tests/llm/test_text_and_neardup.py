import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import neardup, text


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é_.\nß漢", max_size=40), max_size=6))
def test_word_hashes_stand_for_words(texts):
    h, at = text.word_hashes(texts)
    lists = [[w for w in re.findall(r"[^\W_]+", t.lower())] for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in lists]
    flat = [w for x in lists for w in x]
    seen = {}
    for w, k in zip(flat, h.tolist()):
        assert seen.setdefault(w, k) == k
    assert len(set(seen.values())) == len(seen)


def test_shingles_do_not_cross_texts():
    h, at = text.shingle_hashes(["a b c d", "", "b c", "a b c"], 3)
    assert at.tolist() == [0, 2, 2, 2, 3] and h[0] == h[2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))
    sig = neardup.signatures(np.concatenate((a, b)), np.array([0, 400, 800]), 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12


def brute(rows, n, least):
    sets = {}
    for i, t in rows:
        w = words(t or "")
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def rows_of(seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice([f"w{i}" for i in range(400)], 60)) for _ in range(12)]
    rows = [(f"a{i}", t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[10] = "edited"
        rows.append((f"b{i}", " ".join(w)))
        if i % 3 == 0:
            rows.append((f"c{i}", t.upper() + "!"))  # the same words
            w[30] = w[45] = "more"
            rows.append((f"d{i}", " ".join(w)))
    return rows + [("null", None), ("blank", "  "), ("short", "two words"), ("long", "word " * 30000 + "end of it")]


def test_pairs_equal_brute_force(spark):
    rows = rows_of(3)
    df = spark.createDataFrame([(i, t, 1) for i, t in [*rows, rows[0]]], "id string, text string, cls int")  # a repeated row, a clashing name
    found = neardup.NearDuplicates(neardup.texts(df, "document", "id", "text"), 3, 0.7)
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == brute(rows, 3, 0.7)
    groups = {r.id: r.group_id for r in found.groups().collect()}
    for a, b in brute(rows, 3, 0.7):
        assert groups[a] == groups[b]
    assert "null" not in groups and "short" not in groups and groups["a1"] != groups["a2"]


def test_many_copies_stay_linear(spark):
    rows = [(f"{i:03}", "one same text of copies") for i in range(neardup.EXPAND + 40)] + [("zz", "one same text of copies and edits")]
    found = neardup.NearDuplicates(neardup.texts(spark.createDataFrame(rows, "id string, text string"), "document", "id", "text"), 3, 0.5)
    pairs = {(r.id_a, r.id_b) for r in found.pairs().collect()}
    assert pairs == {("000", i) for i, _ in rows[1:]}


def test_many_variants_of_one_text_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    words_of = "one notice in very many kinds of letter case".split()
    n = neardup.EXPAND + 6
    kinds = [" ".join(w.upper() if i >> k & 1 else w for k, w in enumerate(words_of)) for i in range(n)]
    rows = [(f"{i:03}", t) for i, t in enumerate(kinds)] + [("yy", kinds[3]), ("zz", kinds[0] + " again")]
    found = neardup.NearDuplicates(neardup.texts(spark.createDataFrame(rows, "id string, text string"), "document", "id", "text"), 3, 0.7)
    pairs = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, 3, 0.7)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id string, text string")
    found = neardup.NearDuplicates(neardup.texts(empty, "document", "id", "text"))
    assert found.pairs().count() == 0 and found.groups().count() == 0
