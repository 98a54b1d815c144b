import shutil

import numpy as np

from rivulet.llm import history
from rivulet.llm.text import word_hashes


def test_batches_against_history(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(word, 200)) for _ in range(6)]
    edited = base[0].split()
    edited[50] = edited[120] = "changed"
    half = " ".join(base[1].split()[:100] + base[2].split()[:100])
    path = "file:///Data%20A/x/../y.txt"
    rows = [
        (1, 0, base[0], "AB" * 8, "data a/y.txt"), (2, 0, base[1], None, None), (3, 0, base[2], "sha256: cd12", None),
        (10, 1, " ".join(edited), None, "other"), (11, 1, base[1], None, None), (12, 1, half, None, None), (13, 1, None, "CD12 ", None), (14, 1, None, None, path),
        (15, 2, base[3], None, ".\\DATA A\\\\y.txt"), (16, 2, base[3].upper(), None, None), (17, 2, "few words only here", None, None), (18, 3, "few words only here now", None, None),
        (19, 3, "", None, None), (20, 3, "", None, None), (21, None, base[4], None, None), (22, 3, base[4] + " tail", None, None), (22, 3, base[4] + " tail", None, None),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, batch_no int, text string, content_hash string, source_path string, doc int")
    want = {10: "near", 11: "exact", 13: "exact", 14: "path", 15: "path", 16: "near", 22: "near"}
    assert {r.doc: r.dup_kind for r in history.duplicates(df).collect()} == want
    # the same where one hit a substring is all that the first search returns
    monkeypatch.setattr(history, "AT_ONCE", 1)
    assert {r.doc: r.dup_kind for r in history.duplicates(df).collect()} == want
    assert history.duplicates(df.limit(0)).count() == 0


def _chosen(text):
    words, offsets = word_hashes([text])
    return set(history.chosen_suffixes((words >> np.uint64(32)).astype(np.uint32), offsets)[0])


def test_near_copy_behind_common_phrases(spark, monkeypatch):
    # every phrase that the copy shares with its original is also in six earlier records of the same size
    monkeypatch.setattr(history, "AT_ONCE", 2)
    rng = np.random.default_rng(103)
    old = [f"w{i}" for i in rng.integers(0, 5000, 100)]
    new = old[:]
    new[30], new[70] = "edit", "again"
    phrases = [old[i : i + 8] for i in range(0, 93) if _chosen(" ".join(old[i : i + 8])) & _chosen(" ".join(old))]
    rows = [(d, 0, " ".join(w for k, p in enumerate(phrases) for w in [*p[: 8 if k % 3 == d % 3 else 3], f"fill{d}x{k}"])[:700], None, None) for d in range(6)]
    rows += [(10, 0, " ".join(old), None, None), (20, 1, " ".join(new), None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, batch_no int, text string, content_hash string, source_path string")
    assert {r.doc: r.dup_kind for r in history.duplicates(df).collect()} == {20: "near"}


def test_hot_group_of_edited_copies(spark):
    rng = np.random.default_rng(6)
    word = [f"w{i}" for i in range(300)]
    base = list(rng.choice(word, 150))
    rows = [(i, int(i >= 40), " ".join(base[: i % 140] + [f"edit{i}"] + base[i % 140 + 1 :]), None, None) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, batch_no int, text string, content_hash string, source_path string")
    assert {r.doc for r in history.duplicates(df).collect()} == set(range(40, 80))


def test_store_is_kept_and_reads_no_old_text(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 4000, n))
    schema = "doc bigint, text string, hash string, path string"
    olds, folder = [text(90) for _ in range(5)], f"file://{tmp_path}/store"
    for n, old in enumerate(olds):
        source = f"{tmp_path}/in{n}"
        spark.createDataFrame([(n, old, f"{n:x}a", f"/d/{n}")], schema).write.parquet(source)
        store = history.SuffixStore(spark, folder) if n == 0 else history.SuffixStore.load(spark, folder)
        assert store.add(spark.read.parquet(source)).count() == 0
        shutil.rmtree(source)  # what was accepted is never read again
    assert len(store.segments) <= 2 and store.version == 5
    store = history.SuffixStore.load(spark, folder)
    batch = [(100, olds[0] + " tail", None, None), (101, olds[4].upper(), None, None), (102, None, "0X4A", None), (103, text(90), None, "/e/3"), (104, None, None, "/D/./3"), (105, text(90), None, None)]
    assert {r.doc: r.dup_kind for r in store.add(spark.createDataFrame(batch, schema)).collect()} == {100: "near", 101: "near", 102: "exact", 104: "path"}


def test_intervals_by_words_and_size():
    order = lambda rows: {c: np.array(v, np.int64) for c, v in zip(("key", "n_runs", "doc", "words"), zip(*rows))}
    held = order([(5, 90, 1, 4), (5, 100, 2, 4), (5, 300, 3, 4), (7, 100, 4, 4)])
    start, stop = history.matches(order([(5, 100, 9, 4), (6, 100, 9, 4), (7, 10, 9, 4)]), held, 0.7)
    assert [(a, b) for a, b in zip(start, stop) if b > a] == [(0, 2)]


def test_every_long_match_shares_a_chosen_suffix():
    rng = np.random.default_rng(7)
    for _ in range(20):
        shared = [f"s{i}" for i in rng.integers(0, 50, history.DEPTH + history.WINDOW - 1)]
        a = [f"a{i}" for i in rng.integers(0, 99, 150)] + shared + [f"b{i}" for i in rng.integers(0, 99, 150)]
        b = [f"c{i}" for i in rng.integers(0, 99, 170)] + shared + [f"d{i}" for i in rng.integers(0, 99, 130)]
        assert _chosen(" ".join(a)) & _chosen(" ".join(b))
