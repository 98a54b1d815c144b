import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import mixing, packing, tokens


def optimum(sizes, capacity):
    best = len(sizes)
    for assign in itertools.product(range(len(sizes)), repeat=len(sizes)):
        loads = {}
        for s, c in zip(sizes, assign):
            loads[c] = loads.get(c, 0) + s
        if all(v <= capacity for v in loads.values()):
            best = min(best, len(loads))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=5))
def test_bound_is_valid_and_packing_fits(sizes):
    x = np.array(sizes, np.int64)
    container = packing.best_fit_decreasing(x, 20)
    assert all(x[container == c].sum() <= 20 for c in set(container.tolist()))
    assert packing.lower_bound(x, 20) <= optimum(sizes, 20) <= len(set(container.tolist()))


def test_bound_beats_the_volume():
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3 and packing.lower_bound(np.array([7] * 6), 20) == 3


def test_pack_holds_every_item_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 300, 500))] + [(900, 1050), (901, 200), (902, None)]
    sized = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    items = packing.items_of(sized, "doc_id", 100)
    packed = packing.pack(items, 100, partition_items=80)
    got = packed.collect()
    assert sorted((r.doc, r.piece, r["size"]) for r in got) == sorted((r.doc, r.piece, r["size"]) for r in items.collect())
    loads = {}
    for r in got:
        loads.setdefault(r.container, []).append(r["size"])
    assert max(map(sum, loads.values())) <= 100 and all(sum(loads[r.container]) == r.used for r in got)
    assert sorted(r["size"] for r in got if r.doc == "900") == [50] + [100] * 10
    assert len(loads) <= 1.03 * packing.lower_bound(np.array([r["size"] for r in got]), 100)
    assert packing.pack(items.limit(0), 100).count() == 0


def test_mix_meets_shares_and_caps(spark):
    rng = np.random.default_rng(1)
    docs = [(i, ("A", " a", "b", "c")[i % 4] if i % 10 else "small", int(rng.integers(1, 30))) for i in range(4000)] + [(5000, None, 9), (5001, "a", 0), (5002, "other", 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    aims = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df.union(df.limit(3)), aims)
    rows = mixed.collect()
    assert len({(r.doc_id, r.use_no) for r in rows}) == len(rows)
    most = {"a": 1, "b": 2, "c": 1, "small": 3}
    assert all(r.use_no <= most[r.source] for r in rows)
    shares = {r.source: r for r in mixing.shares(mixed, aims).collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in shares.values())
    tight = mixing.mix(df, aims, budget=500)
    total = sum(r.n_tokens for r in tight.collect())
    assert 500 - 120 <= total <= 500
    assert mixing.mix(df.limit(0), aims).count() == 0


def test_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(i % 2, i // 7, i, i) for i in range(50)], "g int, range bigint, k int, v bigint")
    got = {r.k: r.s for r in mixing.running_sum(df, ["g"], ["k"], "v", "s").collect()}
    assert all(got[i] == sum(j for j in range(i + 1) if j % 2 == i % 2) for i in range(50))


def test_token_counts(spark):
    assert tokens.count_tokens(["", None, "hello world", "<|endoftext|>"])[:3] == [0, None, 2]
    assert tokens.count_tokens(["<|endoftext|>"])[0] > 1
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.sized(df, ["doc_id"], "text").collect()} == {1: 2, 3: 0}
