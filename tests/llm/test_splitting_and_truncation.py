import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rivulet.llm import splitting, truncation


def cut(spark, texts, capacity, overlap):
    df = spark.createDataFrame([(str(i), t, 9) for i, t in enumerate(texts)], "id string, text string, piece int")  # a clashing name
    out = {}
    for r in splitting.split_oversized(df, "text", capacity, overlap, ["id"]).orderBy("id", "piece_no").collect():
        out.setdefault(r.id, []).append(r.piece)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab .!\n😀", max_size=200), min_size=1, max_size=5), overlap=st.integers(0, 7))
def test_pieces_tile_the_text(spark, texts, overlap):
    capacity = 20
    got = cut(spark, texts, capacity, overlap)
    for i, t in enumerate(texts):
        pieces = got.get(str(i), [])
        assert bool(pieces) == bool(t)
        assert all(0 < len(p) <= capacity for p in pieces)
        if len(t) <= capacity:
            assert pieces == ([t] if t else [])
            continue
        whole = pieces[0]
        for p in pieces[1:]:
            shared = min(overlap, len(whole))
            assert whole.endswith(p[:shared])
            whole += p[shared:]
        assert whole == t


def test_cuts_at_the_strongest_boundary(spark):
    got = cut(spark, ["aaaa bbb. cc\n\ndddd eeee", None, "x" * 45], 16, 0)
    assert got["0"] == ["aaaa bbb. cc\n\n", "dddd eeee"] and [len(p) for p in got["2"]] == [16, 16, 13] and "1" not in got
    with pytest.raises(ValueError):
        splitting.piece_pattern(10, 10)


def test_boundary_of_an_item(spark):
    texts = {"paragraph": "a" * 9 + "\n\n" + "b" * 9, "line": "a" * 9 + "\n" + "b" * 9, "sentence": "aaaaaaa. bbbbbbbb", "word": "aaaaaaaa bbbbbbbbb", "none": "a" * 30}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] + [("fits", "abc"), ("null", None)], "id string, text string")
    got = {r.item_id: r.boundary for r in splitting.oversized_items(df.union(df), "document", "id", "text", 10).collect()}
    assert got == {k: k for k in texts}


def test_very_long_text(spark):
    text = "word " * 200_000
    pieces = cut(spark, [text], 2000, 200)["0"]
    assert max(map(len, pieces)) <= 2000 and sum(map(len, pieces)) - 200 * (len(pieces) - 1) == len(text)


OPEN = ["It began well. The list was cut in the mid", "First part. Then the schedule…", "One more. It went on and on...", "Done here. But the last wo\n\n- 4 -", "| a | b |\n| c", '{"a":1,"b', "All good. Broken �", "```\ncode = 1", "He said so. The team\n\nOwner: Blue Team"]
CLOSED = ["A sentence.", "A list:\n- one\n- two", "| a | b |\n| c | d |", '{"a":1}', "Text.\n\nMore to follow...", "Text.\n\nSee also: AB-12345", "```\ncode = 1\n```", "Dear all.\n\n-- \nBlue Team", "", "  ", "Text.\n\nApplies to Blue 3.1.4", "2025-01-01 10:00:00 INFO done id=3", "Fin.\nPage 7", "no punctuation at all in this text", '"Quoted."']


def test_open_ends(spark):
    df = spark.createDataFrame([(t,) for t in OPEN + CLOSED], "t string")
    got = [r[0] for r in df.select(truncation.open_end(df.t)).collect()]
    assert [t for t, g in zip(OPEN, got) if not g] == [] and [t for t, g in zip(CLOSED, got[len(OPEN) :]) if g] == []


def test_spikes_at_a_field_limit(spark):
    rows = [(i, "Src " if i % 2 else "src", f"- item {i:04d} " + "lorem ipsum dolor "[: 5] * 30) for i in range(40)]
    cut_rows = [(i, s, t[:100]) for i, s, t in rows]
    full = [(100 + i, "src", f"{'x' * (i * 7 % 180)} Complete sentence {i}.") for i in range(60)]
    ends = [(300, "src", ("y " * 60)[:99] + "."), (301, None, None), (302, None, "Fine."), (302, None, "Fine.")]
    df = spark.createDataFrame(cut_rows + full + ends, "doc_id bigint, source string, text string")
    got = {r.key: r.at_limit for r in truncation.truncated(df, "doc_id", "source", "text").collect()}
    assert all(got.get(i) for i in range(40)) and not set(got) & {300, 301, 302}
    report = {r.source: (r.n_records, r.n_cut) for r in truncation.truncation_report(df, "doc_id", "source", "text").collect()}
    assert report[""] == (1, 0) and report["src"][1] >= 40
    assert truncation.truncated(df.limit(0), "doc_id", "source", "text").count() == 0


def test_boundary_regex_is_bounded():
    assert not re.search(r"[*+](?!\?)[^)]*[*+]", splitting.piece_pattern(2000, 200).replace("\\s", ""))
