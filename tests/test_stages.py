from pyspark.sql import functions as F

from rivulet.functions import answers as A
from rivulet.operators import judged, stages


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_json_within_prose(spark):
    assert one(spark, 'Sure: ["a ", "", "b"] and [1]', A.string_list) == ["a", "b"]
    assert one(spark, "nothing", A.string_list) is None
    assert one(spark, '[{"subject": "a", "relation": "r", "object": "b"}, {"subject": "a"}]', A.triples)[0].subject_type == "Entity"
    assert one(spark, "oops", A.triples) == [] and one(spark, None, A.triples) == []
    assert one(spark, 'x {"action": "clarify"} y', A.decision).action == "CLARIFY"
    assert one(spark, '{"action": "dance", "refined_query": "q"}', A.decision) == ("ANSWER", "", [])
    assert one(spark, '{"accuracy": "8", "clarity": 9.0, "completeness": 7, "conciseness": 7.5}', A.grades) is None
    assert one(spark, '{"accuracy": "8", "clarity": 9.0, "completeness": 7, "conciseness": 10}', A.grades).accuracy == 8


def test_verbatim_spans(spark):
    rows = [("a  b.c", "x a\nb.c y", "a\nb.c"), (" same ", "the same", "same"), ("a b", "ab", None), ("", "x", None), (r"1 \E 2", "1  \\E  2", "1  \\E  2"), ("a.b c", "axb c", None)]
    df = spark.createDataFrame(rows, "span string, passage string, want string")
    assert all(r.got == r.want for r in df.select("want", A.verbatim(F.col("span"), F.col("passage")).alias("got")).collect())


def test_small_text_functions(spark):
    assert one(spark, "a $b", A.escape_dollar) == "a $$b"
    assert one(spark, "redis://u:p@host:1/0", A.redact_url) == "redis://***@host:1/0"
    assert one(spark, " A  b\nC ", A.proposition_key) == "a b c"
    rows = spark.createDataFrame([([("c1", "x"), ("c2", "y")],)], "r array<struct<chunk_id:string,text:string>>")
    assert rows.select(A.passages(F.col("r"))).first()[0] == "[1] chunk_id=c1\nx\n\n[2] chunk_id=c2\ny"


def test_judged_metrics_guard(spark):
    rows = [(1, "q", "a", ["p"], False, '{"claims": [{"claim": "x", "supported": true}, {"claim": "y", "supported": false}]}'), (2, "q", "", ["p"], False, "{}"), (3, "q", "a", ["p"], True, None), (4, "q", "a", None, False, None), (5, "q", "a", ["p"], False, '{"claims": []}'), (6, "q", None, ["p"], False, None)]
    df = spark.createDataFrame(rows, "id int, question string, answer string, passages array<string>, parametric boolean, response string")
    assert [r[0] for r in df.orderBy("id").select(judged.faithfulness(F.col("response"))).collect()] == [0.5, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert [r[0] for r in df.orderBy("id").select(judged.hallucination(F.lit(None).cast("double"))).collect()] == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_remapped_goldens(spark):
    chunks = spark.createDataFrame([("c1", "The pump opens at NOON today."), ("c2", "noonday heat"), ("c3", None), ("c4", "a — b")], "chunk_id string, text string")
    goldens = spark.createDataFrame([(1, ["c9", "c2", None], "x"), (2, ["gone"], "noon"), (3, None, "pump opens at noon"), (4, [], " "), (5, None, None), (6, None, "—"), (7, None, "not there at all")], "row_id int, ids array<string>, answer string")
    assert sorted(map(tuple, judged.remap_goldens(goldens, chunks).collect())) == [(1, "c2"), (2, "c1"), (2, "c2"), (3, "c1"), (6, "c4")]


def test_remapping_gives_no_row_per_candidate(monkeypatch, spark):
    chunks = spark.createDataFrame([(f"c{i}", f"on day {i} of 3.{i} hours no. {i} the Crew waits_here") for i in range(60)] + [("c7", "another text of c7: hours no. 7 the")], "chunk_id string, text string")
    answers = ["3.5", "hours no. 7 the", "No.", "aits_he", ".", "day 5", "of 3.5 h", "_", "ay", "w 1", "Crew"]
    goldens = spark.createDataFrame([(i, ["gone"], a) for i, a in enumerate(answers)] + [(2, None, "day 3 of"), (20, None, "No.")], "row_id int, ids array<string>, answer string")
    texts = [(r.chunk_id, r.text.lower()) for r in chunks.collect()]
    want = {(g.row_id, c) for g in goldens.collect() for c, t in texts if g.answer.lower() in t}
    given = []
    monkeypatch.setattr(judged, "materialize", lambda df, name, write=judged.materialize: given.append(name) or write(df, name))
    out = judged.remap_goldens(goldens, chunks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(want) and "word" not in plan and given == ["texts", "there", "asked"]
    assert judged.holding([["a b c"], ["zz"], ["b", "."]], ["x a b c", "a. b", "zzz"]) == [[0], [2], [0, 1]]


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([("a", "x", 1, 0.1), ("a", "y", 2, 0.9), ("b", "x", 1, 0.1), ("b", "y", 2, None)], "query_id string, chunk_id string, rank int, rescore double")
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in stages.reranked(hits, 2).collect()) == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, "y")]


def test_fused_hits_are_written_once(monkeypatch, spark):
    from rivulet.plans import stages as plans

    written = []
    monkeypatch.setattr(plans, "materialize", lambda df, name, write=plans.materialize: written.append(name) or write(df, name))
    assert plans.technique_matrix(spark, "/root/testdata/sf0.001").count() == 5 and written == ["fused"]
