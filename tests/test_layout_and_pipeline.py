import uuid

from pyspark.sql import functions as F

from rivulet.operators import chunking, evals, fusion, layout, maintenance, pipeline, sweep
from rivulet.sources import goldens
from rivulet.streaming.ingest import Catalogue, ingest_stream


def test_uuid5_is_the_standard_one(spark):
    names = ["a:table-1", "", "ü/漢字:x", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(layout.uuid5(layout.TABLE_SPACE, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(layout.TABLE_SPACE), n)) for n in names]


def test_layout_chunks(spark):
    content = "x\n| a | b |\n|---|:-:|\n| 1 | 2 |\ny\n\n| c |\n|---|\n| 3 |\n"
    docs = spark.createDataFrame([("d", "s.pdf", content, [("table-2", None), ("table-9", None), ("t", " own "), (None, "x"), ("", "x")], [("f1", " cap ", None), ("f2", None, "p"), (None, "x", "y")]), ("e", "s", None, None, None)], "document_id string, source string, content string, tables array<struct<table_id:string,text:string>>, figures array<struct<figure_id:string,caption:string,asset_path:string>>")
    assert {(r.table_id, r.text) for r in layout.table_chunks(docs).collect()} == {("table-2", "| c |\n|---|\n| 3 |"), ("t", "own")}
    assert [(r.figure_id, r.text) for r in layout.caption_chunks(docs).collect()] == [("f1", "cap")]
    assert [(r.figure_id, r.text) for r in layout.figure_chunks(docs).collect()] == [("f2", "[figure]")]


def test_sections_by_the_best_boundaries():
    assert chunking.sections("pre\n# A\n```\n# no\n```\n## B\n") == [(None, "pre"), ("A", "# A\n```\n# no\n```"), ("B", "## B")]
    assert chunking.sections("ignored", slides=[{"title": None, "text": "First\nx"}, {"title": "T", "text": " "}, {"title": " T2 ", "text": "y"}]) == [("First", "First\nx"), ("T2", "y")]
    deck = "One\na\n\n---\n\nTwo\nb"
    assert chunking.sections(deck, deck=True) == [("One", "One\na"), ("Two", "Two\nb")] and chunking.sections(deck) == [(None, deck)]
    assert chunking.sections("lead\nIntro\nx\nEnd\ny", outline=["Intro", "Gone", "End"]) == [(None, "lead"), ("Intro", "Intro\nx"), ("End", "End\ny")]
    assert chunking.sections("  ") == []


def test_pages_and_semantic_chunks(spark):
    docs = spark.createDataFrame([("a", "p1\fp2", None), ("b", "whole", ["x", "", None, "y"]), ("c", "plain", None), ("n", None, None)], "document_id string, text string, pages array<string>")
    rows = [(r.document_id, r.chunk_index, r.section, r.text) for r in chunking.chunk_documents(docs, "page").collect()]
    assert sorted(rows, key=str) == [("a", 0, "1", "p1"), ("a", 1, "2", "p2"), ("b", 0, "1", "x"), ("b", 1, "4", "y"), ("c", 0, None, "plain")]
    vector = {"Cats purr.": [1.0, 0.0], "Cats sleep.": [0.9, 0.1], "Stocks fell.": [0.0, 1.0]}
    assert chunking.semantic_split(" ".join(vector), vector.get, 500) == ["Cats purr. Cats sleep.", "Stocks fell."]


def test_quantiles_equal_percentile(spark):
    rows = [("a", float(x)) for x in (3, 1, 1, 2, 9, 9, 50)] + [("b", 4.0), ("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95) for r in evals.quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {r.g: (r.n, r.p50, r.p95) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95")).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for g in got for x, y in zip(got[g], want[g]))


def test_greedy_keep_on_a_chain(spark):
    keys = spark.createDataFrame([(i,) for i in range(1, 8)], "key int")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a int, b int")
    assert sorted(r.key for r in sweep.greedy_keep(keys, pairs).collect()) == [1, 3, 5, 7]
    assert sweep.greedy_keep(keys, pairs.limit(0)).count() == 7
    sets = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d", "e"]), (3, ["x"]), (4, []), (5, ["a", "z"])], "key int, words array<string>")
    assert [tuple(r) for r in sweep.similar_sets(sets, 0.8).collect()] == [(1, 2)]


def test_merged_views_and_maintenance(spark):
    one = spark.createDataFrame([("q", "a", 1, None), ("q", "b", 2, "x")], "query_id string, chunk_id string, rank int, note string")
    two = spark.createDataFrame([("q", "a", 9, "late"), ("q", "c", 1, None)], "query_id string, chunk_id string, rank int, note string")
    got = {r.chunk_id: (r.leg, r.n_legs, r["rank"], r.note) for r in fusion.merged_views({"x": one, "y": two}).collect()}
    assert got == {"a": ("x", 2, 1, "late"), "b": ("x", 1, 2, "x"), "c": ("y", 1, 1, None)}
    values = spark.createDataFrame([("true",), ("1.5",), ("x",), (None,)], "v string").select(maintenance.feedback_value(F.col("v"))).collect()
    assert [r[0] for r in values] == [0.0, 1.5, 0.0, 0.0]
    paths = spark.createDataFrame([("/chat",), ("/chat/x",), ("/chatter",), ("/chat/open",)], "p string")
    assert [r[0] for r in paths.select(maintenance.protected(F.col("p"), F.lit("POST"), ["/chat"], ["/chat/open"])).collect()] == [True, True, False, False]


def test_pipeline_leaves_out_absent_legs(spark):
    chunks = spark.createDataFrame([("p", "d", 0, "parent", None, "whole"), ("a", "d", 1, "child", "p", "aa"), ("b", "d", 2, "child", "p", "bb"), ("c", "e", 0, None, None, "cc")], "chunk_id string, document_id string, chunk_index int, chunk_type string, parent_id string, text string")
    leg = spark.createDataFrame([("q", "a", 1), ("q", "p", 2), ("q", "c", 3)], "query_id string, chunk_id string, rank int")
    got = [(r["rank"], r.chunk_id, r.context) for r in pipeline.retrieve({"lexical": leg, "dense": None}, chunks, pipeline.Config()).orderBy("rank").collect()]
    assert got == [(1, "a", "whole"), (2, "c", "cc")]


def test_goldens_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": "q", "answer": "a", "relevant_chunks": ["c"], "source": "s"}, 3, "x", {"question": "r"}]')
    rows = goldens.read_json(spark, str(tmp_path / "a.json"), goldens.QA)
    assert [r.question for r in rows.collect()] == ["q", "r"]
    goldens.write_jsonl(rows, str(tmp_path / "b"))
    with open(tmp_path / "b" / "extra.json", "w") as f:
        f.write("\n\n[1]\nnot json\n")
    assert sorted(r.question for r in goldens.read_jsonl(spark, str(tmp_path / "b"), goldens.QA).collect()) == ["q", "r"]


def test_stream_of_documents(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/catalogue"
    schema = "document_id string, source_path string, text string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    catalogue = Catalogue(spark, folder)
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(source), catalogue, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    add([("1", "a", "red fox"), ("2", "b", "blue whale")])
    run()
    add([("3", "a", "green fox"), ("4", "b", "blue whale"), ("5", "c", "new text")])
    run()
    assert sorted((r.document_id, r.text) for r in catalogue.chunks().collect()) == [("2", "blue whale"), ("3", "green fox"), ("5", "new text")]
    assert {r.term for r in catalogue.index().term_stats.collect()} == {"blue", "whale", "green", "fox", "new", "text"}
    assert sorted((r.batch, r.document_id, r.status) for r in catalogue.runs().collect()) == [(0, "1", "new"), (0, "2", "new"), (1, "3", "changed"), (1, "4", "unchanged"), (1, "5", "new")]
    catalogue.apply(spark.createDataFrame([("9", "z", "again")], schema), 1)
    assert catalogue.chunks().count() == 3
