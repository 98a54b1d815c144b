from pyspark.sql import functions as F

from rivulet.functions import text as T
from rivulet.functions.vectors import cosine, sparse, unit
from rivulet.operators import evals, ingest, quality
from rivulet.streaming import limiter


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, T.tokenize(F.col("t")), t=" One TWO three\n") == ["one", "two", "three"]
    assert one(spark, T.tokenize(F.col("t")), t=None) is None
    assert one(spark, T.token_estimate(F.col("t")), t="") == 1
    assert one(spark, T.truncate_sentence(F.col("t"), 3), t="One. Two three four") == "One."
    assert one(spark, T.truncate_sentence(F.col("t"), 3), t="no stop in here") == "no stop in h"
    assert one(spark, T.strip_list_prefix(F.col("t")), t="12) item") == "item"
    assert one(spark, T.entity_names(F.col("t")), t="Ask Bob, not A. Émile or bob") == ["Ask", "Bob", "Émile"]
    assert one(spark, T.overlap_length(F.col("a"), F.col("b")), a="xxabc", b="abcyy") == 3
    assert one(spark, T.overlap_length(F.col("a"), F.col("b")), a="", b="abc") == 0
    assert one(spark, T.context_header(F.col("a"), F.col("b"), F.col("b")), a="f.md", b=None) == "[Document: f.md | Section: — | Page: —]"
    assert one(spark, T.json_rescue(F.col("t"), "array<int>"), t="Sure: [1, 2] ok") == [1, 2]
    assert one(spark, T.json_rescue(F.col("t"), "k int"), t="no json") is None
    assert one(spark, T.stem(F.col("t")), t="a\\b/c.tar.gz") == "c.tar"


def test_vectors(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[0.0, 0.0]) == 0
    assert round(one(spark, cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[3.0, 4.0]), 9) == 1
    assert one(spark, unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, sparse(F.col("a"), 0.5), a=[0.1, 0.9, 0.6]) == {1: 0.9, 2: 0.6}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, chunk_id string, rank bigint")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("none", "a"), ("q", "b")], "query_id string, chunk_id string")
    got = {r.query_id: (r.recall, r.precision, r.mrr) for r in evals.retrieval_metrics(ranked, rel, 2).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "none": (0.0, 0.0, 0.0)}
    assert evals.means(spark.createDataFrame([], "x double"), ["x"]).first()["x"] == 0.0


def test_gates_and_quality(spark):
    df = spark.createDataFrame([(0, 0, True, 1.0), (5, 0, True, 1.0), (30, 1, True, 1.0), (30, 0, False, 1.0), (30, 0, True, 0.1), (30, 0, True, 0.9)], "n int, e int, s boolean, r double")
    status = [r[0] for r in df.select(evals.gate(F.col("n"), F.col("e"), F.col("s"), F.col("r"), 20, 0.5)).collect()]
    assert status == ["SKIPPED", "FAILED: samples", "FAILED: empty rows", "FAILED: out of sync", "FAILED: recall", "PASSED"]
    scores = spark.createDataFrame([(0.9,), (0.5,), (0.1,), (None,)], "x double")
    assert [r[0] for r in scores.select(quality.corrective_action(F.col("x"), 0.3, 0.7)).collect()] == ["use", "combine", "web", "use"]


def test_ingest_joins(spark):
    cat = spark.createDataFrame([("p", "1"), ("q", "2")], "source_path string, digest string")
    new = spark.createDataFrame([("p", "1"), ("q", "3"), ("r", "4"), ("q", None)], "source_path string, digest string")
    assert sorted((r.source_path, r.status) for r in ingest.ingest_status(new, cat).collect()) == [("p", "unchanged"), ("q", "changed"), ("q", "changed"), ("r", "new")]
    links = lambda rows: spark.createDataFrame(rows, "document_id string, chunk_id string")
    old, now = links([("d", "1"), ("d", "2"), ("e", "3")]), links([("d", "2"), ("d", "9")])
    assert [tuple(r) for r in ingest.superseded(old, now).collect()] == [("d", "1")]


def test_limiter(spark):
    rows = [("a", i, float(t)) for i, t in enumerate((0, 1, 2, 61, 62))] + [("b", 9, 5.0), (None, 10, 1.0)]
    df = spark.createDataFrame(rows, "client string, request_id bigint, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.client, r.request_id): (r.allowed, r.retry_after) for r in limiter.rate_limit(df, 2).collect()}
    # the third is refused and uses up nothing, so both later ones pass
    assert got == {("a", 0): (True, 0), ("a", 1): (True, 0), ("a", 2): (False, 58), ("a", 3): (True, 0), ("a", 4): (True, 0), ("b", 9): (True, 0)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i % 3, i, f"2024-01-01 00:{i % 60:02d}:00", i % 2 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "client int, request_id bigint, t string, relevant boolean").withColumn("ts", F.to_timestamp("t")).withColumn("chunk_id", F.col("client"))
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    votes = limiter.feedback_totals(stream).writeStream.format("memory").queryName("votes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    votes.awaitTermination(120)
    assert sorted(map(tuple, spark.table("votes").collect())) == sorted(map(tuple, limiter.feedback_totals(df).collect()))
    limited = limiter.limit_stream(stream, 5).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    limited.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, limiter.rate_limit(df, 5).collect()))


def test_words_break_at_every_white_space_and_without_a_lambda(spark):
    rows = spark.createDataFrame([(i, chr(i)) for i in range(1, 65536) if not 0xD800 <= i < 0xE000], "id int, c string")
    whole = F.filter(F.split(F.lower(F.concat(F.lit("A"), "c", F.lit("b"), "c")), f"{T.SPACE}+"), lambda w: w != "")
    split = T.tokenize(F.concat(F.lit("A"), "c", F.lit("b"), "c"))
    assert rows.where(~whole.eqNullSafe(split)).count() == 0
    assert {r.id for r in rows.where(F.size(split) == 2).collect()} >= {9, 32, 0x1C, 0x85, 0xA0, 0x2028, 0x3000}
    assert "lambda" not in rows.select(split.alias("w"))._jdf.queryExecution().analyzed().toString()
