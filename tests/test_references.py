from datetime import datetime as dt

from rivulet.operators.references import failing_references, orphan_report, references


def frames(spark):
    links = spark.createDataFrame(
        [("d", " A ", dt(2025, 1, 2)), ("d", " A ", dt(2025, 1, 2)), ("d", "late", dt(2025, 1, 1)), ("e", "gone", dt(2025, 3, 1)), ("e", None, dt(2025, 1, 1)), ("e", "", dt(2025, 1, 1)), ("f", "x", None)],
        "document_id string, chunk_id string, linked_at timestamp",
    )
    pairs = spark.createDataFrame([(1, ["a", None, "GONE"], dt(2025, 2, 1)), (2, None, dt(2025, 2, 1)), (3, [], dt(2025, 2, 1))], "qa_id bigint, rel array<string>, created_at timestamp")
    parents = spark.createDataFrame(
        [("a", dt(2025, 1, 1), None, 1), ("a", dt(2025, 1, 1), None, 1), ("LATE", dt(2025, 1, 5), None, 1), ("gone", dt(2025, 1, 1), dt(2025, 3, 1), 1), (None, dt(2025, 1, 1), None, 1)],
        "id string, created_at timestamp, deleted_at timestamp, chunk_id int",  # a clashing extra column
    )
    return [references(links, "links", "document_id", "chunk_id", "linked_at"), references(pairs, "pairs", "qa_id", "rel", "created_at")], parents


def test_each_reason(spark):
    refs, parents = frames(spark)
    got = {(r.ref_table, r.ref_key, r.chunk_id, r.reason, r.ref_month) for r in failing_references(refs, parents).collect()}
    assert got == {("links", "d", "late", "late", "2025-01"), ("links", "e", "gone", "deleted", "2025-03"), ("links", "e", "", "missing", "2025-01"), ("links", "f", "x", "missing", None)}


def test_report_and_empty_tables(spark):
    refs, parents = frames(spark)
    rows = {(r.ref_table, r.ref_month): (r.n_refs, r.n_missing, r.n_late, r.n_deleted) for r in orphan_report(refs, parents).collect()}
    assert rows[("links", "2025-01")] == (3, 1, 1, 0) and rows[("pairs", "2025-02")] == (2, 0, 0, 0) and rows[("links", None)] == (1, 1, 0, 0)
    assert failing_references([r.limit(0) for r in refs], parents).count() == 0
    assert {r.reason for r in failing_references(refs, parents.limit(0)).collect()} == {"missing"}
