"""Spark against DuckDB on the smallest tables, for a query of each plan."""

import duckdb
import pytest

from rivulet.plans import registry
from rivulet.sources.tables import TABLES

D = "/root/testdata/sf0.001"
NAMES = ["p4_found", "p4_report", "bm25_topk", "dense_topk", "rrf_two_leg", "linear_fusion", "passage_groups", "graph_hits", "retrieval_metrics", "gate_status", "ingest_status", "superseded_purge", "daily_events", "sessions", "chunk_overlaps"]


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = registry.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    relation = connection.sql(registry.ORACLE[name])
    assert columns == sorted(relation.columns)
    spark_rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert spark_rows == sorted(map(repr, relation.select(*[f'"{c}"' for c in columns]).fetchall()))
