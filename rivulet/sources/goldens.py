"""Golden sets as JSON (one array) or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the golden sets.
QA = "question string, answer string, relevant_chunks array<string>, source string"
RETRIEVAL = "id string, query string, relevant_chunk_ids array<string>"
MULTIMODAL = QA + ", modality string"


def read_json(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of a JSON array; elements that are no objects are left out."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "array<string>")).alias("v")).where(F.trim("v").startswith("{"))
    return each.select(F.from_json("v", fields).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of JSON lines; blank lines, and those that are no objects, are left out."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", fields).alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def modality_rows(rows: DataFrame) -> DataFrame:
    """The rows of tables and figures."""
    return rows.where(F.col("modality").isin("table", "figure"))
