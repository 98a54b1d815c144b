"""References to records that do not exist (problem 4).

A reference is a foreign key held by some row at some time.  It fails when its parent is missing, came
later than the reference, or had been deleted by then.  The distinct non-null foreign keys are
anti-joined against the parent keys once, so a key that a third of all rows hold is looked up once;
the verdict is joined back to the distinct references.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_key(col: Column) -> Column:
    """Lower case without outer white space: the form in which ids compare."""
    return F.lower(F.regexp_replace(col.cast("string"), r"^\s+|\s+$", ""))


def references(df: DataFrame, ref_table: str, key: str, foreign: str, time: str) -> DataFrame:
    """Rows ``(ref_table, ref_key, chunk_id, ref_time)`` of one table; an array column holds one reference an element.

    Null elements and null arrays are no references; an empty string is one (it names nothing).
    Repeated rows and elements count once.
    """
    is_array = df.schema[foreign].dataType.typeName() == "array"
    held = F.explode(F.array_distinct(foreign)) if is_array else F.col(foreign)
    return (
        df.select(F.lit(ref_table).alias("ref_table"), F.col(key).cast("string").alias("ref_key"), F.col(time).alias("ref_time"), held.alias("held"))
        .where("held IS NOT NULL")
        .select("ref_table", "ref_key", clean_key(F.col("held")).alias("chunk_id"), "ref_time")
        .distinct()
    )


def failing_references(refs: list[DataFrame], parents: DataFrame, key: str = "id", created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """``(ref_table, ref_key, chunk_id, reason, ref_month)`` of every reference that fails at its own time.

    ``reason``: 'missing' when no parent has the key, 'late' when the parent was created after the
    reference, 'deleted' when it was deleted at or before it.  A reference without a time can only be
    missing, with a null month.  A parent written several times exists from its first creation until
    its last copy is deleted.  Empty parents make every reference missing; empty references give no row.
    """
    all_refs = reduce(DataFrame.unionByName, refs)
    keys = parents.select(clean_key(F.col(key)).alias("chunk_id"), F.col(created).alias("_born"), F.col(deleted).alias("_gone")).where("chunk_id IS NOT NULL")
    alive = keys.groupBy("chunk_id").agg(
        F.min("_born").alias("_born"),
        F.when(F.bool_or(F.col("_gone").isNull()), F.lit(None)).otherwise(F.max("_gone")).alias("_gone"),
    )
    wanted = all_refs.select("chunk_id").distinct()
    missing = wanted.join(alive, "chunk_id", "left_anti").select("chunk_id", F.lit(True).alias("_none"), F.lit(None).cast(alive.schema["_born"].dataType).alias("_born"), F.lit(None).cast(alive.schema["_gone"].dataType).alias("_gone"))
    present = wanted.join(alive, "chunk_id").select("chunk_id", F.lit(False).alias("_none"), "_born", "_gone")
    reason = (
        F.when(F.col("_none"), "missing")
        .when(F.col("_born") > F.col("ref_time"), "late")
        .when(F.col("_gone") <= F.col("ref_time"), "deleted")
    )
    return (
        all_refs.join(missing.unionByName(present), "chunk_id")
        .select("ref_table", "ref_key", "chunk_id", reason.alias("reason"), F.date_format("ref_time", "yyyy-MM").alias("ref_month"))
        .where("reason IS NOT NULL")
        .distinct()
    )


def orphan_report(refs: list[DataFrame], parents: DataFrame) -> DataFrame:
    """Counts per table and month: references, failing ones by reason, and the share that fails."""
    held = reduce(DataFrame.unionByName, refs).groupBy("ref_table", F.date_format("ref_time", "yyyy-MM").alias("ref_month")).agg(F.count("*").alias("n_refs"))
    bad = failing_references(refs, parents).groupBy("ref_table", "ref_month").agg(
        F.count_if(F.col("reason") == "missing").alias("n_missing"),
        F.count_if(F.col("reason") == "late").alias("n_late"),
        F.count_if(F.col("reason") == "deleted").alias("n_deleted"),
    )
    same = held["ref_table"].eqNullSafe(bad["ref_table"]) & held["ref_month"].eqNullSafe(bad["ref_month"])
    counts = [F.coalesce(bad[c], F.lit(0)).alias(c) for c in ("n_missing", "n_late", "n_deleted")]
    failing = sum((F.coalesce(bad[c], F.lit(0)) for c in ("n_late", "n_deleted")), F.coalesce(bad["n_missing"], F.lit(0)))
    return held.join(bad, same, "left").select(held["ref_table"], held["ref_month"], held["n_refs"], *counts, F.round(failing / held["n_refs"], 6).alias("fail_share"))
