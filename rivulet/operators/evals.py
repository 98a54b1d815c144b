"""Retrieval metrics, gates and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that running counts are summed up over.
RANGES = 256


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall, precision, ndcg, mrr)`` at k of every query in ``relevant`` (query_id, chunk_id).

    Precision is over k even where fewer were retrieved; a query without hits scores 0; relevant ids count once.
    """
    rel = relevant.distinct()
    size = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.where(F.col("rank") <= k).join(rel, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.count_distinct("chunk_id").alias("found"), F.count("*").alias("rows"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return size.join(hits, "query_id", "left").select(
        "query_id", F.round(zero(F.col("found") / F.col("n_rel")), 6).alias("recall"), F.round(zero(F.col("rows") / k), 6).alias("precision"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"), F.round(zero(1 / F.col("first")), 6).alias("mrr"),
    )


def means(scores: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each column over the samples, 0 where there are none."""
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 5).alias(c) for c in columns])


def oracle_recall(n_relevant: Column, k: int) -> Column:
    """Best recall at k that a ranking can reach with so many relevant chunks."""
    return F.when(n_relevant > 0, F.least(n_relevant, F.lit(k)) / n_relevant).otherwise(F.lit(0.0))


def placeholder(ids: Column) -> Column:
    """True when every id is still a template's."""
    return (F.size(ids) > 0) & F.forall(ids, lambda x: F.coalesce(x.startswith("chunk_id_"), F.lit(False)))


def gate(n: Column, n_empty: Column, in_sync: Column, least: Column, min_samples: int, floor: float) -> Column:
    """Status of a golden set; the first failing check decides."""
    return (
        F.when(n == 0, "SKIPPED").when(n < min_samples, "FAILED: samples").when(n_empty > 0, "FAILED: empty rows")
        .when(~in_sync, "FAILED: out of sync").when(least < floor, "FAILED: recall").otherwise("PASSED")
    )


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative counts at each bound, and at infinity; nulls are not counted."""
    edges = [float(b) for b in bounds] + [float("inf")]
    counted = df.where(F.col(value).isNotNull()).groupBy(*by).agg(*[F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit("+Inf" if e == float("inf") else f"{e:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)])
    return counted.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.n")


def regression(now: DataFrame, base: DataFrame, key: str, worse_by: float = 10.0) -> DataFrame:
    """Change of p95 against a baseline in percent; slower by more than ``worse_by``, or more failures, is flagged; what only one side has is 'skipped'."""
    n, b = now.alias("n"), base.alias("b")
    joined = n.join(b, F.col(f"n.{key}") == F.col(f"b.{key}"), "full")
    change = F.round(100 * (F.col("n.p95") - F.col("b.p95")) / F.col("b.p95"), 4)
    status = F.when(F.col("n.p95").isNull() | F.col("b.p95").isNull(), "skipped").when((change > worse_by) | (F.col("n.failures") > F.col("b.failures")), "regressed").otherwise("ok")
    return joined.select(F.coalesce(f"n.{key}", f"b.{key}").alias(key), change.alias("change_pct"), status.alias("status"))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of a column per group, between the two nearest values: ``(by, n, names of at)``; nulls don't count.

    Values are counted first, then counts are summed up in order, over hash ranges of the value's order: no task holds a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    size = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    keyed = counts.join(size, by) if by else counts.crossJoin(F.broadcast(size))
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    ranged = keyed.withColumn("_r", F.floor((F.col("_v") - F.col("_low")) / span * RANGES).cast("int"))
    totals = ranged.groupBy(*by, "_r").agg(F.sum("_c").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(before, [*by, "_r"]).withColumn("_last", F.col("_before") + F.sum("_c").over(inside) - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    out = []
    for name, q in at.items():
        spot = (F.col("n") - 1) * F.lit(q)
        # the values at the places below and above the spot, each weighted by its nearness
        weight = lambda place, w: F.sum(F.when((F.col("_first") <= place) & (F.col("_last") >= place), F.col("_v") * w))
        low, part = F.floor(spot), spot - F.floor(spot)
        out.append((weight(low, 1 - part) + F.coalesce(weight(low + 1, part), F.lit(0.0))).alias(name))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), *out)
