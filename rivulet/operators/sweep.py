"""Comparing settings, and greedy removal of near-duplicates.

A sweep is one plan: ranked lists of every setting are rows with a ``setting``, and one metric query scores them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import evals
from rivulet.session import materialize, release


def compare(runs: dict[str, DataFrame], relevant: DataFrame, k: int) -> DataFrame:
    """``(setting, n, recall, precision, ndcg, mrr)``: means over the queries of ``relevant``, of ``(query_id, chunk_id, rank)`` per setting.

    A setting that gives nothing scores 0.
    """
    named = [df.select(F.lit(name).alias("setting"), "query_id", "chunk_id", "rank") for name, df in runs.items()]
    # a query of a setting is a query of its own
    key = F.concat("setting", F.lit("\u0001"), F.col("query_id").cast("string")).alias("query_id")
    ranked = reduce(DataFrame.unionByName, named).select(key, "chunk_id", "rank")
    wanted = relevant.select(F.explode(F.array(*[F.lit(n) for n in runs])).alias("setting"), "query_id", "chunk_id").select(key, "chunk_id")
    scores = evals.retrieval_metrics(ranked, wanted, k).withColumn("setting", F.substring_index("query_id", "\u0001", 1))
    return evals.means(scores, ["recall", "precision", "ndcg", "mrr"], ["setting"])


def recommended(rows: DataFrame, quality: str, latency: str, weights: tuple[float, float]) -> DataFrame:
    """``(setting, score, best)``: weighted score of quality and of latency turned round, weights scaled to a sum of 1; ties go to the lesser setting."""
    total = sum(weights) or 1.0
    bounds = rows.agg(F.max(quality).alias("_mq"), F.min(latency).alias("_lo"), F.max(latency).alias("_hi"))
    swing = F.when(F.col("_hi") > F.col("_lo"), (F.col(latency) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    score = weights[0] / total * F.col(quality) / F.when(F.col("_mq") > 0, F.col("_mq")).otherwise(1.0) + weights[1] / total * (1 - swing)
    scored = rows.crossJoin(F.broadcast(bounds)).select("setting", F.round(score, 6).alias("score"))
    best = scored.agg(F.min(F.struct((-F.col("score")).alias("s"), "setting")).alias("b"))
    return scored.crossJoin(F.broadcast(best)).select("setting", "score", (F.col("setting") == F.col("b.setting")).alias("best"))


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """``(a, b)``, a < b: keys of ``(key, words)`` whose sets of words have the Jaccard similarity.

    A prefix join: of two similar sets the rarest ``(1 - least)`` share of one meets that of the other, so only rare words are joined on; every pair
    that meets is verified.
    """
    words = sets.where(F.size("words") > 0)
    each = words.select("key", F.size("words").alias("n"), F.explode("words").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("key").orderBy("df", "w")
    prefix = each.join(df, "w").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("key", "n", "w")
    a, b = prefix.alias("a"), prefix.alias("b")
    sized = (F.col("a.key") < F.col("b.key")) & (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n"))
    met = a.join(b, F.col("a.w") == F.col("b.w")).where(sized).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    both = F.size(F.array_intersect("wa", "wb"))
    joined = met.join(words.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b")
    return joined.where(both >= least * (F.size("wa") + F.size("wb") - both)).select("a", "b")


def greedy_keep(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """The keys that stay when, in order, each kept one drops all later ones it is paired with (``a`` < ``b``).

    Rounds: a key all of whose earlier partners are decided is kept unless one of them was kept; chains take as many rounds as they are long.
    """
    pairs = materialize(pairs, "pairs")
    open_ = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "open")
    gone: list[DataFrame] = []
    while not open_.isEmpty():
        waiting = pairs.join(open_.withColumnRenamed("key", "a"), "a").select(F.col("b").alias("key")).distinct()
        kept = materialize(open_.join(waiting, "key", "left_anti"), "kept")
        dropped = materialize(pairs.join(kept.withColumnRenamed("key", "a"), "a").select(F.col("b").alias("key")).distinct().join(open_, "key", "left_semi"), "dropped")
        gone.append(dropped)
        left = materialize(open_.join(kept, "key", "left_anti").join(dropped, "key", "left_anti"), "open")
        release(open_, kept)
        open_ = left
    release(pairs, open_)
    return reduce(lambda rest, d: rest.join(d, "key", "left_anti"), gone, keys)


def retention(n_before: Column, n_after: Column, wanted: int) -> Column:
    """Struct (share kept, chunks needed): how many source rows it takes to keep ``wanted`` after deduplication at this share."""
    share = F.when(n_before > 0, n_after / n_before).otherwise(1.0)
    return F.struct(share.alias("kept"), F.ceil(F.lit(float(wanted)) / F.when(share > 0, share).otherwise(1.0)).alias("needed"))
