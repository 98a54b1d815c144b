"""Mixing sources to target weights (problem 9).

Weighted fair queueing: the documents of a source are shuffled, once for each permitted use, and each
gets a virtual finish time, the tokens of its source up to it divided by the target weight.
Sorted by that time over all sources, the sequence keeps to the weights at every point; it is cut where the
total budget is reached.  Running sums go over hash ranges, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.session import materialize

#: Rows of a range, by hash or by finish time, at which the number of ranges is set, and fewest ranges (as a power of two).
RANGE_ROWS, LEAST_BITS = 65_536, 10


def clean_source(col: Column) -> Column:
    """Sources compare without case and outer blanks."""
    return F.lower(F.trim(col))


def running_sum(df: DataFrame, by: list[str], rank: str, value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` up to each row by ``range``, then ``rank`` columns, within ``by``.

    ``df`` has a bigint ``range`` that is monotone in the order.  Sums per range are small and summed up
    first; within a range a window does the rest.
    """
    totals = df.groupBy(*by, "range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "range").orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, [*by, "range"]).withColumn(out, F.col("_start") + F.sum(value).over(inside)).drop("_start")


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 9) -> DataFrame:
    """``(doc_id, source, use_no, n_tokens, finish)``: the drawn uses of ``(doc_id, source, n_tokens)``.

    ``targets`` is ``(source, target_share, max_repeats)``.  Without a budget the largest total is taken
    that every source with a share can reach within its repeats.  Documents of other or null sources, without
    tokens, or of sources with a share or repeats of 0 are not drawn; a repeated key counts once.
    """
    aims = targets.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").alias("most")).where("share > 0 AND most > 0")
    pool = docs.where("n_tokens > 0").select("doc_id", clean_source(F.col("source")).alias("source"), "n_tokens").dropDuplicates(["doc_id"])
    # one row a target source
    aims = F.broadcast(aims)
    pool = materialize(pool.join(aims, "source"), "pool")
    have = pool.groupBy("source", "share", "most").agg(F.sum("n_tokens").alias("tokens"))
    if budget is None:
        budget = int(have.agg(F.min(F.col("tokens") * F.col("most") / F.col("share"))).first()[0] or 0)
    uses = have.select("source", F.least(F.col("most"), F.ceil(F.lit(budget) * F.col("share") / F.col("tokens")).cast("int") + 1).alias("uses"))
    drawn = pool.join(F.broadcast(uses), "source").select("doc_id", "source", "share", "n_tokens", F.explode(F.sequence(F.lit(1), F.greatest("uses", F.lit(1)))).alias("use_no"))
    # as many ranges as keep each small, however many rows there are
    bits = max(LEAST_BITS, (drawn.count() // RANGE_ROWS).bit_length() + 1)
    ranges = 1 << bits
    shuffled = drawn.withColumn("h", F.xxhash64("doc_id", "use_no", F.lit(seed))).withColumn("range", F.col("use_no").cast("bigint") * ranges + F.shiftrightunsigned("h", 64 - bits))
    # the hash is signed; its top bits order it as an unsigned number
    lined = running_sum(shuffled, ["source"], [F.shiftrightunsigned("h", 1), "doc_id"], "n_tokens", "so_far").withColumn("finish", F.col("so_far") / F.col("share"))
    lined = lined.where(F.col("finish") <= F.lit(float(budget)) * 1.0 + 1e-6).select("doc_id", "source", "use_no", "n_tokens", "finish")
    queue = materialize(lined.withColumn("range", F.floor(F.col("finish") * ranges / max(1, budget)).cast("bigint")).withColumn("all", F.lit(1)), "queue")
    cut = running_sum(queue, ["all"], ["finish", "source", "doc_id", "use_no"], "n_tokens", "total")
    return cut.where(F.col("total") <= budget).select("doc_id", "source", "use_no", "n_tokens", F.round("finish", 3).alias("finish"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target share, share reached, tokens, rows drawn and the most uses of one document; 0 where nothing was drawn."""
    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.max("use_no").alias("most_uses"))
    total = reached.agg(F.sum("n_tokens").alias("_all"))
    aims = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_rows", "most_uses")]
    return aims.join(reached, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", *zero, F.round(F.coalesce("n_tokens", F.lit(0)) / F.col("_all"), 6).alias("actual_share"))
