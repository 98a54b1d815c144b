"""From ranked chunks to passages: parents, adjacent segments, budgets, diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.text import overlap_length, strip, token_estimate


def with_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits ``(query_id, chunk_id, parent_id, text, rank)`` with ``context``: the parent's text, or their own where it has none."""
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    known = F.when(F.trim("parent_text") != "", F.col("parent_text"))
    return hits.join(parents, "parent_id", "left").withColumn("enriched", known.isNotNull()).withColumn("context", F.coalesce(known, "text"))


def without_redundant_parents(hits: DataFrame) -> DataFrame:
    """Hits that are not themselves the parent of an enriched hit of the same query."""
    gone = F.collect_set(F.when(F.col("enriched") & F.col("query_id").isNotNull(), F.col("parent_id"))).over(Window.partitionBy("query_id"))
    return hits.withColumn("_gone", gone).where(~F.coalesce(F.array_contains("_gone", F.col("chunk_id")), F.lit(False))).drop("_gone")


def islands(hits: DataFrame) -> DataFrame:
    """``(query_id, document_id, parent_id, first_index, last_index, n_chunks, rank)``: runs of consecutive chunk indexes.

    Chunks without an index, and propositions, are runs of their own and left out here.  Two chunks of one index
    do not continue each other.
    """
    group = Window.partitionBy("query_id", "document_id", "parent_id").orderBy("chunk_index", "rank")
    numbered = hits.where(F.col("chunk_index").isNotNull() & ~F.col("chunk_type").eqNullSafe("proposition"))
    new = F.when(F.col("chunk_index") == F.lag("chunk_index").over(group) + 1, 0).otherwise(1)
    run = numbered.withColumn("new", new).withColumn("run", F.sum("new").over(group))
    return run.groupBy("query_id", "document_id", "parent_id", "run").agg(
        F.min("chunk_index").cast("bigint").alias("first_index"), F.max("chunk_index").cast("bigint").alias("last_index"), F.count("*").alias("n_chunks"), F.min("rank").alias("rank")
    ).drop("run")


def passage_key(parent_id: Column, enriched: Column, merged: Column, chunk_id: Column) -> Column:
    """What makes two hits one passage: their parent, the set they were merged from, or the chunk."""
    return F.when(enriched, parent_id).when(F.size(merged) > 0, F.concat(F.lit("merged:"), F.array_join(F.array_sort(merged), ","))).otherwise(chunk_id)


def passages(hits: DataFrame, key: str) -> DataFrame:
    """``(query_id, passage, first_rank, chunk_ids)`` in order of first appearance."""
    return hits.groupBy("query_id", F.col(key).alias("passage")).agg(
        F.min("rank").alias("first_rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]), ",").alias("chunk_ids")
    )


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def cut(text: str, most: int) -> str:
    """At most so many tokens, ended after a full stop where there is one."""
    if most <= 0:
        return ""
    if len(text) <= 4 * most:
        return text
    head = text[: 4 * most]
    stop = head.rfind(".")
    return (head[: stop + 1] if stop > 0 else head).strip()


def appended(text: Column, more: Column) -> Column:
    """Two neighbouring texts as one: what the second repeats of the first's end once, a blank line between them where they share nothing."""
    shared = overlap_length(text, more)
    return F.when(text == "", more).when(more == "", text).when(shared > 0, F.concat(text, F.substring(more, shared.cast("int") + 1, 1 << 30))).otherwise(F.concat(text, F.lit("\n\n"), more))


def merge_segments(hits: DataFrame, max_tokens: int) -> DataFrame:
    """Adjacent hits merged as long as the joined text stays within ``max_tokens``.

    Per query, document and parent group, which a query's top-k bounds.  ``(query_id, chunk_id, chunk_ids, text, rank)``: the
    first chunk's id, all member ids, the joined text and the best rank.  Chunks without an index, and propositions, stay alone.
    """
    alone = F.col("chunk_index").isNull() | F.col("chunk_type").eqNullSafe("proposition")
    columns = ["query_id", "chunk_id", "chunk_ids", "text", "rank"]
    single = hits.where(alone).select("query_id", "chunk_id", F.col("chunk_id").alias("chunk_ids"), "text", F.col("rank").cast("bigint").alias("rank"))
    row = F.struct(F.col("chunk_index").cast("bigint").alias("at"), F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    groups = hits.where(~alone).groupBy("query_id", "document_id", "parent_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def segment(r: Column) -> Column:
        return F.struct(r["at"].alias("last"), r["chunk_id"].alias("chunk_id"), F.array(r["chunk_id"]).alias("ids"), r["text"].alias("text"), strip(r["text"]).alias("joined"), r["rank"].alias("rank"))

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        near = r["at"] == last["last"] + 1

        def chosen(both: Column) -> Column:
            grown = F.struct(r["at"].alias("last"), last["chunk_id"].alias("chunk_id"), F.concat(last["ids"], F.array(r["chunk_id"])).alias("ids"), both.alias("text"), both.alias("joined"), F.least(last["rank"], r["rank"]).alias("rank"))
            return F.when(near & (token_estimate(both) <= max_tokens), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(segment(r))))

        # as a lambda's variable the joined text is made once, and only for neighbours
        return F.element_at(F.transform(F.array(F.when(near, appended(last["joined"], strip(r["text"]))).otherwise("")), lambda both: chosen(both)), 1)

    segments = F.aggregate(F.slice("rows", 2, 1 << 30), F.array(segment(F.col("rows")[0])), step)
    merged = groups.select("query_id", F.explode(segments).alias("s")).select("query_id", "s.chunk_id", F.array_join("s.ids", ",").alias("chunk_ids"), "s.text", "s.rank")
    return merged.select(*columns).unionByName(single.select(*columns))


def within(text: str, budget: int) -> Column:
    """What ``cut`` reads of a text at this budget or less: its characters, and one more that tells that it is longer."""
    return F.left(text, F.lit(4 * max(0, budget) + 1))


def compress(hits: DataFrame, budget: int) -> DataFrame:
    """Passages in rank order cut to what is left of a query's token budget; chunks of a passage already taken are free.

    ``(query_id, chunk_id, text, rank)``; what no longer fits is left out.
    """

    schema = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("text", pa.string()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query_id, group in zip(batch.column("query_id").to_pylist(), batch.column("hits").to_pylist()):
                left, taken = budget, {}
                for r in group:
                    if r["passage"] not in taken:
                        if left <= 0:
                            break
                        text = cut(r["text"] or "", left)
                        if not text:
                            continue
                        taken[r["passage"]] = text
                        left -= tokens(text)
                    rows.append((query_id, r["chunk_id"], taken[r["passage"]], r["rank"]))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema)

    row = F.struct(F.col("rank").cast("bigint").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), "passage", within("text", budget).alias("text"))
    groups = hits.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.array_sort(F.collect_list(row)).alias("hits"))
    return groups.mapInArrow(run, "query_id string, chunk_id string, text string, rank bigint")


def fits_whole(hits: DataFrame, budget: int, size: Column | None = None) -> DataFrame:
    """Hits whose passages fit the budget uncut, up to the first that does not: a running sum in rank order of ``size``, else of the text's tokens."""
    size = token_estimate(F.col("text")) if size is None else size
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(size).over(order)).where(F.col("used") <= budget)


def mmr(hits: DataFrame, weight: float, k: int) -> DataFrame:
    """Maximal marginal relevance over a query's ranked hits ``(query_id, chunk_id, rank, v)``, which its top-k bounds.

    Relevance falls evenly with the rank; similarity is the cosine to what is already chosen, 0 for zero vectors;
    ties go to the better rank.  A weight of 1 and over keeps the first k.
    """
    qtype = hits.schema["query_id"].dataType.simpleString()
    ctype = hits.schema["chunk_id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        n = len(group)
        x = np.array(group.v.tolist(), np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        relevance = (n - np.arange(n)) / n
        similar, chosen, open_ = np.full(n, -np.inf), [], np.ones(n, bool)
        while len(chosen) < min(k, n):
            penalty = np.where(np.isneginf(similar), 0.0, similar)
            value = np.where(open_, relevance if weight >= 1 else weight * relevance - (1 - weight) * penalty, -np.inf)
            best = int(value.argmax())
            chosen.append(best)
            open_[best] = False
            similar = np.maximum(similar, x @ x[best])
        out = group.loc[chosen, ["query_id", "chunk_id"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1)
        return out

    return hits.select("query_id", "chunk_id", "rank", "v").groupBy("query_id").applyInPandas(run, f"query_id {qtype}, chunk_id {ctype}, mmr_rank bigint")
