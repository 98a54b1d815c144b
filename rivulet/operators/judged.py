"""Generation metrics from a judge's answers, and golden-set gates.

A sample is ``(id, question, answer, passages, parametric)``: ``passages`` an array of texts, ``parametric`` true where the answer was
given without retrieval.  A judge's answer is the column ``response``; one that can't be read scores 0 (hallucination 1).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.answers import json_object
from rivulet.operators.lexical import block_count, block_labels
from rivulet.session import materialize

#: Thresholds that a score must pass.
THRESHOLDS = {"faithfulness": 0.8, "relevance": 0.75, "precision": 0.7, "hallucination": 0.1}


def _answered() -> Column:
    return F.coalesce(F.col("answer") != "", F.lit(False))


def _passages() -> Column:
    return F.coalesce(F.size("passages"), F.lit(0)) > 0


def faithfulness(response: Column) -> Column:
    """Share of an answer's claims that the passages support; no claims are faithful."""
    claims = json_object(response, "struct<claims:array<struct<claim:string,supported:boolean>>>")["claims"]
    good = F.size(F.filter(claims, lambda c: F.coalesce(c["supported"], F.lit(False))))
    raw = F.when(F.size(claims) == 0, 1.0).otherwise(F.coalesce(good / F.size(claims), F.lit(0.0)))
    return F.when(F.col("parametric"), 1.0).when(~_answered() | ~_passages(), 0.0).when(claims.isNull(), 0.0).otherwise(raw)


def relevance(response: Column) -> Column:
    """The judge's score between 0 and 1."""
    score = json_object(response, "struct<score:double>")["score"]
    return F.when(~_answered(), 0.0).otherwise(F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def context_precision(response: Column) -> Column:
    """Share of passages judged relevant; there must be a verdict for each."""
    verdicts = json_object(response, "struct<relevant:array<boolean>>")["relevant"]
    share = F.size(F.filter(verdicts, lambda v: F.coalesce(v, F.lit(False)))) / F.size(verdicts)
    whole = (F.size(verdicts) > 0) & (F.size(verdicts) == F.size("passages")) & (F.coalesce(F.col("question"), F.lit("")) != "")
    return F.when(F.col("parametric"), 1.0).when(~_passages(), 0.0).otherwise(F.coalesce(F.when(whole, share), F.lit(0.0)))


def hallucination(score: Column) -> Column:
    """Lower is better: 0 without an answer or anything to check it against, 1 where scoring failed."""
    return F.when(F.col("parametric") | ~_answered() | ~_passages(), 0.0).otherwise(F.coalesce(score, F.lit(1.0)))


def passed(metric: str, score: Column) -> Column:
    """Strictly beyond the threshold of the metric."""
    return score < THRESHOLDS[metric] if metric == "hallucination" else score > THRESHOLDS[metric]


def modality_gate(samples: DataFrame, min_samples: dict[str, int], floor: dict[str, float], k: int = 5) -> DataFrame:
    """One row ``(n_table, n_figure, status)`` of ``(modality, n_relevant)``: the first failing check of tables, then of figures, decides."""
    ceiling = F.when(F.col("n_relevant") > 0, F.least(F.col("n_relevant"), F.lit(k)) / F.col("n_relevant"))
    parts = []
    for m in ("table", "figure"):
        own = F.col("modality") == m
        parts += [F.count_if(own).alias(f"n_{m}"), F.count_if(own & (F.col("n_relevant") == 0)).alias(f"empty_{m}"), F.min(F.when(own, ceiling)).alias(f"least_{m}")]
    one = samples.agg(*parts)
    status = F.when(F.col("n_table") + F.col("n_figure") == 0, "SKIPPED")
    for m in ("table", "figure"):
        some = F.col(f"n_{m}") > 0
        status = (
            status.when(some & (F.col(f"n_{m}") < min_samples[m]), f"FAILED: {m} samples")
            .when(some & (F.col(f"empty_{m}") > 0), f"FAILED: {m} without chunks").when(some & (F.col(f"least_{m}") < floor[m]), f"FAILED: {m} recall")
        )
    return one.select("n_table", "n_figure", status.otherwise("PASSED").alias("status"))


#: A word for the search of answers; texts and answers are divided by the same rule.
WORD = re.compile(r"[^\W_]+")


def holding(needles: list[list[str]], texts: list[str]) -> list[list[int]]:
    """For each list of needles the places of the texts that hold at least one of them.

    A needle's word that stands whole within it is a word of every text that holds it: the rarest such word gives the texts to look through.  A needle
    without one is looked for in the texts with a word that holds its longest piece; one without any word in all texts.
    """
    every = list(dict.fromkeys(n for group in needles for n in group))
    inner = {n: [m.group() for m in WORD.finditer(n) if m.start() and m.end() < len(n)] for n in every}
    pieces = {n: max(WORD.findall(n), key=len, default="") for n in every if not inner[n]}
    words = [set(WORD.findall(t)) for t in texts]
    by_piece: dict[str, list[str]] = {}
    if pieces:
        vocabulary = "\n".join(["", *set().union(*words), ""])
        for piece in set(pieces.values()) - {""}:
            held, at = by_piece.setdefault(piece, []), vocabulary.find(piece)
            while at >= 0:
                end = vocabulary.index("\n", at)
                held.append(vocabulary[vocabulary.rindex("\n", 0, at) + 1 : end])
                at = vocabulary.find(piece, end)
    asked = {w for ws in inner.values() for w in ws}.union(*by_piece.values())
    places: dict[str, list[int]] = {}
    for i, own in enumerate(words):
        for w in own & asked:
            places.setdefault(w, []).append(i)
    found = {}
    for n in every:
        if inner[n]:
            near = min((places.get(w, []) for w in inner[n]), key=len)
        else:
            near = sorted({i for w in by_piece[pieces[n]] for i in places[w]}) if pieces[n] else range(len(texts))
        found[n] = [i for i in near if n in texts[i]]
    return [found[group[0]] if len(group) == 1 else sorted({i for n in group for i in found[n]}) for group in needles]


def remap_goldens(goldens: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(row_id, chunk_id)``: golden ids that exist, else the chunks whose text holds the answer, without case.

    ``goldens`` is ``(row_id, ids, answer)``, ``chunks`` ``(chunk_id, text)``.  Texts are laid into blocks, one row a chunk, and all different answers go
    to every block; a task gives only what ``holding`` confirms, so neither words nor candidates are shuffled.
    """
    held = materialize(chunks.select("chunk_id", F.lower("text").alias("text")), "texts")
    there = goldens.select("row_id", F.explode("ids").alias("chunk_id")).where("chunk_id IS NOT NULL").distinct().join(held.select("chunk_id"), "chunk_id", "left_semi").select("row_id", "chunk_id")
    there = materialize(there, "there")
    lost = goldens.join(there.select("row_id").distinct(), "row_id", "left_anti").select("row_id", F.lower(F.regexp_replace("answer", r"^\s+|\s+$", "")).alias("needle")).where("needle != ''")
    needles = lost.groupBy("row_id").agg(F.sort_array(F.collect_set("needle")).alias("needles"))
    asked = materialize(needles.groupBy("needles").agg(F.min("row_id").alias("ask"), F.collect_list("row_id").alias("same")), "asked")
    n = block_count(held.sparkSession, held.count())
    labels = F.array(*[F.lit(x) for x in block_labels(held.sparkSession, n)])
    right_side = held.where("text IS NOT NULL").select(F.get(labels, F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int")).alias("slot"), "chunk_id", "text").repartition(n, "slot")
    left_side = asked.select(F.explode(labels).alias("slot"), "ask", "needles").repartition(n, "slot")
    row_type, chunk_type = asked.schema["ask"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("chunk_id").combine_chunks().dictionary_encode()
        code, places = names.indices.to_numpy(zero_copy_only=False), [np.empty(0, np.int64)]
        if left.num_rows and right.num_rows:
            places += [np.unique(code[np.array(at, np.int64)]) for at in holding(left.column("needles").to_pylist(), right.column("text").to_pylist())]
        ends = pa.array(np.cumsum([len(at) for at in places]).astype(np.int32))
        asks = left.column("ask").combine_chunks()
        return pa.table({"ask": asks if len(places) > 1 else asks[:0], "chunk_ids": pa.ListArray.from_arrays(ends, names.dictionary.take(pa.array(np.concatenate(places))))})

    found = left_side.groupBy("slot").cogroup(right_side.groupBy("slot")).applyInArrow(look, f"ask {row_type}, chunk_ids array<{chunk_type}>").where("size(chunk_ids) > 0")
    found = found.join(asked.select("ask", "same"), "ask").select("chunk_ids", F.explode("same").alias("row_id")).select("row_id", F.explode("chunk_ids").alias("chunk_id"))
    return there.unionByName(found)
