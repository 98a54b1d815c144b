"""Reading what a language model wrote: JSON within prose, as Column expressions that give null where nothing can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an agent may decide, and the axes a proposition is graded on.
ACTIONS = ("ANSWER", "RETRIEVE_MORE", "GRAPH_LOOKUP", "CLARIFY")
AXES = ("accuracy", "clarity", "completeness", "conciseness")
#: Retrieval settings by kind of question; unknown kinds count as factual.
STRATEGIES = {
    "factual": (30, 1, False, True),
    "analytical": (50, 3, True, True),
    "opinion": (20, 2, False, False),
    "contextual": (40, 2, False, True),
}


def _strict(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def json_object(text: Column, schema: str) -> Column:
    """The object that is the whole text, else what stands between the first and the last brace."""
    read = lambda t: F.when(F.trim(t).startswith("{") & F.try_parse_json(t).isNotNull(), _strict(F.trim(t), schema))
    return F.coalesce(read(text), read(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def json_list(text: Column, element: str) -> Column:
    """The list that is the whole text, else the first one in brackets."""
    read = lambda t: F.when(F.trim(t).startswith("[") & F.try_parse_json(t).isNotNull(), _strict(F.trim(t), f"array<{element}>"))
    return F.coalesce(read(text), read(F.regexp_extract(text, r"(?s)\[.*?\]", 0)))


def string_list(text: Column) -> Column:
    """The non-blank strings of a list, trimmed; null if there are none."""
    items = F.filter(F.transform(json_list(text, "string"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return F.when(F.size(items) > 0, items)


def triples(text: Column) -> Column:
    """Array of (subject, relation, object, subject_type, object_type): those with all three strings, of type 'Entity' where none is given."""
    raw = json_list(text, "struct<subject:string,relation:string,object:string,subject_type:string,object_type:string>")
    whole = F.filter(raw, lambda t: t["subject"].isNotNull() & t["relation"].isNotNull() & t["object"].isNotNull())
    typed = lambda c: F.coalesce(c, F.lit("Entity"))
    made = F.transform(whole, lambda t: F.struct(
        F.trim(t["subject"]).alias("subject"), F.trim(t["relation"]).alias("relation"), F.trim(t["object"]).alias("object"),
        typed(t["subject_type"]).alias("subject_type"), typed(t["object_type"]).alias("object_type"),
    ))
    return F.coalesce(made, F.filter(made, lambda t: F.lit(False)), F.array().cast("array<struct<subject:string,relation:string,object:string,subject_type:string,object_type:string>>"))


def decision(text: Column) -> Column:
    """Struct (action, refined_query, entities) of an agent; whatever can't be read is an ANSWER."""
    read = json_object(text, "struct<action:string,refined_query:string,entities:array<string>>")
    action = F.upper(F.coalesce(read["action"], F.lit("ANSWER")))
    known = action.isin(*ACTIONS)
    return F.struct(
        F.when(read.isNotNull() & known, action).otherwise("ANSWER").alias("action"),
        F.when(known, F.coalesce(read["refined_query"], F.lit(""))).otherwise("").alias("refined_query"),
        F.coalesce(F.when(known, read["entities"]), F.array().cast("array<string>")).alias("entities"),
    )


def whole_number(value: Column) -> Column:
    """A score written as a number or a string, if it is whole."""
    x = value.try_cast("double")
    return F.when(x == F.floor(x), x.cast("int"))


def grades(text: Column) -> Column:
    """Struct of the four grades of a proposition, null unless all can be read."""
    read = json_object(text, "struct<" + ",".join(f"{a}:string" for a in AXES) + ">")
    each = [whole_number(read[a]) for a in AXES]
    return F.when(F.greatest(*[F.when(e.isNull(), 1).otherwise(0) for e in each]) == 0, F.struct(*[e.alias(a) for e, a in zip(each, AXES)]))


def strategy(kind: Column) -> Column:
    """Struct (top_k, n_variants, hyde, compression) for a kind of question."""
    row = lambda k: F.struct(*[F.lit(v).alias(n) for n, v in zip(("top_k", "n_variants", "hyde", "compression"), STRATEGIES[k])])
    out = row("factual")
    for k in ("analytical", "opinion", "contextual"):
        out = F.when(F.lower(kind) == k, row(k)).otherwise(out)
    return out


def verbatim(span: Column, passage: Column) -> Column:
    r"""The part of a passage that a span quotes, white space counting as equal; null if there is none.

    The words of the span are quoted with \Q and \E, so they are compared as they are.
    """
    bare = F.trim(F.regexp_replace(span, r"^\s+|\s+$", ""))
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    found = F.call_function("regexp_extract", passage, F.array_join(words, r"\s+"), F.lit(0))
    return F.when(bare == "", None).when(F.contains(passage, bare), bare).when(found != "", found)


def proposition_key(text: Column) -> Column:
    """What two wordings of one proposition share: no case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint")


def escape_dollar(text: Column) -> Column:
    """A text that a '$' template leaves as it is."""
    return F.replace(text, F.lit("$"), F.lit("$$"))


def redact_url(url: Column) -> Column:
    """A URL without its user and password."""
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/@\s]*@", "$1***@")


def passages(rows: Column) -> Column:
    """'[1] chunk_id=a' and the text below it, for each struct (chunk_id, text) of an array."""
    line = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] chunk_id="), r["chunk_id"], F.lit("\n"), r["text"])
    return F.array_join(F.transform(rows, line), "\n\n")
