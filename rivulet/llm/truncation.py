r"""Text cut off by field limits (problem 10).

Per source the lengths of the distinct texts, in characters and in bytes, are counted; a length far
more frequent than its neighbours is a field limit, and texts of that length without a proper end are
cut.  Cuts at no fixed length (a broken transfer) leave no spike, so every text also goes through an
end check: furniture that follows the text (page numbers, footers, notices that recur) is taken off,
and what remains must end a sentence, a list, a table, code or a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct texts a length needs, and how many times as many as the mean of the lengths around it.
SPIKE_MIN, SPIKE_RATIO, SPIKE_AROUND = 8, 30, 100

#: Notices that announce more, put below complete texts.
NOTICE = r"(?i)^\W*(more to follow|to be continued|continued|fortsetzung folgt|wird fortgesetzt|à suivre|suite à venir|continuará|sigue|continúa)\W*$"
#: A page's number alone on its line, however dressed (digits may be misread as letters).
PAGE = r"(?i)^[\s\-–—\[(|]*(page|seite|página|pág\.?|p\.|s\.)?\s*[0-9OolI]{1,5}(\s*(/|\||of|von|de|sur)\s*[0-9OolI]{1,5})?[\s\-–—\])|]*$"
#: Ends of a footer line: a name, ticket, version or date.
FOOTER_END = r"([A-Z]{2,}-\d+|\d+(\.\d+)+|\d{1,4}[/.\-]\d{1,2}[/.\-]\d{2,4}|\b(Group|Crew|Desk|Team))\.?$"
SENTENCE_END = r"[.!?:][\"'”“»«’)\]*_`]*$"
LIST_ITEM = r"^\s*([-*•+]|\d+[.)])\s+\S"


def _last_line(t: Column) -> Column:
    return F.substring_index(t, "\n", -1)


def _strip(t: Column) -> Column:
    return F.rtrim(t, F.lit(" \n\r\t\f\x0b"))


def _plain(t: Column) -> Column:
    """``t`` with every odd blank as a space, and none at the end."""
    return _strip(F.regexp_replace(t, r"[\u00a0\u2000-\u200b\u202f\u3000\t]", " "))


def length_spikes(df: DataFrame, source: str, text: str) -> DataFrame:
    """``(source, measure, size, n, around)``: lengths of a source that are field limits; ``measure`` is 'chars' or 'bytes'.

    Copies of one text count once.  The neighbours are the lengths within ``SPIKE_AROUND``.
    """
    shape = df.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("h"))
    shapes = shape.groupBy("source", "chars", "bytes").agg(F.count_distinct("h").alias("n"))
    measures = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("size"))))
    each = shapes.select("source", "chars", "bytes", "n", measures.alias("m")).select("source", "m.*", "chars", "bytes", "n")
    counts = each.groupBy("source", "measure", "size").agg(F.sum("n").alias("n"))
    near = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    around = (F.sum("n").over(near) - F.col("n")) / (2.0 * SPIKE_AROUND)
    spikes = counts.withColumn("around", around).where((F.col("n") >= SPIKE_MIN) & (F.col("n") >= SPIKE_RATIO * F.greatest("around", F.lit(0.05))))
    # a limit is in characters or in bytes, and its texts may make a lesser spike in the other measure: most of the lesser one's texts lie at the true one
    other = F.when(F.col("measure") == "chars", F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("size"))).otherwise(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("size")))
    met = each.select("source", "measure", "size", other.alias("o"), F.col("n").alias("shared")).join(spikes.select("source", "measure", "size", "n"), ["source", "measure", "size"])
    true_ones = spikes.select("source", F.struct("measure", "size").alias("o"), F.col("n").alias("other_n"))
    echoes = met.join(true_ones, ["source", "o"]).where((F.col("other_n") > F.col("n")) & (2 * F.col("shared") > F.col("n"))).select("source", "measure", "size").distinct()
    return spikes.join(echoes, ["source", "measure", "size"], "left_anti")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda's variable isn't inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _peel(t: Column) -> Column:
    """``t`` without one trailing line that is a page number, notice, signature or footer."""

    def by_tail(tail: Column) -> Column:
        # the last line and the one before it are enough: patterns never run over the whole text
        last = F.trim(F.substring_index(tail, "\n", -1))
        above = F.substring(tail, F.lit(1), F.length(tail) - F.length(F.substring_index(tail, "\n", -1)) - 1)
        body = F.substring(t, F.lit(1), F.length(t) - F.length(_last_line(t)) - 1)
        # a footer stands alone on a short line; what comes before it is not part of its sentence
        apart = above.rlike(r"(^\s*|[.!?`|)}\]]\s*)$") | last.rlike(r"^[^.!?]{2,40}:\s")
        footer = last.rlike(FOOTER_END) & (F.size(F.split(last, r"\s+")) <= 9) & ~last.rlike(LIST_ITEM) & ~last.rlike(r"^[|>\d{\[]") & apart
        signature = above.rlike(r"^-- ?$")
        gone = (last.rlike(PAGE) | last.rlike(NOTICE) | footer) & tail.contains("\n")
        return F.when(signature, _strip(F.substring(t, F.lit(1), F.length(t) - F.length(tail)))).when(gone, _strip(body)).otherwise(t)

    return _let(F.substring_index(t, "\n", -2), by_tail)


def _open_body(t: Column) -> Column:
    def by_last(last: Column) -> Column:
        marked = last.rlike(r"(\.\.\.|…|\x{FFFD}|\[…\]|\[\.\.\.\])$")
        fences = F.size(F.split(t, r"(?m)^```")) - 1
        open_table = last.rlike(r"^\|") & ~last.rlike(r"\|$")
        open_record = last.rlike(r"^[{\[]\"") & ~last.rlike(r"[}\]]$")
        log = last.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d")
        open_log = log & F.substring_index(t, "\n", -2).rlike(r"=\S+\n") & ~last.rlike(r"=\S+$")
        closed = (
            last.rlike(SENTENCE_END) | last.rlike(r"^```") | (last.rlike(r"^\|") & last.rlike(r"\|$")) | last.rlike(r"[}\]]$")
            | last.rlike(LIST_ITEM) | last.rlike(r"^#{1,6}\s") | log | last.rlike(r"^[\w.]+ = \S+$")
        )
        # texts written without any punctuation have no sentence ends to miss
        unpunctuated = ~t.rlike(r"[^\s\d][.!?][\s\"”»)]") & ~t.contains("\n")
        prose = ~closed & (F.size(F.split(last, r"\s+")) >= 2) & ~unpunctuated
        return marked | (fences % 2 == 1) | open_table | open_record | open_log | prose

    return F.when(t == "", False).otherwise(_let(F.trim(_last_line(t)), by_last))


def open_end(text: Column) -> Column:
    """True when a text stops inside a word or sentence.

    Lists, tables, closed code blocks, records, footers and signatures end a text; an ellipsis or a broken
    character after unfinished words does not.  Blank texts are complete.
    """
    t = _plain(text)
    for _ in range(3):
        t = _let(t, _peel)
    return _let(t, _open_body)


def truncated(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``(key, source, at_limit, open_end)`` of every text that was cut, once a key.

    Null texts, and texts of white space only, are none.  A null source is a source of its own.  Sources
    compare without case and outer blanks.  The list of spikes has at most a few rows a source and column;
    it is joined, never collected.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.lower(F.trim(source)), F.lit("")).alias("source"), F.col(text).alias("text"))
    spikes = length_spikes(rows, "source", "text").groupBy("source").agg(
        F.collect_set(F.when(F.col("measure") == "chars", F.col("size"))).alias("chars"),
        F.collect_set(F.when(F.col("measure") == "bytes", F.col("size"))).alias("bytes"),
    )
    t = _last_line(_plain(F.col("text")))
    proper = (t.rlike(r"[.!?][\"”»)]*$") & ~t.rlike(r"(\.\.\.|…)$")) | t.rlike(r"^```$") | t.rlike(r"\|$") | t.rlike(r"\}$") | (t.rlike(FOOTER_END) & (F.size(F.split(t, r"\s+")) <= 9))
    # the texts stay where they are: lengths and verdicts meet the spikes
    judged = rows.select("key", "source", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), (proper | t.rlike(NOTICE)).alias("proper"), open_end(F.col("text")).alias("open_end"))
    at_limit = (F.array_contains("chars", F.col("n_chars")) | F.array_contains("bytes", F.col("n_bytes"))) & ~F.col("proper")
    checked = judged.join(spikes, "source", "left").select("key", "source", F.coalesce(at_limit, F.lit(False)).alias("at_limit"), "open_end")
    return checked.where("at_limit OR open_end").groupBy("key", "source").agg(F.bool_or("at_limit").alias("at_limit"), F.bool_or("open_end").alias("open_end"))


def truncation_report(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Per source: distinct records, those cut, those cut at a field limit, and the rate of cuts."""
    n = df.where(F.col(text).isNotNull()).groupBy(F.coalesce(F.lower(F.trim(source)), F.lit("")).alias("source")).agg(F.count_distinct(key).alias("n_records"))
    cut = truncated(df, key, source, text).groupBy("source").agg(F.count("*").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"))
    return n.join(cut, "source", "left").select("source", "n_records", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_records"), 6).alias("cut_rate"))
