"""String functions as Column expressions; each has the same value in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as white space between words (Unicode white space).
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: SPACE for splitting: nearly all characters fail the first range, without a look at the rest of the class.
_BREAK = rf"[\x00-\x20\x{{85}}-\x{{3000}}&&{SPACE}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokenize(text: Column) -> Column:
    """Lower-case words between white space; null gives null, blank an empty array."""
    return F.array_remove(F.split(F.lower(text), f"{_BREAK}+"), "")


def token_estimate(text: Column) -> Column:
    """Tokens by the four-characters rule, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def content_hash(text: Column, source: Column) -> Column:
    """16 hex digits that name a text of a source."""
    return F.substring(F.sha2(F.concat(strip(text), F.lit("|"), source), 256), 1, 16)


def truncate_sentence(text: Column, max_tokens: int) -> Column:
    """At most ``max_tokens`` by the four-characters rule, cut after the last full stop if there is one past the start."""
    if max_tokens <= 0:
        return F.lit("")
    head = F.substring(text, 1, 4 * max_tokens)
    last = F.length(head) - F.instr(F.reverse(head), ".")
    cut = F.when(F.contains(head, F.lit(".")) & (last > 0), F.left(head, last + 1)).otherwise(head)
    return F.when(F.length(text) <= 4 * max_tokens, text).otherwise(strip(cut))


def strip_list_prefix(line: Column) -> Column:
    """A line without its number or bullet."""
    return F.regexp_replace(line, r"^\d+[.)]\s*|^[-•*]\s*", "")


def entity_names(text: Column) -> Column:
    """Distinct capitalised words of two letters and more, sorted."""
    words = F.split(text, r"[,;.!?\s]+")
    capital = lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}")
    return F.array_sort(F.array_distinct(F.filter(words, capital)))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def safe_segment(name: Column) -> Column:
    """A name as one path segment: other characters become '_'."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def overlap_length(left: Column, right: Column, most: int = 512) -> Column:
    """Longest suffix of ``left`` that is a prefix of ``right``, up to ``most`` characters; 0 if none."""
    # a mark that no text holds stands between the end of one and the start of the other; the earliest start of what is repeated behind it is the longest
    ends = F.concat(F.right(left, F.lit(most)), F.lit("\uffff"), F.left(right, F.lit(most)))
    return F.length(F.regexp_extract(ends, r"(?s)^[^\uFFFF]*?([^\uFFFF]+)\uFFFF\1", 1)).cast("bigint")


def context_header(source: Column, section: Column, page: Column) -> Column:
    """'[Document: f | Section: s | Page: p]' with a dash for what is missing."""
    dash = lambda c: F.coalesce(F.when(strip(c.cast("string")) != "", strip(c.cast("string"))), F.lit("—"))
    return F.concat(F.lit("[Document: "), dash(source), F.lit(" | Section: "), dash(section), F.lit(" | Page: "), dash(page), F.lit("]"))


def heading_lines(text: Column) -> Column:
    """The lines of a text, those within fenced code emptied.

    A fence is three or more backticks or tildes after at most three blanks; it is closed by as many of the same mark with nothing
    behind them, else it runs to the end.
    """
    mark = lambda line: F.regexp_extract(line, r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})", 1)

    def step(state: Column, line: Column) -> Column:
        opened, found = state["fence"], mark(line)
        closes = (opened != "") & found.startswith(opened) & F.trim(line).rlike(r"^(`+|~+)$")
        after = F.when(opened == "", found).when(closes, "").otherwise(opened)
        shown = F.when((opened == "") & (found == ""), line).otherwise("")
        return F.struct(after.alias("fence"), F.concat(state["lines"], F.array(shown)).alias("lines"))

    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("lines"))
    folded = F.aggregate(F.split(text, "\n"), start, step, lambda s: s["lines"])
    # most texts have no fence and need no fold
    return F.when(text.rlike(r"(?m)^ {0,3}(```|~~~)"), folded).otherwise(F.split(text, "\n"))


def json_rescue(text: Column, schema: str) -> Column:
    """JSON in a model's answer: the whole text, else its first bracketed list or outermost object; null if neither parses."""
    listed = schema.lower().startswith("array")
    pattern, whole = (r"(?s)\[.*?\]", r"(?s)^\[.*\]$") if listed else (r"(?s)\{.*\}", r"(?s)^\{.*\}$")
    bare = strip(text)
    found = F.when(bare.rlike(whole), bare).otherwise(F.regexp_extract(text, pattern, 0))
    return F.when(found != "", F.from_json(found, schema))
