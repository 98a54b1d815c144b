"""Splitting oversized items at natural boundaries (problem 2).

Everything stays in the JVM.  A piece is what one match of a bounded-quantifier regex consumes: its
alternatives are ordered by the strength of the boundary they end at, each consumes as much as the
limit allows, and single characters are the fallback.  The matches tile the text, so their
concatenation is the text; the overlap is looked back from the piece before with array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak and where they cut; a weaker one also cuts at the stronger ones.  A run of newlines or blanks is one boundary.
BOUNDARIES = (
    ("paragraph", r"(?<!\n)\n{2,}+"),
    ("line", r"(?<!\n)\n++"),
    ("sentence", r"(?:(?<!\n)\n++|(?<=[.!?])\s++)"),
    ("word", r"(?<!\s)\s++"),
)

#: What a piece ends with, by boundary, for the piece regex.
_ENDS = (r"\n{2,}", r"\n", r"(?<=[.!?])\s", r"\s")


def piece_pattern(capacity: int, overlap: int) -> str:
    """The regex whose successive matches are the new characters of each piece.

    A piece adds at most ``capacity - overlap`` characters.  Boundaries in the second half of that room
    are tried from paragraph to word, then boundaries between ``overlap`` characters and half the room,
    then any boundary, then plain characters.  Paragraph breaks of many newlines may end inside the break.
    """
    room = capacity - overlap
    if not 0 <= overlap < capacity:
        raise ValueError("the overlap must be smaller than the capacity")
    half = max(1, room // 2)
    spans = [(half, room - 1), (min(max(1, overlap), half), half)]
    parts = [rf"[\s\S]{{1,{room}}}\z"]  # a rest that fits is not cut
    for low, high in spans:
        for end in _ENDS:
            top = high - 1 if end == r"\n{2,}" else high
            if top >= low:
                parts.append(rf"[\s\S]{{{low},{top}}}" + (r"\n\n" if end == r"\n{2,}" else end))
    parts.append(rf"[\s\S]{{1,{room}}}")
    return "|".join(parts)


def pieces(text: Column, capacity: int, overlap: int) -> Column:
    """Array of pieces of ``text``: each within ``capacity``, each repeating the last ``overlap`` characters before it.

    Where the piece before is itself shorter than the overlap, the one before that is drawn on too.
    """
    tiles = F.regexp_extract_all(text, F.lit(piece_pattern(capacity, overlap)), F.lit(0))

    def with_overlap(all_tiles: Column) -> Column:
        # element_at counts from 1, so element i is the tile before the one at position i
        def repeat(tile: Column, i: Column) -> Column:
            before = F.concat(F.when(i > 1, F.element_at(all_tiles, i - 1)).otherwise(""), F.when(i > 0, F.element_at(all_tiles, i)).otherwise(""))
            return F.concat(F.right(before, F.lit(overlap)), tile)

        return F.transform(all_tiles, repeat)

    # as a lambda's variable the tiles are made once, not once for each of them
    cut = F.element_at(F.transform(F.array(tiles), with_overlap), 1) if overlap else tiles
    return F.when(F.length(text) <= capacity, F.array(text)).otherwise(cut)


def pieces_at(text: Column, capacity: int, ends: str) -> Column:
    """Pieces that each end at one kind of boundary: matches of a bounded quantifier, one right after the other, as far as they go."""
    return F.regexp_extract_all(text, F.lit(rf"\G[\s\S]{{0,{capacity}}}(?:{ends}|\z)"), F.lit(0))


def boundary(text: Column, capacity: int) -> Column:
    """The strongest boundary whose pieces go through to the end of the text, each within ``capacity``, else 'none'."""
    out = F.lit("none")
    for name, ends in reversed(BOUNDARIES):
        reached = F.aggregate(pieces_at(text, capacity, ends), F.lit(0), lambda n, piece: n + F.length(piece))
        out = F.when(reached == F.length(text), name).otherwise(out)
    return out


def split_oversized(df: DataFrame, text: str, capacity: int, overlap: int, keep: list[str]) -> DataFrame:
    """One row a piece: ``keep`` columns, ``piece_no`` from 0, ``piece``, and the item's ``boundary``.

    Null and empty texts give no piece; a text within the capacity is one piece of itself with boundary
    null.  Equal rows give equal pieces each.  Columns of ``df`` not in ``keep`` are ignored, so names
    cannot clash.
    """
    t = F.col(text)
    cut = df.where(t.isNotNull() & (t != "")).select(
        *keep,
        F.when(F.length(t) > capacity, boundary(t, capacity)).alias("boundary"),
        pieces(t, capacity, overlap).alias("_pieces"),
    )
    return cut.select(*keep, "boundary", F.posexplode("_pieces").alias("piece_no", "piece"))


def oversized_items(df: DataFrame, item: str, key: str, text: str, capacity: int) -> DataFrame:
    """``(item, item_id, boundary)`` of the items over the capacity: the strongest boundary at which they can be cut to pieces."""
    long_ones = df.where(F.length(text) > capacity).select(F.col(key).cast("string").alias("item_id"), boundary(F.col(text), capacity).alias("boundary"))
    return long_ones.select(F.lit(item).alias("item"), "item_id", "boundary").distinct()
