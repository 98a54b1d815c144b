"""Chunkers: documents to ordered chunks.

The recursive splitter is a greedy fold over pieces, so it runs as an Arrow stage; section and page
boundaries are found in the same pass.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.models import hash_embedding

#: Separators from coarse to fine, and characters of a token.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
TOKEN = 4
#: Fixed value: what stands between the slides of a deck's text.
SLIDE = "\n\n---\n\n"


class _Window:
    """Parts that make up the chunk in the making, with the length they have when joined."""

    def __init__(self, glue: str, size: int, overlap: int):
        self.glue, self.size, self.overlap = glue, size, overlap
        self.parts: deque[str] = deque()
        self.length = 0
        self.chunks: list[str] = []

    def _joined(self, more: int) -> int:
        return self.length + more + (len(self.glue) if self.parts else 0)

    def flush(self) -> None:
        chunk = self.glue.join(self.parts).strip()
        if chunk:
            self.chunks.append(chunk)

    def push(self, part: str) -> None:
        if self.parts and token_count(self._joined(len(part))) > self.size:
            self.flush()
            # what the next chunk begins with: the last whole parts within the overlap
            while self.parts and token_count(self.length) > self.overlap:
                gone = len(self.parts.popleft())
                self.length = self.length - gone - len(self.glue) if self.parts else 0
        self.length = self._joined(len(part))
        self.parts.append(part)


def token_count(length: int) -> int:
    return max(1, length // TOKEN)


def recursive_split(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    """Chunks of at most ``size`` tokens where a separator allows it, neighbours sharing up to ``overlap``."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    window, last = _Window(SEPARATORS[level], size, overlap), len(SEPARATORS) - 1
    for raw in text.split(window.glue) if level < last else text:
        if not raw.strip():
            continue
        for part in recursive_split(raw, size, overlap, level + 1) if level < last and token_count(len(raw)) > size else (raw,):
            window.push(part)
    window.flush()
    return window.chunks


def headings(text: str) -> list[tuple[int, str]]:
    """(line, title) of '#' headings outside fenced code; an unclosed fence runs to the end."""
    found, fence = [], ""
    for at, line in enumerate(text.split("\n")):
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif title := re.match(r"#{1,6}\s+(.+)$", line):
            found.append((at, title[1].strip()))
    return found


def _between(lines: list[str], marks: list[tuple[int, str]]) -> list[tuple[str | None, str]]:
    """Sections that begin at the marked lines and hold them; what comes before the first has no title, blank ones are left out."""
    cuts = [(0, None), *marks, (len(lines), None)]
    bodies = [(title, "\n".join(lines[at:end]).strip()) for (at, title), (end, _) in zip(cuts, cuts[1:])]
    return [(title, body) for title, body in bodies if body]


def _first_line(text: str) -> str | None:
    return next((x.strip() for x in text.splitlines() if x.strip()), None)


def sections(text: str, outline: list[str] | None = None, slides: list[dict] | None = None, deck: bool = False) -> list[tuple[str | None, str]]:
    """(title, body) of each section, by the best boundaries there are.

    Slides of a deck; else '#' headings outside fences; else, in a ``deck``, '---' between slides; else titles of the outline that stand on
    lines of their own, in order; else the whole text.  A section's body begins with its heading.
    """
    shown = [(s.get("title"), (s.get("text") or "").strip()) for s in slides or []]
    if any(body for _, body in shown):
        return [((title or "").strip() or _first_line(body), body) for title, body in shown if body]
    lines, marks = text.split("\n"), headings(text)
    if marks:
        return _between(lines, marks)
    titles = [t.strip() for t in outline or [] if t and t.strip()]
    if deck and SLIDE in text:
        # a slide's title is its first line, whether the outline names it or not
        return [(_first_line(part), part.strip()) for part in text.split(SLIDE) if part.strip()]
    found, start = [], 0
    for title in titles:
        at = next((i for i in range(start, len(lines)) if lines[i].strip() == title), None)
        if at is not None:
            found.append((at, title))
            start = at + 1
    if found:
        return _between(lines, found)
    return [(None, text.strip())] if text.strip() else []


SENTENCE = re.compile(r"(?<=[.!?])\s+")


def semantic_split(text: str, vector: Callable[[str], list[float]], size: int, threshold: float = 0.4) -> list[str]:
    """Sentences in groups, a new one where a sentence's vector lies further than ``threshold`` from the one before; groups over the size are split."""
    sentences = [s.strip() for s in SENTENCE.split(text.strip()) if s.strip()]
    groups: list[list[str]] = []
    before = None
    for sentence in sentences:
        v = np.asarray(vector(sentence), float)
        near = before is not None and 1.0 - float(before @ v) / max(float(np.linalg.norm(before) * np.linalg.norm(v)), 1e-12) <= threshold
        groups[-1].append(sentence) if near else groups.append([sentence])
        before = v
    return [c for g in groups for c in recursive_split(" ".join(g), size, 0)]


STRATEGIES = ("recursive", "section", "page", "parent_child", "semantic")


def chunk_documents(documents: DataFrame, strategy: str = "recursive", size: int = 500, overlap: int = 50, parent_size: int = 1500, threshold: float = 0.4) -> DataFrame:
    """``(document_id, chunk_index, parent_index, section, text)`` of ``(document_id, text)`` and what else is known of a document.

    Strategies: 'recursive'; 'section' (each on its own; ``outline``, ``slides`` and ``loader`` are used where such columns exist); 'page' (the
    column ``pages``, else form feeds divide pages); 'parent_child' (children of ``size`` within parents of ``parent_size``, whose rows come
    first); 'semantic' (by the vectors of the offline embedder).  Null and blank texts give no chunk.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "parent_child" and size >= parent_size:
        raise ValueError("children must be smaller than their parents")
    key = documents.schema["document_id"].dataType.simpleString()
    known = [c for c in ("outline", "slides", "loader", "pages") if c in documents.columns]

    def rows(text: str, more: dict) -> list[tuple[int, int | None, str | None, str]]:
        if strategy == "parent_child":
            out, child = [], 0
            for p, parent in enumerate(recursive_split(text, parent_size, 0)):
                out.append((p, None, None, parent))
                for c in recursive_split(parent, size, overlap):
                    out.append((child, p, None, c))
                    child += 1
            return out
        if strategy == "semantic":
            return [(n, None, None, c) for n, c in enumerate(semantic_split(text, hash_embedding, size, threshold))]
        if strategy == "section":
            parts = sections(text, more.get("outline"), more.get("slides"), more.get("loader") == "pptx")
        elif strategy == "page":
            pages = more.get("pages") or (text.split("\f") if "\f" in text else None)
            parts = [(str(n), p or "") for n, p in enumerate(pages, 1)] if pages else [(None, text)]
        else:
            parts = [(None, text)]
        return [(n, None, title, c) for n, (title, c) in enumerate((title, c) for title, body in parts for c in recursive_split(body, size, overlap))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            extra = [batch.column(c).to_pylist() for c in known]
            for at, text in enumerate(batch.column("text").to_pylist()):
                made = rows(text, {c: v[at] for c, v in zip(known, extra)})
                keys += [at] * len(made)
                out += made
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("document_id").take(pa.array(keys, pa.int64())), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                ["document_id", "chunk_index", "parent_index", "section", "text"],
            )

    return documents.where(F.col("text").isNotNull()).select("document_id", "text", *known).mapInArrow(run, f"document_id {key}, chunk_index bigint, parent_index bigint, section string, text string")
