"""Documents from files: text, Markdown, HTML, DOCX and PPTX, read with ``binaryFile`` and parsed in Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.chunking import headings

#: Parts of a page that hold no content.
SKIPPED = frozenset("script style nav header footer aside noscript iframe svg form".split())
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

SCHEMA = "source string, content string, title string, sections array<string>, slides array<struct<title:string,text:string>>, pages array<string>, error string"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.in_title, self.title, self.parts = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        self.in_title = self.in_title or tag == "title"

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in SKIPPED))
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def load_html(data: bytes) -> dict:
    page = _Page()
    page.feed(decode(data))
    page.close()
    return {"content": "\n".join(page.parts), "title": "".join(page.title).strip() or None}


def load_markdown(data: bytes) -> dict:
    text = decode(data).strip()
    found = [t for _, t in headings(text)]
    return {"content": text, "title": found[0] if found else None, "sections": found}


def load_text(data: bytes) -> dict:
    text = decode(data)
    return {"content": text, "pages": text.split("\f") if "\f" in text else None}


def load_docx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    parts, sections = [], []
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if text:
            parts.append(text)
            style = p.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and style.get(f"{_W}val", "").startswith("Heading"):
                sections.append(text)
    return {"content": "\n\n".join(parts), "sections": sections, "title": sections[0] if sections else None}


def load_pptx(data: bytes) -> dict:
    slides = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in names:
            title, shapes = None, []
            for shape in ElementTree.fromstring(z.read(name)).iter(f"{_P}sp"):
                paragraphs = ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in shape.iter(f"{_A}p"))
                text = "\n".join(filter(None, paragraphs))
                kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                if title is None and kind is not None and kind.get("type") in ("title", "ctrTitle"):
                    title = text or None
                shapes += [text] if text else []
            if shapes:
                slides.append({"title": title, "text": "\n\n".join(shapes)})
    return {"content": "\n\n---\n\n".join(s["text"] for s in slides), "slides": slides, "title": next((s["title"] for s in slides if s["title"]), None)}


LOADERS = {".txt": load_text, ".md": load_markdown, ".markdown": load_markdown, ".html": load_html, ".htm": load_html, ".docx": load_docx, ".pptx": load_pptx}


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a file below ``path``, in any folder: its content and layout, or the ``error`` that kept it from being read.

    Files of other types are rows with an error, so one bad file never stops a run.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), "content")
    names = [c.split()[0] for c in ("source", "content", "title", "sections", "slides", "pages", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("title", pa.string()), ("text", pa.string())])), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            rows = []
            for source, data in zip(batch.column("source").to_pylist(), batch.column("content").to_pylist()):
                loader = LOADERS.get(posixpath.splitext(source)[1].lower())
                try:
                    rows.append({"source": source} | (loader(data) if loader else {"error": "unsupported type"}))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is its row's error
                    rows.append({"source": source, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return files.mapInArrow(run, SCHEMA)
