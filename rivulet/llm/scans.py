r"""Noise in text from scanned pages (problem 7).

Pages are texts of hard-wrapped lines with breaks inside words or with page numbers.  Furniture (running
headers and page numbers) and word breaks are told by classifiers of line pairs; misread words are those
the other texts do not know and whose best correction, found by a character q-gram join with the known
words, a boosted ranker accepts.  Both models learn from pages and misreadings made up from clean texts:
no labelled pages exist.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.boosting import Boosted
from rivulet.session import materialize, release

#: What a scanner takes for what.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("a", "o"), ("o", "a"), ("s", "5"), ("o", "0"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("d", "cl"), ("cl", "d"),
    ("u", "n"), ("n", "u"), ("h", "li"), ("li", "h"), ("m", "rn"), ("rn", "m"), ("g", "q"), ("q", "g"), ("w", "vv"), ("vv", "w"), ("b", "6"), ("b", "h"), ("h", "b"), ("ü", "ii"),
    ("in", "m"), ("ni", "m"), ("g", "9"), ("z", "2"), ("B", "8"), ("S", "5"), ("I", "l"), ("l", "I"), ("y", "v"), ("v", "y"), ("nn", "m"), ("ri", "n"), ("é", "e"), ("ö", "o"), ("ä", "a"),
)
HYPHENS = "-¬‐‑­"
BREAK = re.compile(rf"([^\W\d_]+)[{HYPHENS}]$")
PAGE = re.compile(r"^[\s\-–—\[(|~*.]*(?:page|seite|página|pág\.?|p\.|s\.|blatt|folio)?\s*((?=[OolIS]*\d|[OolI]{2})[0-9OolIS]{1,5})(?:\s*(?:/|\||of|von|de|sur)\s*[0-9OolIS]{1,5})?[\s\-–—\])|~*.]*$", re.I)
EDGE_NUMBER = re.compile(r"^\W*(?:page|seite|página|p\.|s\.)?\s*\d{1,4}\b\W*\s+\D|\D(?:\s{2,}|\s[–—|/·-]\s?|\s(?:page|seite|página|p\.|s\.)\s?)\d{1,4}\W*$|\D\s+\d{1,4}$", re.I)
ENDS = re.compile(r"(?<![.\s])[.!?:;][\"'”»)\]]*$")
STRUCTURE = re.compile(r"^\s*([-*•+]\s|\d+[.)]\s|\||```|>|#{1,6}\s|\{|\d{4}-\d\d-\d\d|From:|To:|Subject:)")
STRIP = re.compile(r"^[^\w]+|[^\w]+$")

_DIGITS = str.maketrans("OSLI", "0511")

#: Widest line of a page; a known word is in so many other texts; texts and words that the models learn from at most.
WIDEST, KNOWN, TRAIN_TEXTS, TRAIN_WORDS = 110, 3, 400, 3000
#: Edits between a misread word and its correction: two confusions of two characters each, and one more.
DISTANCE = 5
#: Ids of pages up to which they are broadcast after counting them.
BROADCAST_IDS = 500_000
#: Scores from which a line or a correction is taken.
LINE_SCORE, WORD_SCORE = 0.45, 0.5


# --- pages ----------------------------------------------------------------------------------------


def page_width(lines: list[str]) -> int:
    """Width of hard-wrapped lines, or 0 if the text is not wrapped or is a list, log, table or letter."""
    body = [x.rstrip() for x in lines if x.strip()]
    if len(body) < 4:
        return 0
    if sum(bool(STRUCTURE.match(x)) for x in body) > 0.3 * len(body):
        return 0
    lengths = sorted(map(len, body))
    width = lengths[int(0.9 * len(lengths))]
    return width if 20 <= width <= WIDEST and sum(n > 0.75 * width for n in lengths) > 0.5 * len(body) else 0


def is_page(text: str) -> bool:
    """Wrapped lines with a word broken at a line's end or a page number on its own line."""
    lines = text.split("\n")
    if not page_width(lines):
        return False
    breaks = sum(1 for a, b in zip(lines, lines[1:]) if BREAK.search(a.rstrip()) and (not b.strip() or b.strip()[0].islower() or PAGE.match(b)))
    pages = sum(1 for x in lines if x.strip() and PAGE.match(x))
    return breaks + pages > 0


def _known_form(word: str) -> str:
    return STRIP.sub("", word).lower()


def tokens(line: str) -> list[str]:
    """Words of a line without outer punctuation; numbers, tickets, codes and settings are left out."""
    return [w for w in (STRIP.sub("", x) for x in line.split()) if w and not re.search(r"[`_=/\\]|\d[.,:]\d|^\d+$|^[A-Z]+-\d+$", w) and any(c.isalpha() for c in w)]


# --- line pairs -----------------------------------------------------------------------------------


def _furniture_key(line: str) -> str:
    """What stays of a running header from page to page: letters without case, numbers or spaces."""
    return re.sub(r"[^a-zà-ÿ]", "", re.sub(r"(?i)\b(page|seite|página)\b", "", line.lower()))


def _near(a: str, b: str) -> bool:
    """Equal but for a few misread characters, or one cut short."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5:
        return False
    if abs(len(a) - len(b)) > 3:
        return min(len(a), len(b)) >= 8 and (_near(a[: len(b)], b) if len(a) > len(b) else _near(a, b[: len(a)]))
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return at + back >= 0.6 * max(len(a), len(b)) or SequenceMatcher(None, a, b, False).ratio() >= 0.8


def line_features(lines: list[str]) -> np.ndarray:
    """One row a line, from the line, the pair with the line before and the pair with the line after."""
    width = max(1, page_width(lines) or max((len(x) for x in lines), default=1))
    full = [i for i, x in enumerate(lines) if x.strip()]
    keys = [_furniture_key(x) for x in lines]
    numbers = {i: int(m.group(1).upper().translate(_DIGITS)) for i in full if (m := PAGE.match(lines[i]))}
    starts_number = {i: int(m.group()) for i in full if i not in numbers and (m := re.search(r"^\W*\d{1,4}\b(?=\W*\s\D)|\b\d{1,4}(?=\W*$)", lines[i])) and m.group().strip().isdigit()}
    every = sorted({*numbers.values(), *starts_number.values()})
    short = [i for i in full if len(lines[i].strip()) < 0.85 * width and not ENDS.search(lines[i].rstrip())]
    title = keys[full[0]] if full else ""
    rows = []
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            rows.append([0.0] * 25)
            continue
        at = full.index(i) if i in (full[0], full[-1]) else None
        before = next((j for j in range(i - 1, -1, -1) if lines[j].strip()), None)
        after = next((j for j in range(i + 1, len(lines)) if lines[j].strip()), None)
        last, following = (lines[before].rstrip() if before is not None else ""), (lines[after].strip() if after is not None else "")
        # past furniture on either side: what the sentence before and after this line is
        prior = next((lines[j].rstrip() for j in range(i - 1, -1, -1) if lines[j].strip() and j not in numbers), "")
        later = next((lines[j].strip() for j in range(i + 1, len(lines)) if lines[j].strip() and j not in numbers), "")
        n = numbers.get(i, starts_number.get(i, -1))
        repeats = sum(1 for j in short if j != i and keys[j] and len(keys[j]) > 2 and _near(keys[j], keys[i])) if i in short and len(keys[i]) > 2 else 0
        words = text.split()
        rows.append([
            float(i in numbers), len(text) / width, float(at == 0 and i == full[0]), float(i == full[-1]), float(bool(ENDS.search(text))),
            float(before is not None and before in numbers), float(after is not None and after in numbers),
            float(bool(ENDS.search(prior))), float(later[:1].islower()), float(len(prior) > 0.75 * width), float(bool(BREAK.search(prior))),
            float(min(repeats, 4)), float(bool(title) and i != full[0] and _near(keys[i], title)), float(bool(EDGE_NUMBER.search(text)) and i not in numbers),
            float(n > 0 and (n - 1 in every)), float(n > 0 and (n + 1 in every)), sum(c.isdigit() for c in text) / len(text), sum(c.isupper() for c in text) / len(text),
            float(len(words)), sum(w[:1].isupper() for w in words) / len(words), float(last.endswith(":")), float(len(line) - len(line.lstrip())),
            float(i > 0 and not lines[i - 1].strip()), float(i + 1 < len(lines) and not lines[i + 1].strip()),
            float(line.startswith("\f")),
        ])
    return np.array(rows)


def made_up_page(text: str, rng: random.Random) -> tuple[list[str], list[str]] | None:
    """A page made from a clean text: its lines, and of each 'body', 'title', 'header', 'pageno' or 'stray'."""
    paragraphs = [re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n|\n", text) if len(p) > 60 and not STRUCTURE.match(p)]
    if sum(map(len, paragraphs)) < 800:
        return None
    names = re.findall(r"\b[A-Z][a-z]{4,}(?: [A-Z][a-z]+)?", text) or ["Annual Report"]
    title = rng.choice([" ".join(rng.choice(paragraphs).split()[: rng.randint(2, 5)]).strip(".,;:"), f"{rng.choice(names)}: {rng.choice(text.split()).strip('.,;:`')}"])
    running = rng.choice([title, title.upper(), title[: rng.randint(8, 24)] + " ...", rng.choice(names), rng.choice(names).upper(), f"{rng.choice(names)}{rng.choice(['  ', ' – ', ' / ', ' | '])}{rng.choice(names)}"])
    # a scanner may harm a header too
    header = lambda: (running if rng.random() > 0.25 else (lambda k: running[:k] + rng.choice("l1.,'i") + running[k + 1 :])(rng.randrange(len(running))))
    width, gap, blank = rng.randint(50, 76), rng.random() < 0.5, rng.random() < 0.5
    indent = "   " if rng.random() < 0.3 else ""
    lines, kinds = [title, ""], ["title", "blank"]
    page, left = rng.randint(1, 30), rng.randint(10, 24)
    total, style, order = page + rng.randint(2, 9), rng.randrange(8), rng.randrange(6)
    hyphen, feed = rng.choice("--¬‐"), rng.random() < 0.2

    def number() -> str:
        return [str(page), f"- {page} -", f"— {page} —", f"Page {page}", f"     {page}", f"[{page}]", f"{page}/{total}", f"Seite {page}"][style]

    def furniture() -> None:
        nonlocal page, left
        page, left = page + 1, rng.randint(10, 24)
        joined = [f"{header()}   {page}", f"{page}   {header()}", f"{header()} {rng.choice('–|/')} {page}"][style % 3]
        made = [[("pageno", number())], [("header", header())], [("pageno", number()), ("header", header())], [("header", header()), ("pageno", number())], [("header", joined)], [("header", joined)]][order]
        if blank and rng.random() < 0.4:
            made = [("blank", ""), *made]
        if blank:
            made = [*made, ("blank", "")]
        for at, (kind, line) in enumerate(made):
            lines.append("\f" + line if feed and kind != "blank" and not any(k != "blank" for k, _ in made[:at]) else line)
            kinds.append(kind)

    for p in paragraphs[:14]:
        if rng.random() < 0.15:
            lines.append(" ".join(rng.choice(paragraphs).split()[: rng.randint(2, 5)]).strip(".,;:"))
            kinds.append("title")
        if rng.random() < 0.12:
            lines.extend([f"{' '.join(p.split()[:2])}:".strip(".,"), str(rng.randint(1, 999))])
            kinds.extend(["body", "stray"])
        line, words = indent, p.split(" ")
        while words:
            w = words.pop(0)
            if len(line) + len(w) + 1 <= width or not line.strip():
                line += ("" if line in ("", indent) else " ") + w
                continue
            room = width - len(line) - 2
            if room >= 3 and w.isalpha() and len(w) - room >= 3 and rng.random() < 0.5:
                line += " " + w[:room] + hyphen
                w = w[room:]
            lines.append(line)
            kinds.append("body")
            left -= 1
            line = w
            if left <= 0:
                furniture()
        lines.append(line)
        kinds.append("body")
        if gap:
            lines.append("")
            kinds.append("blank")
    if rng.random() < 0.6:
        lines.append(number())
        kinds.append("pageno")
    return lines, kinds


def train_lines(texts: list[str]) -> dict[str, Boosted]:
    """Classifiers of headers and page numbers, from pages made up from clean texts."""
    rng = random.Random(7)
    x, y = [], []
    for t in texts:
        made = made_up_page(t, rng)
        if made:
            lines, kinds = made
            if rng.random() < 0.3:  # chunks begin and end anywhere
                a = rng.randrange(len(lines))
                lines, kinds = lines[a : a + 14], kinds[a : a + 14]
                if not lines:
                    continue
            f = line_features(lines)
            keep = [i for i, k in enumerate(kinds) if k != "blank"]
            x.append(f[keep])
            y.extend(kinds[i] for i in keep)
    if not x or not {"header", "pageno"} <= set(y):
        return {}
    x, y = np.concatenate(x), np.array(y)
    return {k: Boosted().fit(x, (y == k).astype(float)) for k in ("header", "pageno")}


# --- misread words --------------------------------------------------------------------------------

_PAIRS = {}
for _right, _wrong in CONFUSIONS:
    _PAIRS.setdefault(_wrong.lower(), set()).add(_right.lower())


def _undone(wrong: str, right: str) -> tuple[int, int, int]:
    """(confusions, other edits, characters changed) of the cheapest alignment; a confusion costs less than an edit."""
    n, m = len(wrong), len(right)
    best = {(0, 0): (0.0, 0, 0, 0)}
    for i in range(n + 1):
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            here = best.get((i, j))
            if here is None:
                continue

            def offer(a: int, b: int, cost: float, conf: int, edit: int, here=here) -> None:
                new = (here[0] + cost, here[1] + conf, here[2] + edit, here[3] + (cost > 0) * max(a, b))
                key = (i + a, j + b)  # noqa: B023
                if key not in best or new < best[key]:
                    best[key] = new

            if i < n and j < m:
                offer(1, 1, 0.0 if wrong[i] == right[j] else 1.0, 0, int(wrong[i] != right[j]))
            if i < n:
                offer(1, 0, 1.0, 0, 1)
            if j < m:
                offer(0, 1, 1.0, 0, 1)
            for a in (1, 2):
                for r in _PAIRS.get(wrong[i : i + a], ()) if i + a <= n else ():
                    if right.startswith(r, j):
                        offer(a, len(r), 0.3, 1, 0)
    _, conf, edit, changed = best.get((n, m), (9.0, 0, 9, 9))
    return conf, edit, changed


def word_features(wrong: str, right: str, wrong_df: int, right_df: int, in_doc: int) -> list[float]:
    conf, edit, changed = _undone(wrong, right)
    return [float(conf), float(edit), float(changed), float(len(wrong)), np.log1p(wrong_df), np.log1p(right_df), float(any(c.isdigit() for c in wrong)), conf / max(1, len(wrong)), float(in_doc > 0), float(wrong[:1] == right[:1])]


def misread(word: str, rng: random.Random) -> str | None:
    """``word`` with one or two confusions, or None where none applies."""
    out = word
    for _ in range(1 if rng.random() < 0.85 else 2):
        fits = [(a, b) for a, b in CONFUSIONS if a in out]
        if not fits:
            return None
        a, b = rng.choice(fits)
        at = rng.choice([m.start() for m in re.finditer(re.escape(a), out)])
        out = out[:at] + b + out[at + len(a) :]
    return out if out != word else None


def grams(word: str) -> set[str]:
    """Keys of the inverted join: three-character runs with the word's ends, two-character runs of short words."""
    w = f"^{word}$"
    out = {w[i : i + 3] for i in range(len(w) - 2)}
    return out | {"2" + w[i : i + 2] for i in range(len(w) - 1)} if len(word) <= 5 else out


def train_words(vocabulary: dict[str, int]) -> Boosted | None:
    """Ranker of corrections: misreadings made up from known words, against words that are only rare."""
    rng = random.Random(11)
    known = sorted(w for w, n in vocabulary.items() if n >= KNOWN and len(w) >= 3 and w.isalpha())
    rare = sorted(w for w, n in vocabulary.items() if n < KNOWN and len(w) >= 3 and w.isalpha())
    rng.shuffle(known)
    index: dict[str, list[str]] = {}
    for w in known:
        for g in grams(w):
            index.setdefault(g, []).append(w)

    def candidates(w: str) -> list[str]:
        seen = Counter(c for g in grams(w) for c in index.get(g, ()) if abs(len(c) - len(w)) <= 2 and c != w)
        return [c for c, _ in seen.most_common(8)]

    x, y = [], []
    for w in known[:TRAIN_WORDS]:
        wrong = misread(w, rng)
        if wrong and wrong not in vocabulary:
            for c in {*candidates(wrong), w}:
                x.append(word_features(wrong, c, 0, vocabulary[c], int(rng.random() < 0.3)))
                y.append(float(c == w))
    for w in rare[:TRAIN_WORDS]:
        for c in candidates(w):
            x.append(word_features(w, c, rng.choice((0, vocabulary[w] - 1, vocabulary[w])), vocabulary[c], int(rng.random() < 0.2)))
            y.append(0.0)
    if not y or max(y) == 0:
        return None
    return Boosted().fit(np.array(x), np.array(y))


# --- Spark stages ---------------------------------------------------------------------------------


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: the word counts of the texts that are no pages, and the pages themselves."""
    names = ["kind", "word", "n", "key", "doc", "text"]
    for whole in batches:
        counts: Counter[str] = Counter()
        pages = []
        for key, doc, text in zip(whole.column("key").to_pylist(), whole.column("doc").to_pylist(), whole.column("text").to_pylist()):
            if is_page(text):
                pages.append((key, doc, text))
            else:
                counts.update({w for w in map(_known_form, text.split()) if w and not w.isdigit()})
        n, m = len(counts), len(pages)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["word"] * n + ["page"] * m), pa.array([*counts.keys()] + [None] * m, pa.string()), pa.array([*counts.values()] + [None] * m, pa.int64()),
                *[pa.array([None] * n + [p[k] for p in pages], pa.string()) for k in range(3)],
            ],
            names,
        )


def _breaks(lines: list[str], kinds: list[set[str]] | None = None) -> list[tuple[int, str, str, str, bool]]:
    """(line, first part, rest, hyphen, has a continuation) of each break; furniture in between is passed over."""
    out = []
    for i, line in enumerate(lines):
        m = BREAK.search(line.rstrip())
        if not m or kinds and kinds[i] & {"header", "pageno"}:
            continue
        rest = ""
        for j in range(i + 1, min(i + 7, len(lines))):
            if lines[j].strip() and not PAGE.match(lines[j]) and not (kinds and kinds[j] & {"header", "pageno"}):
                first = re.match(r"\s*([^\W\d_]+)", lines[j])
                if first and first.group(1)[:1].islower():
                    rest = first.group(1)
                    break
                if kinds:
                    break
        # a compound may run back over hyphens of its own
        head = re.search(r"(\S*)$", line.rstrip()[:-1]).group(1)
        out.append((i, head, rest, line.rstrip()[-1], bool(rest)))
    return out


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, word, role)`` of pages: words that may be misread, and joined words and compounds of the breaks."""
    for whole in batches:
        rows = []
        for key, text in zip(whole.column("key").to_pylist(), whole.column("text").to_pylist()):
            lines = text.split("\n")
            broken = {i: (head, rest) for i, head, rest, _, _ in _breaks(lines)}
            found: set[tuple[str, str]] = set()
            skip = ""
            for i, line in enumerate(lines):
                words = line.split()
                if i in broken:
                    words = words[:-1]
                    head, rest = (_known_form(x) for x in broken[i])
                    if rest:
                        found |= {(head + rest, "word"), (f"{head}-{rest}", "compound")}
                    else:
                        found.add((head, "head"))
                if skip and words and _known_form(words[0]).startswith(skip):
                    words = words[1:]
                skip = _known_form(broken[i][1]) if i in broken else (skip if not words or PAGE.match(line) else "")
                found |= {(_known_form(w), "word") for w in tokens(" ".join(words))}
            rows += [(key, w, role) for w, role in found if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["key", "word", "role"])


def _gram_column(word: Column) -> Column:
    w = F.concat(F.lit("^"), word, F.lit("$"))
    runs = lambda n, tag: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(tag), F.substring(w, i, F.lit(n))))
    return F.array_distinct(F.when(F.length(word) <= 5, F.concat(runs(3, ""), runs(2, "2"))).otherwise(runs(3, "")))


def corrections(words: DataFrame, vocabulary: DataFrame, ranker: Boosted | None) -> DataFrame:
    """``(word, right)``: misread words among ``words`` (word, n_docs) and their best correction.

    Suspicious words are those fewer than ``KNOWN`` clean texts hold.  Candidates share a q-gram and have a
    like length; of each suspicious word every candidate is scored.
    """
    suspects = words.join(vocabulary, "word", "left").where(F.coalesce("n", F.lit(0)) < KNOWN).where(F.length("word") >= 2).select("word", F.coalesce("n", F.lit(0)).alias("wn"), "n_docs")
    trusted = vocabulary.where((F.col("n") >= KNOWN) & F.col("word").rlike(r"^[\p{L}'’\-]{2,}$"))
    left = suspects.select("word", "wn", "n_docs", F.explode(_gram_column(F.col("word"))).alias("g"), F.length("word").alias("len")).withColumn("l", F.explode(F.sequence(F.col("len") - 2, F.col("len") + 2)))
    right = trusted.select(F.col("word").alias("right"), F.col("n").alias("rn"), F.explode(_gram_column(F.col("word"))).alias("g"), F.length("word").alias("l"))
    shared = left.join(right, ["g", "l"]).groupBy("word", "right").agg(F.count("*").alias("both"), F.first("wn").alias("wn"), F.first("rn").alias("rn"), F.first("n_docs").alias("n_docs"))
    # an operation of two characters spoils at most four runs of three, or three of two
    near = shared.where((F.col("both") >= F.greatest(F.lit(1), F.greatest(F.length("word"), F.length("right")) - 8)) & (F.levenshtein("word", "right", DISTANCE) >= 0))
    # scoring is the costly part: spread it over all tasks, whatever the join left together
    near = near.select("word", "right", "wn", "rn").repartition(max(32, 2 * words.sparkSession.sparkContext.defaultParallelism), "word", "right")
    schema = "word string, right string, p double, rn bigint"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, r, wn, rn = (b.column(c).to_pylist() for c in ("word", "right", "wn", "rn"))
            x = [word_features(*row, 0) for row in zip(w, r, wn, rn)]
            p = ranker.predict(np.array(x).reshape(-1, 10)) if ranker and x else np.zeros(len(x))
            # at least one confusion, and no other edit without one
            p = [float(q) if f[0] >= 1 and f[1] <= 1 and f[1] < f[0] else 0.0 for q, f in zip(p, x)]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("right"), pa.array(p, pa.float64()), pa.array(rn, pa.int64())], ["word", "right", "p", "rn"])

    scored = near.mapInArrow(score, schema).where(F.col("p") >= WORD_SCORE)
    return scored.groupBy("word").agg(F.max_by("right", F.struct("p", "rn", "right")).alias("right"))


def _bare(line: str) -> str:
    """A header's text without the page number at either end."""
    return re.sub(r"^\W*\d+\W+|\W+\d+\W*$", "", line.strip())


def agree(lines: list[str], kinds: list[set[str]]) -> None:
    """Make the furniture of a page's breaks agree: the same places hold the same kinds from break to break."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(full)}
    width = max(1, page_width(lines) or max(map(len, lines)))
    number = {i: m.group(1).upper().translate(_DIGITS) for i in full if (m := PAGE.match(lines[i]))}
    side = lambda i, d: full[place[i] + d] if 0 <= place[i] + d < len(full) else None
    pages = {int(number[i]) for i in full if "pageno" in kinds[i]}
    for i in number:
        above = side(i, -1)
        counted = {int(number[i]) - 1, int(number[i]) + 1} & pages
        if i != full[0] and not (above is not None and lines[above].rstrip().endswith(":")):
            beside = any(j is not None and abs(j - i) == 1 and "header" in kinds[j] for j in (above, side(i, 1)))
            if counted or beside:
                kinds[i].add("pageno")
    stops = [i for i in full if "pageno" in kinds[i]]
    texts = [_bare(lines[i]) for i in full if "header" in kinds[i]]
    for d in (-1, 1):
        next_to = [j for i in stops if (j := side(i, d)) is not None and abs(j - i) <= 2]
        held = sum("header" in kinds[j] for j in next_to)
        for j in next_to:
            line = lines[j].strip()
            fits = len(line) < 0.85 * width and not ENDS.search(line) and not BREAK.search(line) and line[:1].isupper() and j != full[0] and j not in number
            known = any(len(t) >= 5 and (line.startswith(t) or t.startswith(line) or _near(_furniture_key(t), _furniture_key(line))) for t in texts)
            if fits and (known or held >= 0.5 * len(next_to) and held > 1):
                kinds[j].add("header")
    main = Counter(_bare(lines[i]) for i in full if "header" in kinds[i])
    if main:
        usual = main.most_common(1)[0][0]
        for i in full:
            if "header" not in kinds[i]:
                continue
            apart = not (i and lines[i - 1].strip()) and not (i + 1 < len(lines) and lines[i + 1].strip())
            by_number = any(j is not None and abs(j - i) <= 2 and "pageno" in kinds[j] for j in (side(i, -1), side(i, 1)))
            alike = SequenceMatcher(None, usual, _bare(lines[i]), False).ratio() >= 0.75
            if apart and not by_number and not alike and not lines[i].startswith("\f"):
                kinds[i].discard("header")


def label_lines(lines: list[str], models: dict[str, Boosted], wrong: dict[str, str], known: set[str]) -> list[set[str]]:
    """Kinds of noise of each line of a page, a set for each."""
    kinds: list[set[str]] = [set() for _ in lines]
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return kinds
    x = line_features(lines)
    for kind, model in models.items():
        p = model.predict(x)
        for i in full:
            if p[i] >= LINE_SCORE and i != full[0] and not (kind == "pageno") ^ bool(PAGE.match(lines[i])):
                kinds[i].add(kind)
    agree(lines, kinds)
    for i, head, rest, mark, goes_on in _breaks(lines, kinds):
        head, rest = _known_form(head), _known_form(rest)
        compound = mark == "-" and goes_on and f"{head}-{rest}" in known and head + rest not in known
        alone = not goes_on and mark == "-" and head in known
        if not compound and not alone:
            kinds[i].add("hyphen")
    broken = {i: _known_form(rest) for i, _, rest, _, _ in _breaks(lines, kinds)}
    skip = ""
    for i in full:
        if kinds[i] & {"header", "pageno"}:
            continue
        words = lines[i].split()
        if skip and words and _known_form(words[0]).startswith(skip):
            words = words[1:]
        skip = broken.get(i, "")
        if i in broken:
            words = words[:-1]
        if any(_known_form(w) in wrong for w in tokens(" ".join(words))):
            kinds[i].add("misread")
    # a divided word that is misread as a whole counts for the line where it begins
    for i, head, rest, _, goes_on in _breaks(lines, kinds):
        if goes_on and _known_form(head) + _known_form(rest) in wrong:
            kinds[i].add("misread")
    return kinds


def repair(lines: list[str], kinds: list[set[str]], wrong: dict[str, str]) -> str:
    """Continuous paragraphs: furniture dropped, divided words joined, misread words replaced."""

    def right(m: re.Match) -> str:
        w = m.group()
        new = wrong.get(_known_form(w))
        if not new:
            return w
        core = STRIP.sub("", w)
        return w.replace(core, new.upper() if core.isupper() and len(core) > 1 else new.capitalize() if core[:1].isupper() else new)

    out, joined, pending = [], "", False
    width = page_width(lines)
    body = [i for i, k in enumerate(kinds) if not k & {"header", "pageno"}]
    for i in body:
        line = lines[i].strip()
        # a blank line below furniture does not end a sentence
        if not line:
            if joined and ENDS.search(joined) or joined and len(joined) < 0.6 * width:
                out.append(joined)
                joined = ""
            continue
        if joined and not pending and (ENDS.search(joined) and len(lines[i]) - len(lines[i].lstrip()) >= 2 or ENDS.search(joined) and len(previous) < 0.75 * width):  # noqa: F821
            out.append(joined)
            joined = ""
        joined = joined + line if pending else f"{joined} {line}".strip()
        pending = "hyphen" in kinds[i]
        if pending:
            joined = joined[:-1]
        previous = line  # noqa: F841
    if joined:
        out.append(joined)
    return "\n\n".join(re.sub(r"\S+", right, p) for p in out)


def _named() -> list[Column]:
    return [F.when(F.left("key", F.lit(1)) == "d", "document").otherwise("chunk").alias("item"), F.substring("key", 2, 1 << 30).alias("item_id")]


class ScanRepair:
    """Noise and repaired text of the scanned pages among documents, and of chunks cut from them.

    ``documents`` is ``(key, doc, text)``: the key to report and the id chunks refer to; ``chunks`` is ``(key,
    doc, text)``.  Null texts take no part; rows repeated whole count once; texts that are no pages give no
    row.  Chunks take the labels of the lines they were cut from.  A chunk whose document is missing, or without text, is
    judged as a page of its own.
    """

    def __init__(self, documents: DataFrame, chunks: DataFrame):
        documents = documents.where("text IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("doc").cast("string").alias("doc"), "text").distinct()
        cut = chunks.where("text IS NOT NULL").select(F.col("key").cast("string").alias("chunk"), F.col("doc").cast("string").alias("doc"), "text")
        # keys begin with 'd' or 'c' from here on, for document or chunk
        alone = cut.join(documents.select("doc").distinct(), "doc", "left_anti").select(F.concat(F.lit("c"), "chunk").alias("key"), F.lit(None).cast("string").alias("doc"), "text").dropDuplicates(["key"])
        documents = documents.withColumn("key", F.concat(F.lit("d"), "key"))
        read = materialize(documents.unionByName(alone).mapInArrow(_read_documents, "kind string, word string, n bigint, key string, doc string, text string"), "read")
        vocabulary = materialize(read.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
        pages = read.where("kind = 'page'").select("key", "doc", "text")
        words = materialize(pages.mapInArrow(_page_words, "key string, word string, role string"), "page-words")
        # training: bounded samples, the same at every size
        sample = documents.where(F.length("text") > 900).orderBy(F.xxhash64(F.substring("key", 2, 1 << 30))).limit(TRAIN_TEXTS).select("text").toArrow().column("text").to_pylist()
        plain = vocabulary.where(F.col("word").rlike(r"^\p{L}{3,}$"))
        taught = {r["word"]: r["n"] for part in (plain.where(F.col("n") >= KNOWN), plain.where(F.col("n") < KNOWN)) for r in part.orderBy(F.xxhash64("word")).limit(2 * TRAIN_WORDS).toArrow().to_pylist()}
        self.lines = train_lines([t for t in sample if not is_page(t)])
        self.ranker = train_words(taught)
        counted = words.where("role = 'word'").groupBy("word").agg(F.count("*").alias("n_docs"))
        fixes = materialize(corrections(counted, vocabulary, self.ranker), "corrections")
        in_page = words.join(fixes, "word").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("wrong"))
        looked_up = words.where("role != 'word' OR length(word) > 3").join(vocabulary.where(F.col("n") >= KNOWN - 1), "word", "left_semi").groupBy("key").agg(F.collect_set("word").alias("known"))
        models, schema = self.lines, "key string, doc string, lines array<string>, kinds array<string>, wrong map<string,string>"

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = []
                for text, wrong, known in zip(b.column("text").to_pylist(), b.column("wrong").to_pylist(), b.column("known").to_pylist()):
                    lines = text.split("\n")
                    made.append((lines, ["+".join(sorted(k)) for k in label_lines(lines, models, dict(wrong or ()), set(known or ()))]))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc"), pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.list_(pa.string())), b.column("wrong")], ["key", "doc", "lines", "kinds", "wrong"])

        self.pages = materialize(pages.join(in_page, "key", "left").join(looked_up, "key", "left").select("key", "doc", "text", "wrong", "known").mapInArrow(label, schema), "labelled")
        page_docs = materialize(self.pages.where("doc IS NOT NULL").select("doc").distinct(), "page-docs")
        # only chunks of pages are moved, their texts once
        of_pages = cut.join(F.broadcast(page_docs) if page_docs.count() <= BROADCAST_IDS else page_docs, "doc", "left_semi").distinct()

        def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for text, lines, kinds, wrong in zip(*(b.column(c).to_pylist() for c in ("text", "lines", "kinds", "wrong"))):
                    out.append((mine := text.split("\n"), ["+".join(sorted(k)) for k in chunk_kinds(mine, lines, [set(filter(None, k.split("+"))) for k in kinds], dict(wrong or ()))]))
                yield pa.RecordBatch.from_arrays([pa.array(["c" + c for c in b.column("chunk").to_pylist()], pa.string()), b.column("doc"), pa.array([m[0] for m in out], pa.list_(pa.string())), pa.array([m[1] for m in out], pa.list_(pa.string())), b.column("wrong")], ["key", "doc", "lines", "kinds", "wrong"])

        self.chunks = of_pages.join(self.pages.drop("key"), "doc").mapInArrow(transfer, schema)
        release(read, words, vocabulary, fixes)

    def noise(self) -> DataFrame:
        """``(item, item_id, line_no, noise)``."""
        every = self.pages.select(*_named(), "kinds").unionByName(self.chunks.select(*_named(), "kinds"))
        lines = every.select("item", "item_id", F.posexplode("kinds").alias("at", "k")).where("k != ''")
        return lines.select("item", "item_id", (F.col("at") + 1).cast("int").alias("line_no"), F.explode(F.split("k", r"\+")).alias("noise")).distinct()

    def repaired(self) -> DataFrame:
        """``(item, item_id, text)``: continuous paragraphs of every page and of every chunk cut from one."""
        every = self.pages.unionByName(self.chunks).select(*_named(), "lines", "kinds", "wrong")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [repair(lines, [set(filter(None, k.split("+"))) for k in kinds], dict(wrong or ())) for lines, kinds, wrong in zip(*(b.column(c).to_pylist() for c in ("lines", "kinds", "wrong")))]
                yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(texts, pa.string())], ["item", "item_id", "text"])

        return every.select("item", "item_id", "lines", "kinds", "wrong").mapInArrow(run, "item string, item_id string, text string")


def chunk_kinds(mine: list[str], lines: list[str], kinds: list[set[str]], wrong: dict[str, str]) -> list[set[str]]:
    """Kinds of a chunk's lines from the lines of its document; the first and last may be parts of lines."""
    stripped = [x.strip() for x in lines]
    full = [i for i, x in enumerate(mine) if x.strip()]
    out: list[set[str]] = [set() for _ in mine]
    if not full:
        return out
    a, b = full[0], full[-1]
    best, start = -1, None
    for s in range(-len(mine) + 1, len(lines)):
        if s + a < 0 or s + b >= len(lines):
            continue
        first, last = mine[a].strip(), mine[b].strip()
        if not (stripped[s + a].endswith(first) if a != b else first in stripped[s + a]) or not (stripped[s + b].startswith(last) if a != b else True):
            continue
        same = sum(mine[i].strip() == stripped[s + i] for i in full)
        if same > best:
            best, start = same, s
    for i in full:
        text = mine[i].strip()
        if start is not None:
            j = start + i
        else:
            j = next((k for k, x in enumerate(stripped) if x == text), None)
            if j is None:
                j = next((k for k, x in enumerate(stripped) if len(text) > 12 and text in x), None)
        if j is None:
            if any(_known_form(w) in wrong for w in tokens(text)):
                out[i].add("misread")
            continue
        got = set(kinds[j])
        if text != stripped[j]:
            if "misread" in got and not any(_known_form(w) in wrong for w in tokens(text)):
                got.discard("misread")
            if "hyphen" in got and not stripped[j].endswith(text):
                got.discard("hyphen")
        out[i] = got
    return out
