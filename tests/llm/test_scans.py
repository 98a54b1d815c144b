import random

import numpy as np

from rivulet.llm import scans
from rivulet.llm.boosting import Boosted

NOUNS = "scheduler archive sensor catalogue permission handbook gateway inventory watermark laboratory timeout outage specification regression".split()
VERBS = "monitors compares publishes escalates translates validates repairs delays".split()


def prose(rng, n):
    return " ".join(f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before the weekly {rng.choice(NOUNS)} ends." for _ in range(n))


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    p = Boosted().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97


def test_line_classifiers_on_held_out_pages():
    rng = random.Random(3)
    texts = ["\n\n".join(prose(rng, 8) for _ in range(6)) for _ in range(120)]
    models = scans.train_lines(texts[:80])
    right = seen = false = 0
    for t in texts[80:]:
        lines, kinds = scans.made_up_page(t, random.Random(rng.random()))
        for kind, got in zip(kinds, scans.label_lines(lines, models, {}, set())):
            if kind in ("header", "pageno"):
                seen += 1
                right += kind in got
            elif kind != "blank":
                false += bool(got & {"header", "pageno"})
    assert right / seen > 0.9 and false / seen < 0.1


PAGE = """Notes on the gateway

The scheduler monitors the arcliive before the weekly out-
age ends. The sensor compares the cata1ogue before the end.
The gateway repairs the inventory before the weekly hand-
     1
NOTES ON THE GATEWAY
book ends. The sensor delays the handbook and the re-
index job before the weekly outage of the laboratory ends.
The timeout validates the permission before the next one.
Reading at gauge:
865
The sensor compares the catalogue before the weekly outage
ends. The sensor delays the regression before the weekly
     2
NOTES ON THE GATEWAY
timeout ends. The sensor compares the catalogue before the
weekly outage ends."""


def inputs(spark):
    rng = random.Random(4)
    clean = [(str(i), f"u{i}", "\n\n".join(prose(rng, 9) for _ in range(4)) + " Every re-index job and the end of the next one and of it.", 1) for i in range(60)]
    extra = [("page", "up", PAGE, 1), ("page", "up", PAGE, 1), ("null", "un", None, 1), ("letter", "ul", "Dear all,\nthis is a shrt note\nwith a mispeling\nof no scan", 1)]
    documents = spark.createDataFrame(clean + extra, "key string, doc string, text string, kinds int")
    chunks = spark.createDataFrame([("c1", "up", "\n".join(PAGE.split("\n")[2:7])), ("c2", "up", "monitors the arcliive before the weekly out-"), ("c3", "u1", "text"), ("c4", None, "x"), ("c5", "up", None)], "key string, doc string, text string")
    return documents, chunks


def test_page_end_to_end(spark):
    work = scans.ScanRepair(*inputs(spark))
    got = {}
    for r in work.noise().collect():
        got.setdefault((r.item, r.item_id), set()).add((r.line_no, r.noise))
    want = {(3, "misread"), (3, "hyphen"), (4, "misread"), (5, "hyphen"), (6, "pageno"), (7, "header"), (15, "pageno"), (16, "header")}
    assert got[("document", "page")] == want
    assert got[("chunk", "c1")] == {(n - 2, k) for n, k in want if 3 <= n <= 7}
    assert got[("chunk", "c2")] == {(1, "misread"), (1, "hyphen")}
    assert set(got) == {("document", "page"), ("chunk", "c1"), ("chunk", "c2")}
    text = {(r.item, r.item_id): r.text for r in work.repaired().collect()}[("document", "page")]
    assert "the archive before the weekly outage ends. The sensor compares the catalogue" in text and "handbook ends" in text and "GATEWAY" not in text and "re-index" in text.replace("re- index", "re-index")


def test_empty_tables(spark):
    documents, chunks = inputs(spark)
    assert scans.ScanRepair(documents.limit(0), chunks.limit(0)).noise().count() == 0
    # a chunk whose document is missing is judged by its own lines: here the word breaks, as there are no texts to learn furniture and words from
    alone = scans.ScanRepair(documents.limit(0), chunks).noise().collect()
    assert {(r.item, r.item_id, r.line_no, r.noise) for r in alone} == {("chunk", "c1", 1, "hyphen"), ("chunk", "c1", 3, "hyphen")}
    assert scans.ScanRepair(documents, chunks.limit(0)).noise().count() == 8
