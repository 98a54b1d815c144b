import io
import zipfile

from pyspark.sql import functions as F

from rivulet import models
from rivulet.sources import loaders

W, A, P = (f'xmlns:{n}="{u[1:-1]}"' for n, u in (("w", loaders._W), ("a", loaders._A), ("p", loaders._P)))


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_files_become_rows(spark, tmp_path):
    docx = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:p/></w:body></w:document>'
    shape = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {P} {A}>{shape("title", "Head")}{shape("body", "Text")}</p:sld>'
    files = {
        "a.html": b"<html><title>T &amp; U</title><script>x</script><nav>menu</nav><body><h1>Hi</h1> there</body>", "sub/b.md": b"# One\n```\n# no\n```\n", "c.txt": "caf\xe9".encode("latin-1"),
        "d.docx": zipped(word__document_xml=docx), "e.pptx": zipped(ppt__slides__slide1_xml=slide), "bad.docx": b"not a zip", "f.pdf": b"%PDF",
    }
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = {r.source.rsplit("/", 1)[1]: r for r in loaders.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.html"].content == "T & U\nHi\nthere" and got["a.html"].title == "T & U"
    assert got["b.md"].sections == ["One"] and got["c.txt"].content == "café"
    assert (got["d.docx"].content, got["d.docx"].sections) == ("Top\n\nBody", ["Top"])
    assert got["e.pptx"].slides[0].title == "Head" and got["e.pptx"].content == "Head\n\nText"
    assert got["bad.docx"].error.startswith("BadZipFile") and got["f.pdf"].error == "unsupported type"


def test_model_slots(spark):
    df = spark.createDataFrame([("blue log", "the blue log"), (None, "x"), ("a b", "b")], "q string, t string")
    assert [r[0] for r in df.select(models.rerank(F.col("q"), F.col("t"))).collect()] == [1.0, 0.0, 0.5]
    assert len(df.select(models.embed(F.col("t"), 8)).first()[0]) == 8

    def broken():
        def fail(_):
            raise ValueError

        return fail

    assert df.select(models.apply_model(broken, "string", F.col("t"))).first()[0] is None
