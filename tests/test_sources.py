"""Loading files of several kinds and writing chunks."""

from __future__ import annotations

import zipfile

import pytest

from retrix.sources import files


def write_docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as held:
        held.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_load(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Olá\nmundo")
    (tmp_path / "b.html").write_text("<html><script>x()</script><style>p{}</style><p>Um &amp; dois</p></html>")
    (tmp_path / "c.md").write_text("# Título\n\n- **forte** [elo](http://x)\n")
    (tmp_path / "d.json").write_text('{"a": 1}')
    (tmp_path / "e.csv").write_text("x,y\n1,2\n")
    (tmp_path / "f.py").write_text("def f(): pass\n")
    (tmp_path / "g.json").write_text("{broken")
    (tmp_path / "sub").mkdir()
    write_docx(tmp_path / "sub" / "h.docx", ["Um", " ", "Dois"])
    rows = {r["filename"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["content"] == "Olá\nmundo" and rows["b.html"]["content"] == "Um & dois"
    assert rows["c.md"]["content"] == "Título\n\nforte elo" and rows["d.json"]["content"] == '{\n  "a": 1\n}'
    assert rows["e.csv"]["content"] == "x,y\n1,2\n" and rows["f.py"]["language"] == "python"
    assert rows["g.json"]["content"] is None and rows["h.docx"]["content"] == "Um\nDois"
    assert rows["a.txt"]["size"] == 10 and rows["a.txt"]["extension"] == "txt"
    with pytest.raises(Exception, match="."):
        files.load(spark, str(tmp_path), "g.json", strict=True).collect()


def test_kinds():
    assert files.kind_of("x", b"%PDF-1.4") == "pdf" and files.kind_of("x", b"  {}") == "json" and files.kind_of("x", b"abc") == "txt" and files.kind_of("x.py", b"%PDF") == "py"


def test_ingest(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "um texto. " * 100, "p1"), ("d2", "curto", "p2"), ("d3", None, "p2")], "doc_id string, content string, project_id string")
    files.ingest(docs, str(tmp_path / "out"), "recursive", size=200, overlap=20)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert {r["project_id"] for r in read.collect()} == {"p1", "p2"} and read.where("project_id = 'p2'").count() == 1
    with pytest.raises(ValueError, match="project_id"):
        files.ingest(docs.withColumn("project_id", docs["content"].substr(1, 0)), str(tmp_path / "no"))
