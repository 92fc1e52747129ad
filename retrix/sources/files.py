"""Loaders of files as tables, and sinks. One row per file: ``doc_id``, ``content``, ``source``, ``filename``,
``extension``, ``size``, ``modified``, ``language``, ``error``. A file that can't be read comes out with null content and
the error that it gave."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings by language, and beginnings of files by kind.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cs": "csharp", "go": "go", "rb": "ruby", "rs": "rust",
    "c": "c", "cpp": "cpp", "h": "c", "php": "php", "sh": "bash", "sql": "sql", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "md": "markdown",
}
MAGIC = (("pdf", b"%PDF"), ("docx", b"PK\x03\x04"), ("html", b"<!DOC"), ("html", b"<html"), ("json", b"{"), ("json", b"["))


class _Text(HTMLParser):
    """Text of HTML without scripts and styles."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(raw: str) -> str:
    parser = _Text()
    parser.feed(raw)
    return re.sub(r"\s+", " ", " ".join(parser.parts)).strip()


def markdown_text(raw: str) -> str:
    """Text of Markdown: marks of headings, lists, emphasis, links and code taken off."""
    text = re.sub(r"```[^\n]*\n(.*?)```", r"\1", raw, flags=re.S)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d+\.[ \t]+)", "", text, flags=re.M)
    text = re.sub(r"(\*\*|__|\*|_|`|~~)(\S(?:.*?\S)?)\1", r"\2", text)
    return html.unescape(re.sub(r"<[^>]+>", " ", text)).strip()


def docx_text(raw: bytes) -> str:
    """Paragraphs of a word file that are not blank, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as held:
        root = ElementTree.fromstring(held.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(line for line in lines if line.strip())


def pdf_text(raw: bytes) -> str:
    """Pages of a PDF, one after the other, by an optional library."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ValueError("reading PDF needs the optional library pypdf") from missing
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages).strip()


def json_text(raw: str) -> str:
    return json.dumps(json.loads(raw), ensure_ascii=False, indent=2)


def csv_text(raw: str) -> str:
    return pd.read_csv(io.StringIO(raw)).to_csv(index=False)


def _plain(raw: bytes) -> str:
    return raw.decode("utf-8", errors="ignore")


READERS: dict[str, Callable[[bytes], str]] = {
    "txt": _plain, "md": lambda b: markdown_text(_plain(b)), "html": lambda b: html_text(_plain(b)), "htm": lambda b: html_text(_plain(b)), "docx": docx_text, "pdf": pdf_text, "json": lambda b: json_text(_plain(b)), "csv": lambda b: csv_text(_plain(b)),
}


def kind_of(name: str, raw: bytes) -> str:
    """How a file is read: by its ending, else by its first bytes, else as text."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending in READERS or ending in LANGUAGES:
        return ending
    return next((kind for kind, start in MAGIC if raw.lstrip()[: len(start)] == start), "txt")


def read_file(name: str, raw: bytes) -> str:
    kind = kind_of(name, raw)
    return READERS.get(kind, _plain)(raw)


def load(spark: SparkSession, paths: str | list[str], glob: str = "*", strict: bool = False) -> DataFrame:
    """All files below the paths that match ``glob``. With ``strict`` a file that can't be read is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            contents, errors = [], []
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    contents.append(read_file(path.rsplit("/", 1)[-1], bytes(raw)))
                    errors.append(None)
                except Exception as error:
                    if strict:
                        raise
                    contents.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"source": frame["path"], "content": contents, "size": frame["length"], "modified": frame["modificationTime"], "error": errors})

    loaded = files.select("path", "length", "modificationTime", "content").mapInPandas(read, "source string, content string, size long, modified timestamp, error string")
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    ending = F.lower(F.regexp_extract("source", r"\.([^./]+)$", 1))
    languages = F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))))
    return loaded.select(F.sha2("source", 256).alias("doc_id"), "content", "source", name.alias("filename"), ending.alias("extension"), "size", "modified", languages[ending].alias("language"), "error")


def git_files(spark: SparkSession, repository: str, endings: tuple[str, ...] = ("py", "js", "ts", "java", "cs", "go", "rb")) -> DataFrame:
    """Files of a working tree by ending, as ``load`` gives them; history is read where a git program is there."""
    return load(spark, repository, glob="*.{" + ",".join(endings) + "}")


def save(df: DataFrame, path: str, partition_by: str | None = "project_id", mode: str = "append") -> None:
    """Writes a table, partitioned by project so that a project's rows are read alone."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(path)


def ingest(documents: DataFrame, path: str, strategy: str = "recursive", **how) -> DataFrame:
    """Chunks documents (``doc_id``, ``content``, ``project_id``) and appends them; documents without project are refused."""
    from retrix.operators.chunking import chunk

    if documents.where("project_id IS NULL OR trim(project_id) = ''").limit(1).count():
        raise ValueError("every document needs a project_id")
    chunks = chunk(documents, "doc_id", "content", strategy, **how).join(documents.select(F.col("doc_id").alias("id"), "project_id").distinct(), "id")
    rows = chunks.select(F.sha2(F.concat_ws("|", "id", "pos"), 256).alias("chunk_id"), "id", "pos", "chunk", "project_id")
    save(rows, path)
    return rows
