"""Functions and methods paired with their documentation.

A lexer finds the spans of strings and comments of a file and blanks them. Documentation spans and
definition spans are then found independently of each other, and an as-of join on their places attaches
to every definition the nearest documentation that ends before it (in Python: that begins after it),
unless anything but annotations stands between.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.functions.definitions import definitions
from retrix.functions.lexing import ENDINGS, NAMES, Brackets, lex, skip_space

@dataclass(frozen=True)
class Pair:
    line: int
    kind: str
    name: str
    signature: str
    docstring: str


_ANNOTATION = {
    "javascript": re.compile(r"(?:\s|@[\w$.]+(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?)*"),
    "csharp": re.compile(r"(?:\s|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*"),
}
_ANNOTATION["typescript"] = _ANNOTATION["java"] = _ANNOTATION["javascript"]


def _documentation(text: str, spans: list[tuple[int, int, str]], language: str) -> list[tuple[int, int]]:
    """Spans of documentation: ``/** */`` blocks, or runs of ``///`` lines in C#."""
    out: list[tuple[int, int]] = []
    for start, end, kind in spans:
        if kind != "comment":
            continue
        if language == "csharp":
            if text.startswith("///", start) and not text.startswith("////", start):
                if out and not text[out[-1][1] : start].strip() and text.count("\n", out[-1][1], start) == 1:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
        elif text.startswith("/**", start) and end - start > 4:
            out.append((start, end))
    return out


#: Lines that begin parameters or return values, and headings of such sections.
_TAG = re.compile(r"^\s*(?:[@\\:](?:params?|arg|args|argument|returns?|retval|rtype|type|throws?|exception|raises?|yields?|property|typeparam|template|keyword|kwarg)\b|<(?:param|returns?|typeparam|exception|value)\b)", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields?|throws|par[âa]metros|argumentos|retornos?|retorna|devuelve|devolve)\s*:?\s*$", re.I)
_INLINE = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields?|par[âa]metros|argumentos|retornos?|retorna|devuelve|devolve)\s*:\s*\S", re.I)
_TODO = re.compile(r"^\W*(?:to-?do|fixme|xxx|tbd|tbc|hack|wip|a fazer|por fazer|por hacer|pendiente|pendente)\b", re.I)
_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_XML = re.compile(r"</?[A-Za-z][^<>]*>")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W_A-Z]+|[A-Z]|\d+")


def plain(text: str, language: str) -> str:
    """The text of a documentation without the marks of the comment."""
    if language == "python":
        return text
    if language == "csharp":
        return "\n".join(re.sub(r"^\s*///\s?", "", line) for line in text.splitlines())
    inner = text[3:-2] if text.endswith("*/") else text[3:]
    return "\n".join(re.sub(r"^\s*\*\s?", "", line) if k else line for k, line in enumerate(inner.splitlines()))


def description(text: str) -> str:
    """What a documentation says besides lists of parameters and return values."""
    text = re.sub(r"<(param|returns?|typeparam|exception|value)\b[^<>]*?(?:/>|>.*?</\1>)", "\n", text, flags=re.S | re.I)
    kept, skipping, indent = [], False, 0
    lines = text.expandtabs().splitlines()
    for k, line in enumerate(lines):
        if not line.strip():
            skipping = False
            continue
        own = len(line) - len(line.lstrip())
        if _SECTION.match(line):
            skipping, indent = True, own
            continue
        if _TAG.match(line) or _INLINE.match(line):
            skipping, indent = True, own
            continue
        if skipping and own > indent or re.fullmatch(r"\s*[-=~]{3,}\s*", line):
            continue
        skipping = False
        kept.append(_XML.sub(" ", line).strip())
    return "\n".join(x for x in kept if x)


def trivial(documentation: str, name: str) -> bool:
    """Whether a documentation says nothing: fewer than three words, a to-do mark, the name in words, or only
    parameters and return values."""
    said = description(documentation)
    words = [w.lower() for w in _WORDS.findall(said)]
    if len(words) < 3 or (_TODO.match(said) and len(words) <= 6 and "\n" not in said):
        return True
    split = lambda x: [w.lower() for part in re.split(r"[\W_]+", x) for w in _HUMPS.findall(part)]
    return split(said) == split(name)


def pairs(text: str, language: str) -> list[Pair]:
    """All definitions of a file with documentation that says something, in order of place."""
    code, spans = lex(text, language)
    brackets = Brackets(code)
    found: dict[int, tuple[Definition, str]] = {}
    if language == "python":
        strings = [(s, e) for s, e, kind in spans if kind == "string"]
        starts = [s for s, _ in strings]
        for d in definitions(code, language, brackets):
            k = bisect_left(starts, d.end)  # the nearest string at or behind the colon
            if k == len(starts) or code[d.end : strings[k][0]].strip():
                continue
            start, end = strings[k]
            rest = code[end : code.find("\n", end) if code.find("\n", end) >= 0 else len(code)].strip()
            literal = re.match(r"([rRuUbBfF]*)('''|\"\"\"|'|\")(.*)\2\Z", text[start:end], re.S)
            if literal and not set(literal.group(1).lower()) & set("bf") and (not rest or rest.startswith(";")):
                found[d.name_at] = (d, literal.group(3))
    else:
        documented = _documentation(text, spans, language)
        ends = [e for _, e in documented]
        others = [s for s, _, kind in spans if kind == "comment"]
        for d in sorted(definitions(code, language, brackets), key=lambda d: d.start):
            head = skip_space(code, d.start)
            k = bisect_right(ends, head) - 1  # the nearest documentation that ends before the definition
            if k < 0 or d.name_at in found:
                continue
            start, end = documented[k]
            if bisect_left(others, end) != bisect_left(others, head) or not _ANNOTATION[language].fullmatch(code, end, head):
                continue
            found[d.name_at] = (d, plain(text[start:end], language))
    classes = [(m.start(), len(m.group(1))) for m in re.finditer(r"^([ \t]*)(?:\w+[ \t]+)*class\s", code, re.M)]
    out = []
    lines = [m.start() for m in re.finditer("\n", text)]
    for place, (d, documentation) in sorted(found.items()):
        if trivial(documentation, d.name):
            continue
        head = skip_space(code, d.start)
        column = head - (code.rfind("\n", 0, head) + 1)
        k = bisect_left(classes, (d.start, 0)) - 1
        kind = "method" if k >= 0 and column > classes[k][1] else "function"
        out.append(Pair(bisect_left(lines, place) + 1, kind, d.name, " ".join(text[head : d.end].split()).rstrip(" {;=>:"), documentation.strip()))
    return out


def language_of(source: str | None, named: str | None, text: str) -> str | None:
    """The language of a file: by its ending, else by name, else by what it holds."""
    if source:
        ending = source.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        if ending in ENDINGS:
            return ENDINGS[ending]
        if "." in source.rsplit("/", 1)[-1]:
            return None
    if named:
        return NAMES.get(named.strip().lower())
    if re.search(r"^[ \t]*(?:async[ \t]+)?def \w+\(", text, re.M):
        return "python"
    if re.search(r"^\s*using [\w.]+;|^\s*namespace [\w.]+|^\s*///", text, re.M):
        return "csharp"
    if re.search(r"^\s*(?:import [\w.]+;|package [\w.]+;|(?:public|private|protected) (?:static )?[\w<>\[\], ]+ \w+\([^)]*\)[^;\n]*\{)", text, re.M):
        return "java"
    if re.search(r"^\s*(?:import .* from ['\"]|(?:export )?(?:const|let|function|async function|class) )", text, re.M):
        return "typescript"
    return None


def documented_functions(items: DataFrame, id_col: str, text_col: str, source_col: str, language: str | None = None) -> DataFrame:
    """Functions and methods with real documentation: ``id_col``, ``line_no`` (line of the name, from 1),
    ``type`` (function or method), ``name``, ``signature`` and ``docstring``.

    ``language``: name of a column with the language of files whose source tells none. Rows with null or
    empty text, and files in no language that is read, give no row. A file that does not parse gives what its
    lexer finds. A row that comes again gives its pairs once; a null id stays null. Files are read where they
    lie; only what is found is shuffled.
    """
    kind = items.schema[id_col].dataType.simpleString()
    named = F.col(language) if language and language in items.columns else F.lit(None).cast("string")
    used = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("body"), F.col(source_col).cast("string").alias("source"), named.cast("string").alias("named"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, (body, source, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                known = language_of(source, name, body) if body else None
                if known:
                    found = pairs(body, known)
                    out += found
                    row += [k] * len(found)
            columns = [batch.column(0).take(pa.array(row, type=pa.int64())), pa.array([p.line for p in out], type=pa.int32())]
            columns += [pa.array([getattr(p, c) for p in out], type=pa.string()) for c in ("kind", "name", "signature", "docstring")]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "line_no", "type", "name", "signature", "docstring"])

    found = used.where("body is not null").mapInArrow(extract, f"`{id_col}` {kind}, line_no int, type string, name string, signature string, docstring string")
    return found.dropDuplicates([id_col, "line_no", "name"])
