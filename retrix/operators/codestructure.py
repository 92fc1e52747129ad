"""Structure of source files: symbols, relations and chunks along definitions, read by a lexer in Arrow batches.

Strings and comments are blanked first, so nothing inside them counts. Files are read where they lie.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrix.functions.definitions import KEYWORDS, definitions
from retrix.functions.lexing import Brackets, lex, skip_space

#: Endings of source files and their languages.
ENDINGS = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "cs": "csharp"}
#: Largest chunk that is not divided, size of the parts of a larger one, and lines of a class's head.
LARGEST, PART, HEAD_LINES = 1500, 500, 10
#: By language, the nodes that chunks are made of and those that every chunk has as its context.
BOUNDARIES = {
    "python": ("function", "class", "module"), "javascript": ("function", "class", "arrow"), "typescript": ("function", "class", "method"),
    "csharp": ("method", "class", "property"), "java": ("method", "class", "interface"),
}
CONTEXTS = {
    "python": ("import", "class"), "javascript": ("import", "variable", "function"), "typescript": ("import", "interface", "type"),
    "csharp": ("import", "namespace", "class"), "java": ("package", "import", "class"),
}

_PY_CLASS = re.compile(r"^[ \t]*class[ \t]+(?P<name>\w+)[ \t]*(?P<open>\()?", re.M)
_TYPE = re.compile(r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|partial|readonly|declare)[ \t]+)*(?P<kind>class|interface|enum|record|struct)[ \t]+(?P<name>[\w$]+)(?P<rest>[^{};]*)\{", re.M)
_NAMESPACE = re.compile(r"^[ \t]*namespace[ \t]+(?P<name>[\w.]+)\s*(?P<end>[{;])", re.M)
_TYPE_ALIAS = re.compile(r"^[ \t]*(?:export[ \t]+)?type[ \t]+(?P<name>\w+)[^=\n]*=[^;\n]*;?", re.M)
_VAR = re.compile(r"^[ \t]*var[ \t]+(?P<name>[\w$]+)[^;\n]*;?", re.M)
_PROPERTY = re.compile(r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|abstract|required|readonly|new)[ \t]+)+[\w.<>\[\], ?]+?[ \t]+(?P<name>\w+)\s*\{\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b", re.M)
_PACKAGE = re.compile(r"^[ \t]*package[ \t]+(?P<name>[\w.]+)[ \t]*;", re.M)
_IMPORTS = {
    "python": re.compile(r"^[ \t]*(?:from[ \t]+(?P<module>[\w.]+)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^\n;#]+)|import[ \t]+(?P<plain>[^\n;#]+))", re.M),
    "javascript": re.compile(r"^[ \t]*(?:import\b[^;'\"`]*?(?P<quote>['\"])|(?:const|let|var)\b[^;=\n]*=[ \t]*require\([ \t]*(?P<other>['\"]))", re.M),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<name>[\w.*]+)[ \t]*;", re.M),
    "csharp": re.compile(r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?(?P<name>[\w.]+)[ \t]*;", re.M),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_CALL = re.compile(r"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_BRANCH = re.compile(r"\b(?:if|elif|for|foreach|while|case|catch|except|and|or)\b|&&|\|\||\?(?=[^.?:])")
_WORD = re.compile(r"[\w$]+")


def language_by_ending(source: Column) -> Column:
    ending = F.lower(F.regexp_extract(source, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), "")
    for key, name in ENDINGS.items():
        out = out.when(ending == key, name)
    return out.otherwise("unknown")


@dataclass
class Node:
    """A part of a file; places are those of its text, the end excluded."""

    kind: str
    name: str
    start: int
    end: int
    head: int  # end of what stands before the body
    bases: list[str] = field(default_factory=list)
    parent: Node | None = None


def _block_end(code: str, at: int) -> int:
    """Where the indented block ends whose head begins at ``at``."""
    begin = code.rfind("\n", 0, at) + 1
    depth = len(code[begin:at].expandtabs()) if not code[begin:at].strip() else 0
    last, place = len(code), code.find("\n", at)
    last = place if place >= 0 else len(code)
    while place >= 0:
        stop = code.find("\n", place + 1)
        line = code[place + 1 : stop if stop >= 0 else len(code)]
        if line.strip():
            if len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= depth and not line.lstrip().startswith(")"):
                break
            last = stop if stop >= 0 else len(code)
        place = stop
    return last


def _statement_end(code: str, at: int, brackets: Brackets) -> int:
    """Where a statement ends that goes on at ``at``: at its mark, or with the line, brackets passed over."""
    while at < len(code):
        if code[at] in "([{":
            after = brackets.closing(at)
            if after < 0:
                return len(code)
            at = after
        elif code[at] in ";\n}":
            return at
        else:
            at += 1
    return at


def _bases(text: str, rest: str, language: str) -> list[str]:
    if language == "python":
        return [b.strip() for b in rest.split(",") if b.strip() and "=" not in b]
    rest = re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", rest)
    named = re.sub(r"\b(?:extends|implements|permits)\b", ",", rest) if language != "csharp" else re.sub(r"\bwhere\b.*", "", rest, flags=re.S).partition(":")[2]
    return [w.group() for part in named.split(",") if (w := re.search(r"[\w$.]+", part))]


def outline(text: str, language: str) -> tuple[list[Node], str]:
    """The nodes of a file in order of place, and its text with strings and comments blanked."""
    code, _ = lex(text, language)
    brackets = Brackets(code)
    out: list[Node] = []
    if language == "python":
        for m in _PY_CLASS.finditer(code):
            head = brackets.closing(m.start("open")) if m.group("open") else m.end()
            start = skip_space(code, m.start())
            if head > 0 and code[skip_space(code, head) : skip_space(code, head) + 1] == ":":
                out.append(Node("class", m.group("name"), start, _block_end(code, start), head + 1, _bases(text, code[m.end() : head - 1], language) if m.group("open") else []))
    else:
        for m in _TYPE.finditer(code):
            end = brackets.closing(m.end() - 1)
            kind = m.group("kind") if m.group("kind") in ("interface", "enum") else "class"
            out.append(Node(kind, m.group("name"), skip_space(code, m.start()), end if end > 0 else len(code), m.end(), _bases(text, m.group("rest"), language)))
    extra = {"typescript": [(_TYPE_ALIAS, "type")], "javascript": [(_VAR, "variable")], "csharp": [(_PROPERTY, "property")], "java": [(_PACKAGE, "package")]}.get(language, [])
    for pattern, kind in extra:
        for m in pattern.finditer(code):
            end = m.end()
            if kind == "property":
                end = brackets.closing(code.index("{", m.start("name")))
            out.append(Node(kind, m.group("name"), skip_space(code, m.start()), end if end > 0 else len(code), m.end()))
    for m in _NAMESPACE.finditer(code) if language == "csharp" else ():
        end = brackets.closing(m.end() - 1) if m.group("end") == "{" else len(code)
        out.append(Node("namespace", m.group("name"), skip_space(code, m.start()), end if end > 0 else len(code), m.end()))
    seen = set()
    for d in definitions(code, language, brackets):
        if d.name_at in seen:
            continue
        seen.add(d.name_at)
        start = skip_space(code, d.start)
        kind = "function"
        if language == "python":
            end = _block_end(code, start)
            kind = "async_function" if code.startswith("async", start) else kind
        else:
            at = d.end
            opened = re.compile(r"[^{};\n]*?(?:=>)?\s*\{").match(code, at)
            if opened and code.find("=>", at, opened.end()) < 0 and "=" in code[at : opened.end() - 1]:
                opened = None
            end = brackets.closing(opened.end() - 1) if opened else _statement_end(code, at, brackets)
            end = end if end > 0 else len(code)
            if re.match(r"[^({\n]*[=:]", code[start : d.end].split(d.name, 1)[-1]) and "function" not in code[start : d.end]:
                kind = "arrow"
        out.append(Node(kind, d.name, start, end, d.end))
    for m in _IMPORTS[language].finditer(code):
        start = skip_space(code, m.start())
        if language == "python":
            names = [re.split(r"\s+as\s+", x.strip())[0].strip() for x in re.sub(r"[()]", " ", m.group("names") or m.group("plain")).replace("\\", " ").split(",")]
            module = m.group("module")
            found = [(f"{module}.{x}" if module.strip(".") else x) if module else x for x in names if x]
            end = m.end()
        elif language in ("javascript", "typescript"):
            quote = m.end() - 1
            end = code.find("\n", quote) if code.find("\n", quote) >= 0 else len(code)
            inner = re.match(r"(['\"])([^'\"\n]*)\1", text[quote:end])
            found = [inner.group(2)] if inner and inner.group(2) else []
        else:
            found, end = [m.group("name")], m.end()
        out += [Node("import", x, start, end, end) for x in found]
    out.sort(key=lambda n: (n.start, -n.end))
    stack: list[Node] = []
    for node in out:
        while stack and stack[-1].end <= node.start:
            stack.pop()
        node.parent = stack[-1] if stack else None
        if node.kind == "function" and node.parent is not None and node.parent.kind in ("class", "interface", "enum") or node.kind == "async_function" and node.parent is not None and node.parent.kind == "class":
            node.kind = "method" if node.kind == "function" else node.kind
        if node.end > node.start and node.kind not in ("import", "variable", "type", "package"):
            stack.append(node)
    return out, code


def _lines(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def find_symbols(text: str, language: str) -> list[tuple[str, str, int, int, str | None]]:
    """Kind, name, first and last line (from 1) and enclosing class or function of the nodes of a file."""
    breaks = _lines(text)
    line = lambda place: bisect_right(breaks, place - 1) + 1
    return [(n.kind, n.name, line(n.start), line(max(n.end - 1, n.start)), n.parent.name if n.parent else None) for n in outline(text, language)[0]]


def find_relations(text: str, language: str, path: str) -> list[tuple[str, str, str]]:
    """Type, source and target of the edges of a file. A file is ``file::path``, an import ``import::name``, a class
    ``class::name@file``, a base ``class::name``, a function ``func::name@file``; a call goes from the innermost function
    around it (or the file) to the function of that name in the file, else to ``external::name``."""
    nodes, code = outline(text, language)
    this = f"file::{path}"
    functions = [n for n in nodes if n.kind in ("function", "method", "async_function", "arrow")]
    own = {n.name for n in functions}
    out = set()
    for n in nodes:
        if n.kind == "import":
            out.add(("IMPORTS", this, f"import::{n.name}"))
        elif n.kind in ("class", "interface", "enum"):
            out.add(("CONTAINS", this, f"class::{n.name}@{this}"))
            out |= {("EXTENDS", f"class::{n.name}@{this}", f"class::{b}") for b in n.bases}
        elif n in functions:
            holder = n.parent
            source = f"class::{holder.name}@{this}" if holder is not None and holder.kind in ("class", "interface", "enum") else f"func::{holder.name}@{this}" if holder is not None and holder in functions else this
            out.add(("CONTAINS", source, f"func::{n.name}@{this}"))
    heads = sorted((n.start, n.head) for n in functions)
    starts = [s for s, _ in heads]
    by_start = sorted(functions, key=lambda n: n.start)
    for m in _CALL.finditer(code):
        name = m.group("name").rsplit(".", 1)[-1]
        k = bisect_right(starts, m.start()) - 1
        if name in KEYWORDS or (k >= 0 and heads[k][0] <= m.start() < heads[k][1]) or re.search(r"\b(?:def|class|function|new)\s+$", code[max(0, m.start() - 20) : m.start()]):
            continue
        around = by_start[k] if k >= 0 else None
        while around is not None and not (around.start <= m.start() < around.end):
            around = around.parent
        while around is not None and around not in functions:
            around = around.parent
        source = f"func::{around.name}@{this}" if around is not None else this
        out.add(("CALLS", source, f"func::{name}@{this}") if name in own else ("CALLS_EXTERNAL", source, f"external::{name}"))
    return sorted(out)


def _parent_class(lines: list[str], first: int) -> str:
    """The head of the nearest class that begins before a line."""
    for k in range(min(first, len(lines)) - 1, -1, -1):
        if re.match(r"\s*(?:(?:export|public|private|protected|internal|partial|abstract|final|static|sealed)\s+)*class\s+\w+", lines[k]):
            end = next((j for j in range(k, min(k + HEAD_LINES, len(lines))) if "{" in lines[j] or ":" in lines[j]), k)
            return "\n".join(lines[k : end + 1])
    return ""


def code_chunks(text: str, language: str, part: int = PART, largest: int = LARGEST) -> list[tuple[str, int, int, str, str]]:
    """Kind, first and last line (from 0), content and context of the chunks of a file, along its definitions.

    Chunks of nested definitions overlap. One of more than ``largest`` characters is packed anew by lines into parts of
    about ``part``, whose kind ends in "_part". The context is what the language's chunks all need (imports and the
    like), and for functions and methods the head of the class before them. A file without definitions is packed by
    lines as "basic".
    """
    nodes, _ = outline(text, language)
    lines, breaks = text.split("\n"), _lines(text)
    line = lambda place: bisect_right(breaks, place - 1)
    same = {"async_function": "function"} if language in ("python", "javascript", "typescript") else {"async_function": "method", "function": "method"}
    if language == "python":
        same["method"] = "function"
    kinds = [same.get(n.kind, n.kind) for n in nodes]
    context = "\n".join(dict.fromkeys(text[n.start : n.end] for n, kind in zip(nodes, kinds) if kind in CONTEXTS[language]))
    bounds = sorted({(line(n.start), line(max(n.end - 1, n.start)), kind) for n, kind in zip(nodes, kinds) if kind in BOUNDARIES[language]})
    if "module" in BOUNDARIES[language] and text.strip():
        bounds = [(0, len(lines) - 1, "module"), *bounds]
    out = []
    if not bounds:
        at = 0
        for piece in _packed(lines, part):
            out.append(("basic", at, at + len(piece) - 1, "\n".join(piece), ""))
            at += len(piece)
        return out
    for first, last, kind in bounds:
        own = lines[first : last + 1]
        whole = "\n".join(own)
        around = _parent_class(lines, first) if kind in ("function", "method") else ""
        both = "\n\n".join(x for x in (context, around) if x)
        if len(whole) <= largest:
            out.append((kind, first, last, whole, both))
            continue
        at = first
        for piece in _packed(own, part):
            out.append((f"{kind}_part", at, at + len(piece) - 1, "\n".join(piece), context))
            at += len(piece)
    return out


def _packed(lines: list[str], target: int) -> list[list[str]]:
    """Lines packed until the next one would exceed the target; line ends don't count."""
    out: list[list[str]] = []
    used = 0
    for text in lines:
        if out and used + len(text) <= target:
            out[-1].append(text)
            used += len(text)
        else:
            out.append([text])
            used = len(text)
    return out


def symbol_chunks(text: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """Kind, name, first and last line (from 1) and a description, with signature and code, of every function, method and class."""
    nodes, code = outline(text, language)
    breaks = _lines(text)
    line = lambda place: bisect_right(breaks, place - 1) + 1
    out = []
    for n in nodes:
        kind = {"async_function": "function", "arrow": "function"}.get(n.kind, n.kind)
        if kind not in ("function", "method", "class"):
            continue
        body = text[n.start : n.end]
        calls = list(dict.fromkeys(m.group("name").rsplit(".", 1)[-1] for m in _CALL.finditer(code, n.head, n.end)))
        calls = [c for c in calls if c not in KEYWORDS][:5]
        doc = re.match(r"\s*(?:\x27{3}|\x22{3})(.*?)(?:\x27{3}|\x22{3})", text[n.head : n.end], re.S) if language == "python" else None
        first, last = line(n.start), line(max(n.end - 1, n.start))
        notes = [f"Complexity: {1 + len(_BRANCH.findall(code, n.start, n.end))}", f"Line: {first}-{last}", *([f"Dependencies: {', '.join(calls)}"] if calls else [])]
        parts = [f"# {kind.title()}: {n.name}", "Signature: " + " ".join(text[n.start : n.head].split()).rstrip(" {:=>")]
        parts += [f"Documentation: {doc.group(1).strip()}"] if doc else []
        out.append((kind, n.name, first, last, "\n".join([*parts, "\nCode:", body, "\nMetadata: " + " | ".join(notes)])))
    return out


def _per_file(items: DataFrame, id_col: str, text_col: str, source_col: str, find, schema: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, (text, language, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                own = find(text, language, path)
                found += own
                row += [k] * len(own)
            columns = [pa.array([x[c] for x in found], type=t) for c, (_, _, t) in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, type=pa.int64())), *columns], names=["id", *(name for name, _, _ in schema)])

    used = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), language_by_ending(F.col(source_col)).alias("language"), F.col(source_col).cast("string").alias("path"))
    used = used.where("body IS NOT NULL AND language <> 'unknown'")
    return used.mapInArrow(run, f"id {items.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{name} {kind}" for name, kind, _ in schema)).distinct()


_TEXT, _INT = ("string", pa.string()), ("int", pa.int32())


def symbols(items: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``kind``, ``name``, ``line``, ``end_line`` and ``parent`` of the symbols of every source file; null texts
    and other files have none, and a row that comes again gives its own once."""
    return _per_file(items, id_col, text_col, source_col, lambda t, l, p: find_symbols(t, l), [("kind", *_TEXT), ("name", *_TEXT), ("line", *_INT), ("end_line", *_INT), ("parent", *_TEXT)])


def relations(items: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``type``, ``src``, ``dst`` of the edges of every source file."""
    return _per_file(items, id_col, text_col, source_col, find_relations, [("type", *_TEXT), ("src", *_TEXT), ("dst", *_TEXT)])


def chunks(items: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``kind``, ``start_line``, ``end_line``, ``chunk`` and ``context`` of the chunks of every source file."""
    return _per_file(items, id_col, text_col, source_col, lambda t, l, p: code_chunks(t, l), [("kind", *_TEXT), ("start_line", *_INT), ("end_line", *_INT), ("chunk", *_TEXT), ("context", *_TEXT)])


def described(items: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``kind``, ``name``, ``line``, ``end_line`` and ``chunk``, one for every function, method and class."""
    return _per_file(items, id_col, text_col, source_col, lambda t, l, p: symbol_chunks(t, l), [("kind", *_TEXT), ("name", *_TEXT), ("line", *_INT), ("end_line", *_INT), ("chunk", *_TEXT)])
