"""Definitions of functions in source files whose strings and comments are blanked."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from retrix.functions.lexing import Brackets, skip_space

#: Words that stand before a bracket without naming a function.
KEYWORDS = frozenset(
    "if else for foreach while do switch case catch try finally with return throw new await yield typeof instanceof delete void in of function "
    "lock using fixed checked unchecked sizeof nameof when where assert synchronized super this base import export default package goto import throws "
    "and or not is elif except lambda print del raise pass break continue from global nonlocal".split()
)

_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*(?=\()", re.M)
_MODIFIER = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|readonly|synchronized|native|default|strictfp|extern|unsafe|partial|new|export|declare|accessor|get|set)\s+)"
_JS_NAMED = re.compile(r"\bfunction\b\s*\*?\s*(?P<name>[\w$]+)\s*(?=[<(])")
_JS_BEFORE = frozenset(("export", "default", "declare", "async"))
_JS_VALUE = re.compile(
    r"^[ \t]*+(?:export\s+)?(?:default\s+)?(?:const\s+|let\s+|var\s+|" + _MODIFIER + r"+)?(?:[\w$]+\.)*(?P<name>\#?[\w$]+)[ \t]*(?::[^=;,(){}\n]+)?(?:=|:)(?![=>])[ \t]*(?:async\s+|async(?=\())?(?P<value>function\b\s*\*?|(?=[(<])|[\w$]+\s*=>)", re.M
)
_JS_METHOD = re.compile(r"^[ \t]*+(?:@[\w.]+(?:\([^)\n]*\))?[ \t]+)*+" + _MODIFIER + r"*+(?:\*[ \t]*+)?(?P<name>\#?[\w$]++)[ \t]*+\??(?=[<(])", re.M)
_TYPE = r"[\w.]+(?:\s*<[^;(){}=]*?>)?(?:\s*\[[\s,]*\])*\??"
_TYPED = re.compile(r"^[ \t]*+(?:@[\w.]+(?:\([^)\n]*\))?[ \t]+|\[[^\]\n]*\][ \t]*)*(?P<mods>" + _MODIFIER + r"*)(?:<[^;(){}=]*?>\s+)?(?P<type>" + _TYPE + r")\s+(?P<name>\w+)\s*(?:<[^;(){}=]*?>\s*)?(?=\()", re.M)
_BUILT = re.compile(r"^[ \t]*+(?P<mods>" + _MODIFIER + r"+)(?P<name>\w+)\s*(?=\()", re.M)
_TYPED_VALUE = re.compile(r"^[ \t]*+" + _MODIFIER + r"*(?P<type>" + _TYPE + r")\s+(?P<name>\w+)\s*=\s*(?:async\s+)?(?P<value>(?=\()|\w+\s*[-=]>)", re.M)
#: What ends a return annotation or opens a part of it.
_ANNOTATED = re.compile(r"[:;\n(\[{]")


def _words_before(code: str, at: int) -> int:
    """Where the words begin that belong to the function at ``at``."""
    while True:
        end = at
        while end and code[end - 1].isspace():
            end -= 1
        begin = end
        while begin and code[begin - 1].isalpha():
            begin -= 1
        if begin == end or end == at or code[begin:end] not in _JS_BEFORE:
            return at
        at = begin


@dataclass(frozen=True)
class Definition:
    start: int
    name_at: int
    end: int
    name: str


def _python_definitions(code: str, brackets: Brackets) -> Iterator[Definition]:
    for found in _PY_DEF.finditer(code):
        end = brackets.closing(found.end())
        if end < 0:
            continue
        at = skip_space(code, end)
        if code.startswith("->", at):  # an annotation goes on to the first colon outside brackets
            while mark := _ANNOTATED.search(code, at):
                at = mark.end() if mark.group() not in "([{" else brackets.closing(mark.start())
                if at < 0 or mark.group() in ":\n;":
                    break
            at = mark.start() if mark and at >= 0 else len(code)
        if code[at : at + 1] == ":":
            yield Definition(found.start(), found.start("name"), at + 1, found.group("name"))


def _script_definitions(code: str, typed: bool, brackets: Brackets) -> Iterator[Definition]:
    body = re.compile(r"\s*(?::\s*[^;{}=]+?(?:\{[^{}]*\}[^;{}=]*?)?)?\s*\{") if typed else re.compile(r"\s*\{")
    arrow = re.compile(r"\s*(?::\s*[^;={}]+?(?:\{[^{}]*\}[^;={}]*?)?)?\s*=>")
    for found in _JS_NAMED.finditer(code):
        end = brackets.arguments(found.end())
        if end > 0 and found.group("name") not in KEYWORDS:
            yield Definition(_words_before(code, found.start()), found.start("name"), end, found.group("name"))
    for found in _JS_VALUE.finditer(code):
        value, end = found.group("value"), found.end()
        if found.group("name") in KEYWORDS:
            continue
        if value.startswith("function"):
            end = skip_space(code, end)
            name = re.compile(r"[\w$]*\s*").match(code, end)
            end = brackets.arguments(name.end())
            if end > 0:
                yield Definition(found.start(), found.start("name"), end, found.group("name"))
        elif value:
            yield Definition(found.start(), found.start("name"), end, found.group("name"))
        else:
            end = brackets.arguments(end)
            if end > 0 and (arrived := arrow.match(code, end)):
                yield Definition(found.start(), found.start("name"), arrived.end() - 2, found.group("name"))
    for found in _JS_METHOD.finditer(code):
        if found.group("name") in KEYWORDS:
            continue
        end = brackets.arguments(found.end())
        if end > 0 and (opened := body.match(code, end)):
            yield Definition(found.start(), found.start("name"), opened.end() - 1, found.group("name"))


def _typed_definitions(code: str, language: str, brackets: Brackets) -> Iterator[Definition]:
    tail = re.compile(r"\s*(?:throws\s+[\w.,\s<>]+?|:\s*(?:base|this)\s*\([^)]*\)|where\s+[^{;]+?)?\s*(?P<body>\{|=>|;|default\b)")
    for pattern in (_TYPED, _BUILT):
        for found in pattern.finditer(code):
            if found.group("name") in KEYWORDS or (pattern is _TYPED and found.group("type").split("<")[0].split("[")[0] in KEYWORDS - {"void"}):
                continue
            end = brackets.closing(found.end())
            if end > 0 and (after := tail.match(code, end)) and (after.group("body") != "=>" or language == "csharp"):
                yield Definition(found.start(), found.start("name"), after.start("body"), found.group("name"))
    for found in _TYPED_VALUE.finditer(code):
        if found.group("type") in KEYWORDS - {"void"}:
            continue
        end = found.end()
        if not found.group("value"):
            end = brackets.closing(end)
            if end < 0 or not re.compile(r"\s*[-=]>").match(code, end):
                continue
        yield Definition(found.start(), found.start("name"), end, found.group("name"))


def definitions(code: str, language: str, brackets: Brackets) -> list[Definition]:
    """The functions and methods of a file, lambda-valued named ones included; some may come twice."""
    if language == "python":
        return list(_python_definitions(code, brackets))
    if language in ("javascript", "typescript"):
        return list(_script_definitions(code, language == "typescript", brackets))
    return list(_typed_definitions(code, language, brackets))
