"""Strings, comments and brackets of source files."""

from __future__ import annotations

import re

#: File endings and names of the languages that are read.
ENDINGS = {
    "py": "python", "pyi": "python", "pyw": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "java": "java",
    "cs": "csharp",
}
NAMES = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "java": "java", "csharp": "csharp", "c#": "csharp", "cs": "csharp"}

_PYTHON = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<string>(?P<prefix>\b[rRuUbBfF]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)))""",
    re.S,
)
_CURLY = {
    "javascript": re.compile(
        r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>`(?:[^`\\]|\\.)*(?:`|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))|(?P<regex>(?<=[=(,:;!&|?{}\[])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)""",
        re.S,
    ),
    "java": re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))""", re.S),
    "csharp": re.compile(
        r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\$*\"\"\".*?(?:\"\"\"|\Z)|(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)|\$?"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))""",
        re.S,
    ),
}
_CURLY["typescript"] = _CURLY["javascript"]
_INSIDE = re.compile(r"[^\n]")


_SPACE = re.compile(r"\s*")


def skip_space(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def lex(text: str, language: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with strings and comments blanked (same length and lines), and their spans by kind."""
    pattern = _PYTHON if language == "python" else _CURLY[language]
    parts, spans, at = [], [], 0
    for found in pattern.finditer(text):
        start, end = found.span()
        kind = found.lastgroup if found.lastgroup != "prefix" else "string"
        kind = "comment" if found.group("comment") is not None else kind
        spans.append((start, end, "comment" if kind == "comment" else "string"))
        parts.append(text[at:start])
        blank = _INSIDE.sub(" ", text[start:end])
        parts.append(blank if kind == "comment" or not blank else '"' + blank[1:])
        at = end
    parts.append(text[at:])
    return "".join(parts), spans


_BRACKET = re.compile(r"[()\[\]{}]")
_ANGLE = re.compile(r"<|(?<!=)>|[;(\[{)\]}]")


class Brackets(dict):
    """Places after the closing brackets, by those of the opening ones; all of a file in one pass."""

    def __init__(self, code: str):
        super().__init__()
        self.code = code
        opened: list[int] = []
        for found in _BRACKET.finditer(code):
            if found.group() in "([{":
                opened.append(found.start())
            elif opened:
                self[opened.pop()] = found.end()

    def closing(self, at: int) -> int:
        """Place after the bracket that closes the one at ``at``, or -1."""
        return self.get(at, -1)

    def arguments(self, at: int) -> int:
        """Place after the parameter list that begins at ``at`` or after type parameters there, or -1."""
        code = self.code
        if code[at : at + 1] == "<":
            depth = 0
            while found := _ANGLE.search(code, at):
                if found.group() in "([{":
                    at = self.closing(found.start())
                    if at < 0:
                        return -1
                    continue
                if found.group() not in "<>":
                    return -1
                at = found.end()
                depth += 1 if found.group() == "<" else -1
                if depth == 0:
                    at = skip_space(code, at)
                    break
        return self.closing(at) if code[at : at + 1] == "(" else -1
