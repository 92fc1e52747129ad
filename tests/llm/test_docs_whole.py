"""Definitions whose parts are long: nothing about their length may drop them."""

from __future__ import annotations

import time

from retrix.llm import codedocs


def names(text: str, language: str) -> list[str]:
    return [p.name for p in codedocs.pairs(text, language)]


def test_long_type_parameters():
    wide = ", ".join(f"T{k} extends {{ field{k}: string; other: Array<number> }}" for k in range(40))
    assert names(f"/** Reads every part of the input. */\nfunction read<{wide}>(a: T0) {{ return a; }}\n", "typescript") == ["read"]


def test_long_return_annotation():
    inner = ",\n".join(f"    'Part{k}': int" for k in range(30))
    assert names(f'def read(a) -> dict[\n{inner}\n]:\n    """Reads every part of the input."""\n', "python") == ["read"]
    assert names('def read(a) -> int\n    """Reads every part of the input."""\n', "python") == []


def test_words_far_before_a_function():
    assert names("/** Reads every part of the input. */\nexport default async" + " " * 300 + "function read(a) { }\n", "javascript") == ["read"]


def test_unclosed_brackets_take_time_by_length():
    def seconds(lines: int) -> float:
        text = "\n".join(f"function f{k}(a {{ call(" for k in range(lines))
        began = time.perf_counter()
        codedocs.pairs(text, "javascript")
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.2


def test_methods_without_a_result():
    assert names("class A {\n    /** Writes every part of the input. */\n    public void write(int x) { }\n}\n", "java") == ["write"]
    assert names("class A {\n    /// <summary>Writes every part of the input.</summary>\n    void Write(int x) { }\n}\n", "csharp") == ["Write"]
