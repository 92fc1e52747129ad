"""Symbols, relations and chunks of source files in five languages."""

from __future__ import annotations

import pytest

from retrix.operators import codestructure as C

PYTHON = '''import os, sys as s
from a.b import (c, d as e)

class A(Base, metaclass=M):
    """doc class X: no def fake():"""
    def run(self, x):
        if x and y:
            return helper(x)

    async def go(self):
        await self.run(1)

def helper(x):
    def inner(): return os.getcwd()
    return inner()
# def commented(): pass
'''
TYPESCRIPT = """import { a } from "./x";
import React from 'react';
export interface P extends Q<R>, S { x: number; }
type T = string | number;
export class K extends Base implements P {
  constructor(private a: string) { super(); this.load(); }
  async load(x: number): Promise<void> { if (x > 1) { fetch(x); } }
}
export const each = (xs: number[]): number => { return top(xs); };
const short = x => top(x);
function top(xs) { return xs[0]; }
const text = `class No extends None {}`;
"""
JAVA = """package a.b;
import java.util.List;
public class A extends B implements C, D {
    @Override
    public static List<String> count(Map<String, Double> m)
    {
        for (int i : m) { call(i); }
        return null;
    }
    private void one() { count(null); }
}
"""
CSHARP = """using System.Text;
namespace N {
public class A : B, IC {
    public int Count { get; set; }
    internal bool Has(int x) => true;
    public void Go() { Has(1); Console.WriteLine("x"); }
}
}
"""
JAVASCRIPT = """const fs = require('fs');
var old = 1;
class K { read(path) { return fs.readFile(path); } }
const two = function (a) { return a; };
"""

SYMBOLS = {
    "python": [
        ("import", "os", 1, 1, None), ("import", "sys", 1, 1, None), ("import", "a.b.c", 2, 2, None), ("import", "a.b.d", 2, 2, None), ("class", "A", 4, 11, None),
        ("method", "run", 6, 8, "A"), ("async_function", "go", 10, 11, "A"), ("function", "helper", 13, 15, None), ("function", "inner", 14, 14, "helper"),
    ],
    "typescript": [
        ("import", "./x", 1, 1, None), ("import", "react", 2, 2, None), ("interface", "P", 3, 3, None), ("type", "T", 4, 4, None), ("class", "K", 5, 8, None), ("method", "constructor", 6, 6, "K"),
        ("method", "load", 7, 7, "K"), ("arrow", "each", 9, 9, None), ("arrow", "short", 10, 10, None), ("function", "top", 11, 11, None),
    ],
    "java": [("package", "a.b", 1, 1, None), ("import", "java.util.List", 2, 2, None), ("class", "A", 3, 11, None), ("method", "count", 5, 9, "A"), ("method", "one", 10, 10, "A")],
    "csharp": [("import", "System.Text", 1, 1, None), ("namespace", "N", 2, 8, None), ("class", "A", 3, 7, "N"), ("property", "Count", 4, 4, "A"), ("method", "Has", 5, 5, "A"), ("method", "Go", 6, 6, "A")],
    "javascript": [("import", "fs", 1, 1, None), ("variable", "old", 2, 2, None), ("class", "K", 3, 3, None), ("function", "two", 4, 4, None)],
}
TEXTS = {"python": PYTHON, "typescript": TYPESCRIPT, "java": JAVA, "csharp": CSHARP, "javascript": JAVASCRIPT}


@pytest.mark.parametrize("language", list(TEXTS))
def test_symbols(language):
    found = C.find_symbols(TEXTS[language], language)
    wanted = SYMBOLS[language]
    assert [x for x in found if x[1] != "read"] == wanted


def test_relations():
    found = set(C.find_relations(PYTHON, "python", "m.py"))
    assert found == {
        ("CALLS", "func::go@file::m.py", "func::run@file::m.py"), ("CALLS", "func::helper@file::m.py", "func::inner@file::m.py"), ("CALLS", "func::run@file::m.py", "func::helper@file::m.py"),
        ("CALLS_EXTERNAL", "func::inner@file::m.py", "external::getcwd"), ("CONTAINS", "class::A@file::m.py", "func::go@file::m.py"), ("CONTAINS", "class::A@file::m.py", "func::run@file::m.py"),
        ("CONTAINS", "file::m.py", "class::A@file::m.py"), ("CONTAINS", "file::m.py", "func::helper@file::m.py"), ("CONTAINS", "func::helper@file::m.py", "func::inner@file::m.py"),
        ("EXTENDS", "class::A@file::m.py", "class::Base"), ("IMPORTS", "file::m.py", "import::a.b.c"), ("IMPORTS", "file::m.py", "import::a.b.d"), ("IMPORTS", "file::m.py", "import::os"), ("IMPORTS", "file::m.py", "import::sys"),
    }
    kinds = lambda text, language: {(t, a.split("@")[0], b.split("@")[0]) for t, a, b in C.find_relations(text, language, "f") if t != "CONTAINS"}
    assert kinds(TYPESCRIPT, "typescript") == {
        ("CALLS", "func::constructor", "func::load"), ("CALLS", "func::each", "func::top"), ("CALLS", "func::short", "func::top"), ("CALLS_EXTERNAL", "func::load", "external::fetch"), ("EXTENDS", "class::K", "class::Base"),
        ("EXTENDS", "class::K", "class::P"), ("EXTENDS", "class::P", "class::Q"), ("EXTENDS", "class::P", "class::S"), ("IMPORTS", "file::f", "import::./x"), ("IMPORTS", "file::f", "import::react"),
    }
    assert ("EXTENDS", "class::A", "class::D") in kinds(JAVA, "java") and ("CALLS", "func::one", "func::count") in kinds(JAVA, "java")
    assert {("EXTENDS", "class::A", "class::B"), ("EXTENDS", "class::A", "class::IC"), ("CALLS", "func::Go", "func::Has")} <= kinds(CSHARP, "csharp")


def test_chunks_follow_definitions_and_keep_their_context():
    found = C.code_chunks(PYTHON, "python")
    assert [(kind, first, last) for kind, first, last, _, _ in found] == [("module", 0, 16), ("class", 3, 10), ("function", 5, 7), ("function", 9, 10), ("function", 12, 14), ("function", 13, 13)]
    assert all(context.startswith("import os, sys as s\nfrom a.b import (c, d as e)") for *_, context in found)
    assert found[2][4].endswith("class A(Base, metaclass=M):")
    assert [x[0] for x in C.code_chunks(CSHARP, "csharp")] == ["class", "property", "method", "method"]
    long = "def f(x):\n" + "\n".join(f"    x = x + {k:05d}" for k in range(200)) + "\n"
    parts = [x for x in C.code_chunks(long, "python") if x[0] == "function_part"]
    assert parts[0][1] == 0 and parts[-1][2] == 200 and all(a[2] + 1 == b[1] for a, b in zip(parts, parts[1:])) and all(len(x[3].replace("\n", "")) <= C.PART for x in parts)
    assert "\n".join(x[3] for x in parts) == long.rstrip("\n")
    assert [x[0] for x in C.code_chunks("x = 1;\ny = 2;", "java")] == ["basic"]


def test_symbol_chunks():
    found = C.symbol_chunks(PYTHON, "python")
    assert [(x[0], x[1]) for x in found] == [("class", "A"), ("method", "run"), ("function", "go"), ("function", "helper"), ("function", "inner")]
    assert found[0][4].startswith("# Class: A\nSignature: class A(Base, metaclass=M)\nDocumentation: doc class X: no def fake():\n\nCode:\nclass A")
    assert found[1][4].endswith("Metadata: Complexity: 3 | Line: 6-8 | Dependencies: helper")


def test_odd_rows(spark):
    rows = [(1, None, "a.py"), (2, "", "a.py"), (3, "def f(:\n  class", "a.py"), (4, PYTHON, None), (5, PYTHON, "a.txt"), (6, "((((" * 2000, "a.js"), (None, "def f(): pass", "a.py"), (7, "def f(): pass", "a.py"), (7, "def f(): pass", "a.py")]
    df = spark.createDataFrame(rows, "k long, t string, s string").selectExpr("*", "1 AS id", "'x' AS kind", "'y' AS path")
    assert {(r["id"], r["name"]) for r in C.symbols(df, "k", "t", "s").collect()} == {(None, "f"), (7, "f")}
    assert C.relations(df, "k", "t", "s").where("id = 7").count() == 1
    assert C.chunks(df, "k", "t", "s").where("id = 7").count() == 2
    assert C.described(df, "k", "t", "s").where("id = 7").count() == 1
    assert C.symbols(df.where("false"), "k", "t", "s").count() == 0
