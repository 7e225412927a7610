"""Code chunking and Python edges on small sources, and against the standard parser."""

import ast
import glob
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import script_noise
from tessera.operators import chunk_code, chunk_docs, graph_extract
from tessera.plans import ingest
from tessera.sources import git_records

PY_BASIC = '''"""Doc of the module, long enough."""
import os
from a.b import c
from . import x
from .pkg.mod import y

@deco
def first(a,
          b):
    """Doc f."""
    return helper(a)


class Job(Base, other.Thing):
    """Class doc, which is long enough to keep."""
    limit = 2

    @property
    def size(self):
        return 1

    async def run(self):
        # note
        return first(1)


async def helper(x):
    return print(x)
'''
JS_MIXED = '''import React from 'react'
const fs = require('fs')
export function foo(x) {
  if (x) { return "}" }
  return 2
}
export default class K extends B {
  async run(a) {
    return a
  }
  static make() { return new K() }
}
const arrow = async (x) => {
  return x
}
const one = x => x + 1;
'''
GO_TYPES = '''package main

import "fmt"

type S struct {
	A int
}

func (s *S) Method(x int) int {
	return x
}

func main() {
	fmt.Println("}")
}
'''


def chunks(spark, source, grammar="python"):
    df = spark.createDataFrame([("f", grammar, source)], "fid string, grammar string, content string")
    rows = chunk_code.code_chunks(df).orderBy(F.coalesce("start_line", F.lit(0))).collect()
    return {(r["chunk_type"], r["class_name"], r["function_name"]): r for r in rows}


def spans(found):
    return {k: (r["start_line"], r["end_line"]) for k, r in found.items()}


def test_python(spark):
    found = chunks(spark, PY_BASIC)
    assert spans(found) == {
        ("module_header", None, None): (None, None), ("function", None, "first"): (7, 11), ("class", "Job", None): (14, 21),
        ("method", "Job", "size"): (18, 20), ("method", "Job", "run"): (22, 24), ("function", None, "helper"): (27, 28)}
    assert found[("function", None, "first")]["signature"] == "@deco\ndef first(a,\n          b):"
    assert found[("module_header", None, None)]["text"].startswith('"""Doc of the module')


def test_large_python_function_is_indexed_whole(spark):
    source = 'def big(a):\n    """Says what it does."""\n' + "".join(f"    x{i} = {i}\n" for i in range(149))
    r = chunks(spark, source)[("function", None, "big")]
    assert r["large_function"] and r["text"] == source.strip() and r["full_body"] is None
    small = chunks(spark, source.rsplit("    x148", 1)[0])[("function", None, "big")]
    assert not small["large_function"] and small["full_body"] is None


def test_scripts_and_unreadable_files_fall_back_to_windows(spark):
    long = "".join(f"value_{i} = {i}\n" for i in range(120))
    assert spans(chunks(spark, 'x = """open\n' + long)) == {("function", None, None): (81, 121)}
    assert list(chunks(spark, "fn main() {\n  println!(\"a long enough line\");\n}\n", "rust")) == [("whole_doc", None, None)]
    # A script without definitions is all header.
    assert list(chunks(spark, long)) == [("module_header", None, None)]


def test_known_misses_of_the_line_method(spark):
    # A triple quote inside a string flips the state of the rest of the file; an even number hides a function.
    hidden = "a = '\"\"\"'\n\ndef seen():\n    return 111111\n"
    assert ("function", None, "seen") in chunks(spark, hidden)
    one_line = graph_extract.python_edges(_files(spark, "import a; import b\n"))
    assert [r["to_raw"] for r in one_line.collect()] == ["python::a"]


def test_javascript(spark):
    found = chunks(spark, JS_MIXED, "javascript")
    assert {k: v for k, v in spans(found).items() if k[0] != "module_header"} == {
        ("function", None, "foo"): (3, 6), ("method", "K", "run"): (8, 10), ("method", "K", "make"): (11, 11),
        ("class", "K", None): (7, 12), ("function", None, "arrow"): (13, 15), ("function", None, "one"): (16, 16)}


def test_go(spark):
    found = chunks(spark, GO_TYPES, "go")
    assert {k: v for k, v in spans(found).items() if k[0] != "module_header"} == {
        ("class", None, None): (5, 7), ("function", None, "Method"): (9, 11), ("function", None, "main"): (13, 15)}


def _files(spark, source, path="pkg/a.py"):
    return spark.createDataFrame([("t::r::main::" + path, "r::main::" + path, "r::main", source)], "fid string, file_raw string, branch_raw string, content string")


def test_python_edges(spark):
    edges = {(r["rel_type"], r["from_raw"].split("::", 3)[-1], r["to_raw"].split("::", 3)[-1] if r["to_raw"].startswith("r::") else r["to_raw"])
             for r in graph_extract.python_edges(_files(spark, PY_BASIC)).collect()}
    assert ("IMPORTS", "r::main::pkg/a.py".split("::", 2)[-1], "python::os") in {(a, b, c) for a, b, c in edges}
    assert {e for e in edges if e[0] == "CALLS"} == {
        ("CALLS", "func::first", "func::helper"), ("CALLS", "func::run", "func::first"), ("CALLS", "func::helper", "func::print")}
    assert {e for e in edges if e[0] == "INHERITS_FROM"} == {("INHERITS_FROM", "class::Job", "class::Base")}
    assert {c for a, b, c in edges if a == "IMPORTS"} == {"python::os", "python::a", "pkg/mod"}


@pytest.fixture(scope="module")
def library():
    """Modules of the standard library, of every size up to the indexing limit."""
    paths = sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))
    sources = {}
    for p in paths[::4]:
        with open(p, encoding="utf8", errors="replace") as f:
            sources[os.path.basename(p)] = f.read()
    return sources


def expected_blocks(source):
    out = set()
    for node in ast.parse(source).body:
        first = lambda n: min([n.lineno] + [d.lineno for d in n.decorator_list])
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.add((None, node.name, first(node), node.end_lineno))
        elif isinstance(node, ast.ClassDef):
            out |= {(node.name, m.name, first(m), m.end_lineno) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))}
    return out


def test_blocks_against_the_standard_parser(spark, library):
    df = spark.createDataFrame([(n, "python", s) for n, s in library.items()], "fid string, grammar string, content string")
    rows = chunk_code.code_chunks(df).where(F.col("chunk_type").isin("function", "method") & (F.col("chunking") == "block")).collect()
    got = {(r["fid"], r["class_name"], r["function_name"], r["start_line"], r["end_line"]) for r in rows}
    want = {(n, *b) for n, s in library.items() for b in expected_blocks(s)}
    assert len(want) > 500
    equal = len(got & want) / len(want)
    print("equal blocks", len(got & want), "of", len(want))
    assert equal > 0.95
    shifted = {(n, c, f, a + 1, b + 1) for n, c, f, a, b in want}
    assert not got & shifted or len(got & shifted) < 0.01 * len(want)


def test_imports_against_the_standard_parser(spark, library):
    rows = [("t::" + n, n, "r", s) for n, s in library.items()]
    df = spark.createDataFrame(rows, "fid string, file_raw string, branch_raw string, content string")
    got = {(r["from_raw"], r["to_raw"][8:]) for r in graph_extract.python_edges(df).where("rel_type = 'IMPORTS' and to_label = 'Module'").collect()}
    want = set()
    for n, s in library.items():
        for node in ast.walk(ast.parse(s)):
            if isinstance(node, ast.Import):
                want |= {(n, a.name.split(".")[0]) for a in node.names}
            elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                want.add((n, node.module.split(".")[0]))
    print("equal imports", len(got & want), "of", len(want))
    assert len(got & want) / len(want) > 0.95


NESTED = [
    ("const a = `x ${ `b { ${a}` } c`; function f(x) { return 1 }", "const a =  a ; function f(x) { return 1 }"),
    ("const p = <p>Don't (say</p>; g();", "const p = ; g();"),
    ("return <div a={x > 1 ? {b: '('} : `)`} c=\"]\">{l.map(i => <li key={i}>{i} (</li>)} ] it's<br/> <></> </div>;", "return x > 1 ? {b: } : l.map(i => ii);"),
    ("if (a < b && c > d) { x = a / b / c; }", "if (a < b && c > d) { x = a / b / c; }"),
    ("const r = /[{(]/g.test(s) ? '}' : \"{\"; // {{{", "const r = .test(s) ?  : ; "),
    ("/* (\n( */ return /x\\/(/.exec(y)", "\n return .exec(y)"),
    ("const f = <T,>(x: T) => { return x < 3 }", "const f = <T,>(x: T) => { return x < 3 }"),
    ("x = 'never closed (\ny = {}", "x = \ny = {}"),
    ("f(<A.B c='{' {...d}>text {/* ( */}\n</A.B>)", "f(...d\n)"),
    ("`a${`b${`c", ""),
    ("", ""),
]


@pytest.mark.parametrize("text, want", NESTED)
def test_scripts_without_noise(text, want):
    assert script_noise.bare_script(text) == want


@given(st.text(alphabet="`${}<>/ab'\"\\()[] =\n*", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_script_keeps_its_lines(text):
    assert script_noise.bare_script(text).count("\n") == text.count("\n")


def test_plain_typescript_has_no_elements():
    assert script_noise.bare_script("const a = <T>b; f(a < b)", elements=False) == "const a = <T>b; f(a < b)"


def test_a_registered_chunker_takes_its_language(spark, monkeypatch):
    monkeypatch.setattr(ingest, "_CHUNKERS", {})
    ingest.register_chunker("python", lambda text: chunk_docs.whole_parts(F.concat(F.lit("mine: "), text)))
    rows = [("u", False, "r", "main", "c", p, 1, None, "def f():\n    return 1\n") for p in ("a.py", "b.go")]
    chunks = ingest.chunk_files(ingest.prepare_files(spark.createDataFrame(rows, schemas.FILES)), "run", 1)
    assert {(r["file_path"], r["text"].startswith("mine: ")) for r in chunks.collect()} == {("a.py", True), ("b.go", False)}


def test_pull_request_dumps(spark, tmp_path):
    (tmp_path / "prs.json").write_text('{"number": 7, "title": "Fix", "state": "closed", "merged_at": "2024-01-01", "head": {"ref": "x"}, "labels": [{"name": "a"}]}\n{"number": 8}\n')
    (tmp_path / "files.json").write_text('{"pr_number": 7, "filename": "a.py", "status": "added", "additions": 3, "deletions": 0}\n')
    prs = git_records.read_pull_requests(spark, str(tmp_path / "prs.json")).orderBy("number").collect()
    assert [(r["number"], r["state"], r["merged_at"]) for r in prs] == [(7, "closed", "2024-01-01"), (8, None, None)] and prs[0]["head"]["ref"] == "x"
    assert git_records.read_pr_files(spark, str(tmp_path / "files.json")).first()["filename"] == "a.py"


def test_lines_are_neither_moved_nor_sorted(spark):
    files = spark.createDataFrame([("a", "python", "def f(x):\n    return x\n"), ("b", "go", "func F() {\n}\n"), ("c", "python", "x = '''\n")], "fid string, grammar string, content string")
    found = chunk_code.code_chunks(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Sort"))
    assert sorted((r["fid"], r["chunk_type"], r["function_name"], r["start_line"], r["end_line"]) for r in found.where("chunking = 'block'").collect()) == [
        ("a", "function", "f", 1, 2), ("b", "function", "F", 1, 2)]
    assert found.where("fid = 'c'").select("text").first()[0] == "x = '''"


def test_a_file_is_worked_on_once_for_blocks_and_windows(spark):
    js = "function f(a) {\n  return `{${a}`; // }\n}\n"
    rows = [("js", "javascript", js), ("go", "go", "func F() {\n\tx := `{\\`\r\n}\n"), ("plain", "javascript", "x = 1;\n" * 101), ("open", "go", "func F() {\n"), ("blank", "tsx", " \n"),
            ("other", "rust", "fn f() {}\n"), ("none", None, "text"), ("null", "go", None), ("py", "python", "def f():\n    return 1\n"), ("ends", "javascript", "a\x0bb\u2028" + js)]
    found = chunk_code.code_chunks(spark.createDataFrame(rows, "fid string, grammar string, content string"))
    got = sorted((r["fid"], r["chunk_type"], r["start_line"] or 0, r["end_line"] or 0, r["chunking"]) for r in found.collect())
    assert got == [("ends", "function", 3, 5, "block"), ("ends", "module_header", 0, 0, "block"), ("go", "function", 1, 3, "block"), ("js", "function", 1, 3, "block"),
                   ("none", "whole_doc", 1, 1, "whole"), ("open", "whole_doc", 1, 1, "whole"), ("other", "whole_doc", 1, 1, "whole"), ("plain", "module_header", 0, 0, "block"), ("py", "function", 1, 2, "block")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("text, want", [
    ("a := `{\\` + \"}\\\"{\" // {\nb", "a :=  +  \nb"),
    ("/* { * \r\n **/ x '\\'' y", "\r\n x  y"),
    ("`{\n\u2028` /* open {", "\n\u2028 /* open {"),
])
def test_go_without_noise(text, want):
    assert script_noise.bare_go(text) == want
