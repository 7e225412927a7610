"""Fixed examples of the column functions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import config_text, identity, redact, report, routing, terms, text
from tessera.operators import chunk_docs, graph_extract, graph_git, hybrid, sparse, stats


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("joined, expected", [
    ("u1::org/app::main::docs/a.md::section::Intro", "e87efe9c-95c2-2b3b-d3de-6442dddaadcb"),
    ("u1::org/app::main::src/a.py::method::run::Job::12", "5df71885-3029-c45a-eb07-f43eda4aa7c8"),
    ("public::org/app::main::issue_7::whole_doc::issue7", "b670ea3b-bd03-3aae-fe74-ed3d276a74c4"),
])
def test_identity_rendering(spark, joined, expected):
    assert one(spark, identity.as_uuid(F.md5(F.lit(joined).cast("binary")))) == expected


def test_chunk_identity_skips_absent_parts(spark):
    ddl = ("user_id string, is_public boolean, repo string, branch string, file_path string, chunk_type string, function_name string, "
           "class_name string, section_title string, start_line int, issue_number int, pr_number int")
    rows = spark.createDataFrame([
        ("u1", False, "org/app", "main", "src/a.py", "method", "run", "Job", "", 12, None, None),
        (None, True, "org/app", "main", "issue_7", "whole_doc", None, None, None, None, 7, None),
    ], ddl)
    got = [r["x"] for r in rows.select(identity.chunk_identity().alias("x")).collect()]
    assert got == ["u1::org/app::main::src/a.py::method::run::Job::12", "public::org/app::main::issue_7::whole_doc::issue7"]


def test_sparse_vector(spark):
    df = spark.createDataFrame([(1, "Get user, get_user(x) GET!"), (2, "foo getuser x1 überallé 中文")], "qid long, text string")
    got = {(r["qid"], r["term_idx"]): (r["tf"], round(r["w"], 9)) for r in sparse.postings(df, "qid").collect()}
    assert got == {(1, 582767): (3, 0.857142857), (1, 883182): (2, 0.8), **{(2, i): (1, 0.666666667) for i in (985560, 247847, 758637, 259514, 521095)}}


def test_term_index_equals_big_integer_modulus(spark):
    words = ["".join(random.Random(i).choices("abcäöüß中文0189", k=1 + i % 9)) for i in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", terms.term_index(F.col("w")).alias("i"), terms.hash_mod(F.md5(F.col("w").cast("binary")), 64).alias("d")).collect():
        digest = int(hashlib.md5(r["w"].encode()).hexdigest(), 16)
        assert (r["i"], r["d"]) == (digest % 1_000_000, digest % 64)


def test_terms_lower_by_character(spark):
    assert one(spark, terms.terms(F.lit("ΟΔΟΣ b Straße_99"))) == ["οδοσ", "straße", "99"]


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "qid long, chunk_id string, dense_rank int")
    found = spark.createDataFrame([(1, "c", 0), (1, "a", 1)], "qid long, chunk_id string, sparse_rank int")
    got = [(r["chunk_id"], r["rank"], r["score"]) for r in hybrid.fuse(dense, found).orderBy("rank").collect()]
    assert got[0] == ("a", 0, pytest.approx(0.03306010928961749)) and got[1][0] == "c" and got[1][2] == pytest.approx(0.016666666666666666)


def test_fusion_ties_keep_dense_hits_first(spark):
    dense = spark.createDataFrame([(1, "z", 0)], "qid long, chunk_id string, dense_rank int")
    found = spark.createDataFrame([(1, "a", 0)], "qid long, chunk_id string, sparse_rank int")
    assert [r["chunk_id"] for r in hybrid.fuse(dense, found).orderBy("rank").collect()] == ["z", "a"]


@pytest.mark.parametrize("lines, spans", [
    (100, [("whole_doc", 1, 100)]), (101, [("function", 1, 100), ("function", 81, 101)]),
    (180, [("function", 1, 100), ("function", 81, 180)]),
    (181, [("function", 1, 100), ("function", 81, 180), ("function", 161, 181)]),
    (260, [("function", 1, 100), ("function", 81, 180), ("function", 161, 260)]),
])
def test_windows(spark, lines, spans):
    body = "".join(f"line {i}\r\n" if i % 2 else f"line {i}\n" for i in range(lines))
    parts = one(spark, chunk_docs.window_parts(F.col("t")), t=body)
    assert [(p["chunk_type"], p["start_line"], p["end_line"]) for p in parts] == spans
    assert parts[0]["text"] == "".join(body.splitlines(keepends=True)[:100]).strip()


def test_lines_split_like_python(spark):
    for sample in ["", "a", "a\n", "a\r\nb\rc\n\nd", "x\x0by\x0cz w\x85v", "\n\n"]:
        assert one(spark, text.lines_with_ends(F.col("t")), t=sample) == sample.splitlines(keepends=True)


@pytest.mark.parametrize("path, kept", [
    ("dist/a.js", False), ("a/node_modules/b/c.js", False), ("x.min.js", False), ("build/.env.example", False),
    ("api_generated.ts", False), ("src/a.py", True), (".env.example", True), ("a.PY", True), ("docs/builder/x.md", True),
    ("Makefile", False), ("img.png", False), ("package-lock.json", False), ("a/yarn.lock", False),
])
def test_indexable(spark, path, kept):
    assert one(spark, routing.is_indexable(F.lit(path), F.lit(10))) is kept


def test_size_limit_only_on_request(spark):
    assert one(spark, routing.is_indexable(F.lit("a.py"), F.lit(10**12)))
    assert one(spark, routing.is_indexable(F.lit("a.py"), F.lit(512000), 512000)) and not one(spark, routing.is_indexable(F.lit("a.py"), F.lit(512001), 512000))


def test_classes(spark):
    rows = {p: (one(spark, routing.language(F.lit(p))), one(spark, routing.source_type(F.lit(p)))) for p in
            ("a.tsx", "x/.env.example", "README.MD", "n.ipynb", "Makefile")}
    assert rows == {"a.tsx": ("typescript", "code"), "x/.env.example": ("env", "config"), "README.MD": ("markdown", "docs"),
                    "n.ipynb": ("notebook", "config"), "Makefile": ("unknown", "code")}


def test_requirements(spark):
    lines = "requests==2.31.0\nflask\nuvicorn[standard]==0.34.2\na>=1,<2 # c\n-r base.txt\nnumpy ~= 1.2\n\n# only"
    got = [(e["name"], e["version"]) for e in one(spark, graph_extract.requirement_entries(F.lit(lines)))]
    assert got == [("requests", "2.31.0"), ("flask", "latest"), ("uvicorn", "[standard]==0.34.2"), ("a", "1,<2"), ("-r", "base.txt"), ("numpy", "~= 1.2")]


def test_package_manifest_development_entries_win(spark):
    doc = json.dumps({"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"a": "3"}})
    assert one(spark, graph_extract.package_dependencies(F.lit(doc))) == {"a": "3", "b": "2"}
    assert one(spark, graph_extract.package_dependencies(F.lit("{broken"))) == {}


def test_go_requirements(spark):
    mod = "module x\ngo 1.22\nrequire github.com/a/b v1.2.3\nrequire (\n\tgolang.org/x/net v0.1.0\n\tgolang.org/x/y v0.2.0 // indirect\n)\n"
    got = [(e["name"], e["version"]) for e in one(spark, graph_extract.go_requirements(F.lit(mod)))]
    assert got == [("github.com/a/b", "v1.2.3"), ("golang.org/x/net", "v0.1.0"), ("golang.org/x/y", "v0.2.0")]


def test_js_imports(spark):
    source = "import React from 'react'\nimport './x.css'\nconst a = require('fs')\nimport {b} from \"../lib/b\""
    assert one(spark, graph_extract.js_import_targets(F.lit(source))) == ["react", "./x.css", "../lib/b", "fs"]


def test_linked_issues(spark):
    assert one(spark, graph_git.linked_issues(F.lit("Fixes #42, closes  #18 prefixes #7"))) == [42, 18, 7]
    assert one(spark, graph_git.linked_issues(F.lit(None).cast("string"))) == []


def test_headers(spark):
    doc = "pre\n# A b\nx\n## C\n```\n# not\n```\n#nohdr\n###### six\n####### seven"
    got = [s["title"] for s in one(spark, chunk_docs.sections(F.lit(doc)))]
    assert got == [None, "A b", "C", "not", "six"]
    assert [s["title"] for s in one(spark, chunk_docs.sections(F.lit("# \n# T\nbody")))] == ["# T"]
    assert [tuple(s) for s in one(spark, chunk_docs.sections(F.lit(" no header ")))] == [(None, " no header ")]


def test_doc_parts(spark):
    long = "\n\n".join("word " * 60 for _ in range(10))
    doc = "tiny\n# Same\n" + "a" * 40 + "\n# Same\nshort\n# Big\n" + long
    parts = one(spark, chunk_docs.doc_parts(F.lit(doc), min_chars=30))
    assert [p["section_title"] for p in parts] == ["Same"] + [f"Big (part {i})" for i in range(1, len(parts))]
    assert all(len(p["text"]) <= 1500 for p in parts) and "".join(p["text"] for p in parts).count("word") == 600
    assert [p["section_title"] for p in one(spark, chunk_docs.doc_parts(F.lit(doc)))][:3] == [None, "Same", "Same"]
    whole = one(spark, chunk_docs.doc_parts(F.lit("# A\nx\n# B\ny and some more words"), min_chars=30))
    assert [(p["chunk_type"], p["section_title"]) for p in whole] == [("whole_doc", None)]


def pack(paragraphs, limit):
    out, current = [], ""
    for p in paragraphs:
        if len(current) + len(p) + 2 <= limit:
            current = current + "\n\n" + p if current else p
        else:
            out += [current] if current else []
            current = p
    return out + ([current] if current else [])


def test_packing_against_plain_python(spark):
    rng = random.Random(3)
    docs = ["\n\n".join("x" * rng.choice([1, 5, 20, 60, 130]) for _ in range(rng.randint(1, 20))) for _ in range(50)]
    df = spark.createDataFrame([(d,) for d in docs], "t string")
    for r in df.select("t", chunk_docs.pack_paragraphs(F.col("t"), 100).alias("p")).collect():
        assert r["p"] == pack(r["t"].split("\n\n"), 100)


def test_whole_parts_limits(spark):
    assert len(one(spark, chunk_docs.whole_parts(F.lit("y" * 2000)))) == 1
    assert one(spark, chunk_docs.whole_parts(F.lit("short"), min_chars=30)) == []
    assert [p["text"] for p in one(spark, chunk_docs.whole_parts(F.lit("short")))] == ["short"] and one(spark, chunk_docs.whole_parts(F.lit(" \n"))) == []
    assert len(one(spark, chunk_docs.whole_parts(F.lit("\n\n".join(["z" * 900] * 3))))) == 3


def test_redaction(spark):
    secret = 'a token = "' + "ab12" * 10 + "\"\nAKIA" + "A" * 16 + "\n-----BEGIN RSA PRIVATE KEY-----\nxx\n-----END RSA PRIVATE KEY-----\nhttps://me:pw@host/x"
    assert one(spark, redact.count_secrets(F.lit(secret))) == 4
    clean = one(spark, redact.redact(F.lit(secret)))
    assert clean.count("[REDACTED]") == 4 and "ab12" not in clean and "pw@" not in clean
    assert one(spark, redact.count_secrets(F.lit("token of thanks: yes"))) == 0
    assert one(spark, redact.count_secrets(F.lit(None).cast("string"))) == 0


def test_registered_rule(spark):
    redact.register_redaction_rule("ticket", r"TCK-\d{6}")
    try:
        assert one(spark, redact.redact(F.lit("see TCK-123456"))) == "see [REDACTED]"
    finally:
        redact._RULES.pop("ticket")


def test_markup(spark):
    html = "<html><head><style>p{}</style><script>var t=\"</p>\";</script></head><body><p>A&amp;B</p>\n\n\n<!-- c --><b>x \t y</b></body></html>"
    assert one(spark, text.strip_markup(F.lit(html))) == "A&B \n\n x y"
    assert one(spark, text.strip_markup(F.lit("a < b  and c > d"))) == "a < b and c > d"


def test_config_lines(spark):
    flat = lambda path, doc: one(spark, config_text.flatten_config(F.col("p"), F.col("d")), p=path, d=doc)
    assert flat("a.json", '{"a": {"b": 1, "c": {"d": [1, 2]}}, "e": null, "f": true}') == "a.b = 1\na.c.d = [1,2]\ne = None\nf = True"
    assert flat("a.json", "[1]") == "[1]" and flat("a.json", "{oops") == "{oops"
    assert flat("a.toml", "x = 1\n[t]\ny = 'z'") == "x = 1\n[t]\ny = 'z'" and flat("a.json", "{}") == ""
    assert flat("a.json", '{"z": "a \\"q\\"", "b": 1.5, "a": {}}') == 'z = a "q"\nb = 1.5'
    assert flat("a.yaml", "a: {b: 1}") == "a: {b: 1}"


def test_config_lines_of_any_depth(spark):
    def lines(doc, prefix=""):
        return [x for k, v in doc.items() for x in (lines(v, f"{prefix}{k}.") if isinstance(v, dict) else [f"{prefix}{k} = {v}"])]

    def deep(levels):
        doc = {"end": "}{ \"x\"", "none": {}}
        for k in range(levels):
            doc = {"a": k, f"n{k}": doc, "z{": {"q": "{"}}
        return doc

    flat = lambda doc: one(spark, config_text.flatten_config(F.col("p"), F.col("d")), p="a.json", d=json.dumps(doc))
    for levels in (11, 12, 13, 14, 60):
        assert flat(deep(levels)) == "\n".join(lines(deep(levels)))
    assert one(spark, config_text.flatten_json(F.col("d"), 2), d='{"a": {"b": {"c": 1}}}') == 'a.b = {"c":1}'


@pytest.mark.parametrize("question, route, tool, target", [
    ("Who calls `foo.bar`?", "graph", "get_call_graph", "foo.bar"),
    ("show the call graph of run", "graph", "get_call_graph", "run"),
    ("what depends on react-dom", "graph", "get_dependencies", "react-dom"),
    ("package usage of lodash", "graph", "get_dependencies", "lodash"),
    ("imports", "graph", None, None),
    ("which commit changed it", "agent", None, None),
    ("explain this", "semantic", None, None),
])
def test_routing(spark, question, route, tool, target):
    assert one(spark, routing.route(F.lit(question))) == route
    got = one(spark, routing.graph_target(F.lit(question)))
    assert (got and (got["tool"], got["target"])) == (tool and (tool, target))


def test_tool_output(spark):
    s = lambda t: one(spark, routing.summarize_output(F.lit(t)))
    assert s(" \n") == "Returned no visible output" and s("No data\nmore") == "No data" and s("a\n\n b\r\nc") == "Returned 3 lines of tool output"


def test_report_sections(spark):
    doc = "Intro\n## 1. Overall Summary\nfine\n\nEvidence Reviewed \r\nlist\nnot a Dependency Surface title"
    got = [(p["title"], p["body"]) for p in one(spark, report.report_sections(F.lit(doc)))]
    assert got == [(None, "Intro"), ("Overall Summary", "fine"), ("Evidence Reviewed", "list\nnot a Dependency Surface title")]


def test_timing_summary(spark):
    m = F.create_map(F.lit("total_ms"), F.lit(5000), F.lit("clone_ms"), F.lit(1234), F.lit("odd_ms"), F.lit(70))
    assert one(spark, stats.timing_summary(m)) == "clone: 1.2s | odd: 0.1s | total: 5.0s"


def test_timing_texts_round_like_sql(spark):
    # As a binary number 0.585 lies below its decimal text.
    m = F.create_map(F.lit("click"), F.lit(585.0), F.lit("view"), F.lit(1234567.0))
    assert one(spark, stats.timing_breakdown(m)) == "view=1234.57s, click=0.58s"


def test_timing_summary_rounds_like_sql(spark):
    # 0.35 lies below its text, 1.25 is a true tie and goes to the even digit.
    m = F.create_map(F.lit("clone_ms"), F.lit(350.0), F.lit("total_ms"), F.lit(1250.0))
    assert one(spark, stats.timing_summary(m)) == "clone: 0.3s | total: 1.2s"
