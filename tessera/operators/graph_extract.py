"""Edges from source files and manifests, and the nodes they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import props as P
from tessera.functions.identity import text_key
from tessera.functions.tenant import raw_id, scoped_id
from tessera.operators import chunk_code as C
from tessera.session import written

# An edge row: ends as (label, raw id), the relation, and properties of the target.
_EDGE = ["fid", "from_label", "from_raw", "to_label", "to_raw", "rel_type", "props"]

# Stands for `repo::branch` in ids of a text that is not placed yet; no other id begins with it.
_HERE = "\x01"
# Import forms of JavaScript and requirement lines.
JS_IMPORT = r"import\s+(?:.*from\s+)?['\"]([^'\"]+)['\"]"
JS_REQUIRE = r"require\(['\"]([^'\"]+)['\"]\)"
REQUIREMENT = r"^([a-zA-Z0-9_\-]+)[=<>~\^]*(.*)"

_CALL = r"(?<![\w.])([A-Za-z_]\w*)\s*\("
_PY_KEYWORDS = [
    "and", "as", "assert", "async", "await", "class", "def", "del", "elif", "else", "except", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with",
    "yield", "None", "True", "False",
]


def _edge(rows: DataFrame, from_label: str, from_raw: Column, to_label: Column | str, to_raw: Column, rel: str,
          props: Column | None = None) -> DataFrame:
    to_label = F.lit(to_label) if isinstance(to_label, str) else to_label
    props = F.create_map().cast("map<string,string>") if props is None else props
    return rows.select(
        "fid", F.lit(from_label).alias("from_label"), from_raw.alias("from_raw"), to_label.alias("to_label"),
        to_raw.alias("to_raw"), F.lit(rel).alias("rel_type"), props.alias("props"),
    )


def js_import_targets(text: Column) -> Column:
    """Import targets first, then required ones, in text order."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.concat(found(JS_IMPORT), found(JS_REQUIRE))


def js_edges(files: DataFrame) -> DataFrame:
    """IMPORTS edges; a target that starts with a dot or slash is a file of the same branch."""
    rows = files.select("fid", "file_raw", "branch_raw", F.explode(js_import_targets(F.col("content"))).alias("target"))
    local = F.col("target").startswith(".") | F.col("target").startswith("/")
    to_raw = F.when(local, raw_id(F.col("branch_raw"), F.col("target"))).otherwise(raw_id("npm", F.col("target")))
    props = F.when(local, P.string_map(type=F.lit("local"))).otherwise(
        P.string_map(ecosystem=F.lit("npm"), type=F.lit("third-party"))
    )
    props = F.when(local, props).otherwise(P.overlay(props, P.string_map(name=F.col("target"))))
    return _edge(rows, "File", F.col("file_raw"), F.when(local, "File").otherwise("Module"), to_raw, "IMPORTS", props)


def python_edges(files: DataFrame) -> DataFrame:
    """Imports, class and function definitions, bases, and direct-name calls, in one pass over the lines.

    Calls belong to the enclosing top-level function or method; functions nested inside others are
    not nodes of their own.
    """
    ids = ["file_raw", "branch_raw"]
    rows = C.python_blocks(files, keep=ids)
    code, file_raw = F.col("code"), F.col("file_raw")
    func, cls = (lambda name: raw_id(file_raw, "func", name)), (lambda name: raw_id(file_raw, "class", name))
    no_props = F.create_map().cast("map<string,string>")

    def entry(from_label: str, from_raw: Column, to_label: str, to_raw: Column, rel: str, props: Column = no_props) -> Column:
        return F.struct(
            F.lit(from_label).alias("from_label"), from_raw.alias("from_raw"), F.lit(to_label).alias("to_label"),
            to_raw.alias("to_raw"), F.lit(rel).alias("rel_type"), props.alias("props"),
        )

    def imported(root: Column) -> Column:
        kind = F.when(root.isin(K.PYTHON_STDLIB), "stdlib").otherwise("third-party")
        props = P.string_map(ecosystem=F.lit("pip"), type=kind, name=root)
        return entry("File", file_raw, "Module", raw_id("python", root), "IMPORTS", props)

    listed = F.split(F.regexp_replace(code, r"^\s*import\s+", ""), ",")
    roots = F.filter(F.transform(listed, lambda m: F.regexp_extract(m, r"^\s*(\w+)", 1)), lambda r: r != "")
    from_line = r"^\s*from\s+(\.*)\s*([\w.]*)\s+import\b"
    dots, module = F.regexp_extract(code, from_line, 1), F.regexp_extract(code, from_line, 2)
    local = entry("File", file_raw, "File", raw_id(F.col("branch_raw"), F.replace(module, F.lit("."), F.lit("/"))),
                  "IMPORTS", P.string_map(type=F.lit("local")))

    name, owner = F.col("function_name"), F.col("class_name")
    body = F.regexp_replace(code, r"^\s*(?:async\s+)?(?:def|class)\s+\w+", "")
    callees = F.filter(F.regexp_extract_all(body, F.lit(_CALL), F.lit(1)), lambda c: ~c.isin(_PY_KEYWORDS))
    call = lambda c: entry("Function", func(name), "Function", func(c), "CALLS", P.string_map(name=c))
    bases = F.transform(F.split(F.regexp_extract(code, r"^class\s+\w+\s*\(([^)]*)\)", 1), ","),
                        lambda b: F.regexp_extract(b, r"^\s*([A-Za-z_]\w*)\s*$", 1))
    base = lambda b: entry("Class", cls(owner), "Class", cls(b), "INHERITS_FROM", P.string_map(name=b))

    is_def = name.isNotNull() & code.rlike(r"^\s*(?:async\s+)?def\s")
    is_class = owner.isNotNull() & code.rlike(r"^class\s")
    found = [
        F.when(code.rlike(r"^\s*import\s+\w"), F.transform(roots, imported)),
        F.when(module != "", F.array(F.when(dots != "", local).otherwise(imported(F.substring_index(module, ".", 1))))),
        F.when(is_def, F.array(entry("Function", func(name), "File", file_raw, "DEFINED_IN"))),
        F.when(name.isNotNull(), F.transform(callees, call)),
        F.when(is_class, F.array(entry("Class", cls(owner), "File", file_raw, "DEFINED_IN"))),
        F.when(is_class, F.transform(F.filter(bases, lambda b: b != ""), base)),
    ]
    edges = rows.select("fid", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("e")).select("fid", "e.*")
    return edges.dropDuplicates(["fid", "from_raw", "rel_type", "to_raw"]).select(*_EDGE)


def package_dependencies(text: Column) -> Column:
    """map<name, version> of a package manifest; development entries win."""
    field = lambda name: F.coalesce(
        F.from_json(F.get_json_object(text, f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    return P.overlay(field("dependencies"), field("devDependencies"))


def requirement_entries(text: Column) -> Column:
    """array<struct<name, version>> of a requirements file."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.trim(F.regexp_replace(F.substring_index(l, "#", 1), r"\s+", " ")))
    entry = lambda l: F.struct(
        F.regexp_extract(l, REQUIREMENT, 1).alias("name"),
        F.coalesce(F.nullif(F.trim(F.regexp_extract(l, REQUIREMENT, 2)), F.lit("")), F.lit("latest")).alias("version"),
    )
    return F.filter(F.transform(lines, entry), lambda e: e["name"] != "")


def go_requirements(text: Column) -> Column:
    """array<struct<name, version>> of a Go module file (require lines and blocks)."""
    rows = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[^\s]+\s+v[^\s]+)"), F.lit(1))
    return F.transform(rows, lambda r: F.struct(
        F.regexp_extract(r, r"^(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract(r, r"^(\S+)\s+(\S+)", 2).alias("version")))


def manifest_edges(files: DataFrame, include_go: bool = False) -> DataFrame:
    """DEPENDS_ON edges from the branch to declared packages, parsed from the raw manifest text."""
    path, text = F.col("path"), F.col("content")
    entries = lambda eco, array, fields: F.transform(array, lambda e: F.struct(
        F.lit(eco).alias("ecosystem"), e[fields[0]].alias("name"), e[fields[1]].alias("version")))
    none = F.array().cast("array<struct<ecosystem:string,name:string,version:string>>")
    found = (
        F.when(path.endswith("package.json"), entries("npm", F.map_entries(package_dependencies(text)), ["key", "value"]))
        .when(path.endswith("requirements.txt"), entries("pip", requirement_entries(text), ["name", "version"]))
    )
    if include_go:
        found = found.when(path.endswith("go.mod"), entries("go", go_requirements(text), ["name", "version"]))
    rows = files.select("fid", "branch_raw", F.explode(found.otherwise(none)).alias("d")).select("fid", "branch_raw", "d.*")
    return _edge(rows, "Repository", F.col("branch_raw"), "Dependency",
                 raw_id(F.col("ecosystem"), F.col("name"), F.col("version")), "DEPENDS_ON",
                 P.string_map(ecosystem=F.col("ecosystem"), name=F.col("name"), version=F.col("version")))


def with_raw_ids(files: DataFrame) -> DataFrame:
    """Adds branch_raw (`repo::branch`), file_raw (`…::path`) and fid (tenant-scoped file id)."""
    branch = raw_id(F.col("repo"), F.col("branch"))
    df = files.withColumn("branch_raw", branch).withColumn("file_raw", raw_id(F.col("branch_raw"), F.col("path")))
    return df.withColumn("fid", scoped_id(F.col("file_raw"), F.col("user_id"), F.col("is_public")))


def file_graph(files: DataFrame, include_go: bool = False, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(node rows, edge rows) of parsed files, as ordered contributions to be merged by key.

    `files` has the file columns plus language, ingest_run_id and the ids of with_raw_ids.  Extraction
    is the costly part and feeds both results, so a text that stands at the same path of several branches
    or tenants is parsed once, and what it says is written once to the checkpoint folder.
    """
    keep = ["user_id", "is_public", "repo", "branch"]
    files = files.withColumn("_text", text_key())
    meta = files.select("_text", *keep, "file_raw", "branch_raw", "commit_sha", "ingest_run_id", "path", "language", "file_sha")
    # Ids below the branch stand below a mark until they are placed in the branches that hold the text.
    texts = files.select(F.col("_text").alias("fid"), "path", "language", "content").dropDuplicates(["fid"])
    texts = texts.withColumn("branch_raw", F.lit(_HERE)).withColumn("file_raw", raw_id(_HERE, F.col("path")))
    edges = (
        python_edges(texts.where(F.col("language") == "python"))
        .unionByName(js_edges(texts.where(F.col("language").isin("javascript", "typescript", "tsx"))))
        .unionByName(manifest_edges(texts, include_go))
    )
    if materialize:
        edges = written(edges, "extracted")
    places = meta.drop("file_raw", "file_sha").withColumnRenamed("_text", "fid")

    def placed(rows: DataFrame) -> DataFrame:
        here = lambda c: F.when(F.col(c).startswith(_HERE), F.concat("branch_raw", F.substr(c, F.lit(len(_HERE) + 1)))).otherwise(F.col(c))
        return rows.join(places, "fid").withColumns({c: here(c) for c in rows.columns if c in ("from_raw", "to_raw")})

    # What a text says of a node twice, it says once; maps can't be compared, their entries can.
    origins = placed(edges.select("fid", "from_label", "from_raw").distinct())
    said = edges.select("fid", "to_label", "to_raw", P.sorted_entries(F.col("props")).alias("_e")).distinct()
    targets = placed(said).withColumn("props", F.map_from_entries("_e"))
    found = placed(edges)
    base = dict(repo=F.col("repo"), branch=F.col("branch"), commit_sha=F.col("commit_sha"), ingest_run_id=F.col("ingest_run_id"))

    def contribution(rows: DataFrame, label: Column, raw: Column, props: Column, seq: int) -> DataFrame:
        return rows.select(*keep, label.alias("label"), raw.alias("raw_id"), P.drop_nulls(props).alias("props"),
                           F.lit(seq).cast("long").alias("seq"))

    of_file = P.string_map(**base, path=F.col("path"), language=F.col("language"))
    named = P.string_map(**base, name=F.substring_index("from_raw", "::", -1))
    origin = (
        F.when(F.col("from_label") == "File", of_file)
        .when(F.col("from_label").isin("Function", "Class"), named).otherwise(P.string_map(**base))
    )
    nodes = (
        contribution(meta, F.lit("File"), F.col("file_raw"), P.overlay(of_file, P.string_map(file_sha=F.col("file_sha"))), 1)
        .unionByName(contribution(origins, F.col("from_label"), F.col("from_raw"), origin, 2))
        .unionByName(contribution(targets, F.col("to_label"), F.col("to_raw"), P.overlay(P.string_map(**base), F.col("props")), 3))
    )
    # Every file hangs below its branch.
    contains = meta.select(
        F.col("branch_raw").alias("from_raw"), F.col("file_raw").alias("to_raw"), F.lit("CONTAINS").alias("rel_type"),
        F.create_map().cast("map<string,string>").alias("props"), *keep)
    linked = found.select("from_raw", "to_raw", "rel_type", "props", *keep).unionByName(contains)
    ends = lambda c: scoped_id(F.col(c), F.col("user_id"), F.col("is_public"))
    edge_rows = linked.select(
        ends("from_raw").alias("src"), ends("to_raw").alias("dst"), "rel_type", "user_id", "repo", "branch", "props",
        F.lit(1).cast("long").alias("seq"),
    )
    return nodes, edge_rows
