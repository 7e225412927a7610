"""File selection, file classes, and question routing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import contains_any, strip


def leaf_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot, or an empty string."""
    leaf = leaf_name(path)
    return F.when(leaf.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(leaf, ".", -1)))).otherwise("")


def _globs_as_regex(globs: list[str]) -> str:
    """Shell globs where `*` also crosses `/`, as one anchored alternation."""
    bodies = [".*".join(re.escape(part) for part in glob.split("*")) for glob in globs]
    return r"(?s)\A(?:" + "|".join(bodies) + r")\z"


def is_indexable(path: Column, size: Column | None = None, max_bytes: int | None = None) -> Column:
    """Whether a file belongs in the index: not generated or vendored, known extension, and no larger than a given size."""
    leaf = leaf_name(path)
    excluded = _globs_as_regex(K.EXCLUDED_GLOBS)
    wanted = (leaf == ".env.example") | extension(path).isin(K.INDEXED_EXTENSIONS)
    kept = ~F.concat(F.lit("/"), path).rlike(excluded) & ~leaf.rlike(excluded) & wanted
    return kept if max_bytes is None else kept & (size <= max_bytes)


def _routed_extension(path: Column) -> Column:
    return F.when(leaf_name(path) == ".env.example", F.lit(".env")).otherwise(extension(path))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for item in K.LANGUAGE_BY_EXTENSION.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _routed_extension(path)), F.lit("unknown"))


def source_type(path: Column) -> Column:
    ext = _routed_extension(path)
    return F.when(ext.isin(K.DOC_EXTENSIONS), "docs").when(ext.isin(K.CONFIG_EXTENSIONS), "config").otherwise("code")


def grammar_key(lang: Column, path: Column) -> Column:
    """Which block rules apply: python, javascript, typescript, tsx, go, or the language itself."""
    name = strip(F.lower(lang))
    known = (
        F.when((name == "typescript") & path.endswith(".tsx"), "tsx")
        .when(name.isin("python", "javascript", "typescript", "go"), name)
        .when(name == "golang", "go")
    )
    by_suffix = (
        F.when(path.endswith(".tsx"), "tsx")
        .when(path.endswith(".ts"), "typescript")
        .when(path.endswith(".js") | path.endswith(".jsx"), "javascript")
        .when(path.endswith(".py"), "python")
        .when(path.endswith(".go"), "go")
    )
    return F.coalesce(known, by_suffix, name)


def is_sensitive_file(path: Column) -> Column:
    leaf = F.lower(leaf_name(F.replace(path, F.lit("\\"), F.lit("/"))))
    hit = (leaf == ".env") | leaf.startswith(".env.") | leaf.endswith(".pem") | leaf.endswith(".key")
    return hit & (leaf != ".env.example")


def asks_for_secret_value(question: Column) -> Column:
    q = F.lower(question)
    return contains_any(q, K.SECRET_TERMS) & contains_any(q, K.SECRET_VERBS)


def route(question: Column) -> Column:
    """graph, agent or semantic."""
    q = F.lower(question)
    return (
        F.when(contains_any(q, K.CALL_ROUTE_TERMS) | contains_any(q, K.IMPORT_ROUTE_TERMS), "graph")
        .when(contains_any(q, K.HISTORY_ROUTE_TERMS), "agent")
        .otherwise("semantic")
    )


# The phrases that name a graph target.
_NAME = r"[`'\"]?([A-Za-z_][\w.]*)[`'\"]?"
CALL_PHRASE = rf"(?i)(?:what|who)\s+calls\s+{_NAME}|call graph\s+(?:for|of)\s+{_NAME}"
IMPORT_PHRASE = (
    r"(?i)(?:who\s+imports|what\s+imports|imported\s+by|dependency usage of|module usage of|depends on)"
    r"\s+[`'\"]?([A-Za-z_][\w.-]*)[`'\"]?"
)
WORD = r"[A-Za-z_][\w.-]*"


def graph_target(question: Column) -> Column:
    """struct(tool, target) for questions that name a symbol or module, else null."""
    q = strip(question)
    called = F.coalesce(
        F.nullif(F.regexp_extract(q, CALL_PHRASE, 1), F.lit("")),
        F.nullif(F.regexp_extract(q, CALL_PHRASE, 2), F.lit("")),
    )
    imported = F.nullif(F.regexp_extract(q, IMPORT_PHRASE, 1), F.lit(""))
    stop = F.array(*[F.lit(w) for w in K.TARGET_STOPWORDS])
    words = F.filter(F.regexp_extract_all(q, F.lit(WORD), F.lit(0)), lambda w: ~F.array_contains(stop, F.lower(w)))
    guessed = F.when(contains_any(F.lower(q), K.DEPENDENCY_HINTS), F.try_element_at(words, F.lit(-1)))

    def answer(tool: str, target: Column) -> Column:
        return F.struct(F.lit(tool).alias("tool"), target.alias("target"))

    return (
        F.when(called.isNotNull(), answer("get_call_graph", called))
        .when(imported.isNotNull(), answer("get_dependencies", imported))
        .when(guessed.isNotNull(), answer("get_dependencies", guessed))
    )


def trace_kind(tool: Column) -> Column:
    return (
        F.when(tool.isin("get_call_graph", "get_dependencies"), "graph")
        .when(tool.isin("get_file_history", "get_file_content"), "file")
        .when(tool.isin("search_code", "search_issues"), "semantic")
        .when(tool == "calculate_math", "utility")
        .otherwise("agent")
    )


def summarize_output(content: Column) -> Column:
    text = F.replace(strip(content), F.lit("\r"), F.lit(""))
    visible = F.size(F.filter(F.split(text, "\n"), lambda line: strip(line) != ""))
    return (
        F.when(text == "", "Returned no visible output")
        .when(text.startswith("No "), F.substring_index(text, "\n", 1))
        .otherwise(F.concat(F.lit("Returned "), visible.cast("string"), F.lit(" lines of tool output")))
    )
