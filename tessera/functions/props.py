"""Property maps of graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K


def overlay(base: Column, top: Column) -> Column:
    """Map union where `top` wins, independent of the session's duplicate-key policy."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def drop_nulls(props: Column) -> Column:
    return F.map_filter(props, lambda _, v: v.isNotNull())


def visible_properties(props: Column) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(K.HIDDEN_GRAPH_PROPERTIES))


def sorted_entries(props: Column) -> Column:
    """Maps cannot be compared or grouped; sorted entries can."""
    return F.array_sort(F.map_entries(props))


def entries_text(props: Column) -> Column:
    """`k=v` pairs in key order, for reports and comparisons."""
    return F.array_join(F.transform(sorted_entries(props), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def string_map(**columns: Column) -> Column:
    pairs = []
    for name, value in columns.items():
        pairs += [F.lit(name), value.cast("string")]
    return F.create_map(*pairs)


def safe_map(**columns: Column) -> Column:
    """A string map of values of any type: times and dates in ISO form, arrays, maps and structs as JSON; nulls are left out."""
    def text(value: Column) -> Column:
        boxed = F.to_json(F.struct(value.alias("v")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "ignoreNullFields": "false"})
        # What JSON puts in quotes is a plain text; the rest keeps its JSON form.
        plain = F.get_json_object(boxed, "$.v")
        return F.when(value.isNotNull(), plain)

    pairs = [x for name, value in columns.items() for x in (F.lit(name), text(value))]
    return drop_nulls(F.create_map(*pairs))


PAYLOAD = [
    "repo", "branch", "commit_sha", "file_sha", "ingest_run_id", "file_path", "language", "source_type", "chunk_type", "function_name", "class_name", "signature",
    "start_line", "end_line", "section_title", "text", "issue_number", "pr_number", "state", "labels", "indexed_at", "user_id", "is_public",
]


def payload(metadata: Column) -> Column:
    """A chunk row's fields as one map of text, overlaid with its own metadata, which wins; nulls are left out."""
    return drop_nulls(overlay(safe_map(**{name: F.col(name) for name in PAYLOAD}), F.coalesce(metadata, F.create_map().cast("map<string,string>"))))
