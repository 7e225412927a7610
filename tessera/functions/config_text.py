"""Nested JSON documents as `dotted.key = value` lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bind

UNROLLED = 12  # levels that every text goes through; deeper ones cost only those that have them


def _entries(text: Column, prefix: Column) -> Column:
    """array<struct<name, text, nested>> of an object's members, in their order; null if the text is no object."""
    def member(e: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID"))
        plain = F.coalesce(F.when(kind.startswith("ARRAY"), F.to_json(e["value"])).otherwise(F.try_variant_get(e["value"], "$", "string")), F.lit("None"))
        nested = kind.startswith("OBJECT")
        shown = F.when(nested, F.to_json(e["value"])).when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)
        return F.struct(F.concat(prefix, e["key"]).alias("name"), shown.alias("text"), nested.alias("nested"))

    return F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), member)


def _opened(rows: Column) -> Column:
    """Members that are objects replaced by their own members."""
    return F.flatten(F.transform(rows, lambda e: F.when(e["nested"], _entries(e["text"], F.concat(e["name"], F.lit(".")))).otherwise(F.array(e))))


def _all_opened(rows: Column) -> Column:
    """Members opened until none is an object: at most as many times as one of them has opening braces."""
    braces = lambda e: F.length(e["text"]) - F.length(F.replace(e["text"], F.lit("{"), F.lit("")))
    nested = lambda found: F.exists(found, lambda e: e["nested"])
    step = lambda found, _: F.when(nested(found), _opened(found)).otherwise(found)
    return bind(rows, lambda found: F.when(nested(found), F.aggregate(
        F.sequence(F.lit(1), F.array_max(F.transform(F.filter(found, lambda e: e["nested"]), braces))), found, step)).otherwise(found))


def flatten_json(text: Column, levels: int | None = None) -> Column:
    """A JSON object's members as lines, in their order, however deep; with `levels` objects below them stay as JSON text.

    Anything that is no object is returned unchanged, as is what Spark's JSON reader does not read (more than 1,000 levels).
    Lists are shown as JSON, null as None, truth values as True and False.
    """
    rows = _entries(text, F.lit(""))
    for _ in range((levels or UNROLLED) - 1):
        rows = _opened(rows)
    if levels is None:
        rows = _all_opened(rows)
    return bind(rows, lambda found: F.coalesce(F.array_join(F.transform(found, lambda e: F.concat(e["name"], F.lit(" = "), e["text"])), "\n"), text))


def flatten_config(path: Column, text: Column) -> Column:
    """JSON files flattened, other configs as they are."""
    return F.when(path.endswith(".json"), flatten_json(text)).otherwise(text)
