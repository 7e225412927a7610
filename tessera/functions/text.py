"""Text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A line with its terminator, or a last one without; "\r\n" counts once.  Possessive runs, so each character is looked at once.
_ENDS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINE = rf"[^{_ENDS}]*+(?:\r\n|[{_ENDS}])|[^{_ENDS}]++"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with a costly value worked out once per row, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def has_min_chars(text: Column, minimum: int) -> Column:
    return F.length(strip(text)) >= minimum


def lines_with_ends(text: Column) -> Column:
    """Lines with their terminators; no empty last element for a trailing terminator."""
    return F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))


def line_count(text: Column) -> Column:
    return F.size(lines_with_ends(text))


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def truncate_lines(text: Column, limit: int, marker: str) -> Column:
    """First `limit` lines, plus the marker line when something was cut (a display view, not a data filter)."""
    lines = F.split(text, "\n")
    cut = F.concat(F.slice(lines, 1, limit), F.array(F.lit(marker)))
    return F.when(F.size(lines) > limit, F.array_join(cut, "\n")).otherwise(text)


_TAG = r"<[A-Za-z][^>]*>"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def strip_markup(text: Column) -> Column:
    """Visible text of a document that may hold HTML, with white space normalised.

    Script, style and template bodies and comments are not visible text.  Markup is recognised by
    pattern, so unclosed or nested broken tags are handled approximately.
    """
    visible = text
    for block in ("script", "style", "template"):
        visible = F.regexp_replace(visible, rf"(?is)<{block}\b[^>]*>.*?</{block}\s*>", " ")
    visible = F.regexp_replace(visible, r"(?s)<!--.*?-->", " ")
    visible = F.regexp_replace(visible, r"<[!/?A-Za-z][^>]*>", " ")
    for entity, char in _ENTITIES:
        visible = F.replace(visible, F.lit(entity), F.lit(char))
    clean = F.when(text.rlike(_TAG), visible).otherwise(text)
    clean = F.regexp_replace(clean, r"[ \t]+", " ")
    clean = F.regexp_replace(clean, r"\n\s*\n", "\n\n")
    return strip(clean)
