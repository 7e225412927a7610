"""Chunking of prose: header sections, packed paragraphs, whole documents, line windows.

Each rule turns one text into an array of parts inside its row, so chunking moves no data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import bind, has_min_chars, lines_with_ends, strip

# Fixed value: a header line, one to six marks; the blank may run over a line end.
_HEADER = r"^(#{1,6})\s+(.+)$"
_MARK = "\x00"


def part(text: Column, chunk_type: Column | str, title: Column | None = None, start: Column | None = None,
         end: Column | None = None) -> Column:
    as_col = F.lit(chunk_type) if isinstance(chunk_type, str) else chunk_type
    none = F.lit(None)
    return F.struct(
        as_col.alias("chunk_type"),
        (none if title is None else title).cast("string").alias("section_title"),
        (none if start is None else start).cast("int").alias("start_line"),
        (none if end is None else end).cast("int").alias("end_line"),
        text.alias("text"),
    )


def sections(text: Column) -> Column:
    """array<struct<title, body>>: text before the first header (no title), then one entry per header."""
    marked = F.regexp_replace(text, "(?md)" + _HEADER, _MARK + "$0")

    def titled(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"(?d)\A(#{1,6})\s+(.+)", 0)
        title = F.regexp_extract(piece, r"(?d)\A(#{1,6})\s+(.+)", 2)
        body = strip(F.substr(piece, F.length(head) + 1))
        whole = F.when(body == "", strip(head)).otherwise(F.concat(strip(head), F.lit("\n"), body))
        return F.struct(strip(title).alias("title"), whole.alias("body"))

    untitled = lambda body: F.array(F.struct(F.lit(None).cast("string").alias("title"), body.alias("body")))

    def assemble(pieces: Column) -> Column:
        preamble = strip(pieces[0])
        lead = F.when(preamble != "", untitled(preamble)).otherwise(F.slice(untitled(preamble), 1, 0))
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), titled)
        return F.when(F.size(pieces) == 1, untitled(pieces[0])).otherwise(F.concat(lead, rest))

    return bind(F.split(marked, _MARK), assemble)


def pack_paragraphs(text: Column, max_chars: int) -> Column:
    """Consecutive paragraphs joined while they fit; a longer paragraph stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, para: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(para) + 2 <= max_chars
        joined = F.when(acc["open"] == "", para).otherwise(F.concat(acc["open"], F.lit("\n\n"), para))
        flushed = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(flushed.alias("done"), F.when(fits, joined).otherwise(para).alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(F.split(text, "\n\n+"), empty, step, finish)


def _long_enough(parts: Column, min_chars: int) -> Column:
    return F.filter(parts, lambda p: has_min_chars(p["text"], min_chars))


def doc_parts(text: Column, max_chars: int = K.SECTION_MAX_CHARS, min_chars: int = 1) -> Column:
    """Parts of a documentation file; a text without usable sections becomes one whole part.

    Parts of fewer than `min_chars` characters are left out, by default empty ones only; numbers in part titles count them too.
    """
    def of_section(s: Column) -> Column:
        numbered = lambda body, i: part(
            strip(body), "section",
            F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(s["title"], F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))),
        )
        whole = F.array(part(strip(s["body"]), "section", s["title"]))
        return F.when(F.length(s["body"]) <= max_chars, whole).otherwise(
            F.transform(pack_paragraphs(s["body"], max_chars), numbered)
        )

    whole_file = _long_enough(F.array(part(strip(text), "whole_doc")), min_chars)
    return bind(
        _long_enough(F.flatten(F.transform(sections(text), of_section)), min_chars),
        lambda found: F.when(F.size(found) > 0, found).otherwise(whole_file),
    )


def whole_parts(text: Column, min_chars: int = 1) -> Column:
    """Issues, pull requests and configs: one part, or packed parts when oversized."""
    def of_text(t: Column) -> Column:
        packed = F.transform(pack_paragraphs(t, K.SECTION_MAX_CHARS), lambda body: part(strip(body), "whole_doc"))
        single = F.array(part(strip(t), "whole_doc"))
        return _long_enough(F.when(F.length(t) <= K.WHOLE_DOC_MAX_CHARS, single).otherwise(packed), min_chars)

    return bind(text, of_text)


def window_parts(text: Column, size: int = K.WINDOW_LINES, overlap: int = K.WINDOW_OVERLAP, min_chars: int = 1) -> Column:
    """Overlapping line windows; a short text is one whole part."""
    step = size - overlap

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        last = (F.ceil((n - size) / F.lit(step)) * step).cast("int")
        window = lambda s: part(
            strip(F.array_join(F.slice(lines, s + 1, size), "")), "function", start=s + 1, end=F.least(s + size, n)
        )
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), window)
        single = F.array(part(strip(F.array_join(lines, "")), "whole_doc", start=F.lit(1), end=n))
        return _long_enough(F.when(n <= size, single).otherwise(many), min_chars)

    return bind(lines_with_ends(text), of_lines)


def explode_parts(df: DataFrame, parts: Column, keep: list[str]) -> DataFrame:
    """One row per part with its 0-based ordinal."""
    rows = df.select(*keep, F.posexplode(parts).alias("ordinal", "_p"))
    return rows.select(*keep, "ordinal", "_p.*")
