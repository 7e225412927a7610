"""Titled parts of a written review."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions.text import strip

_TITLES = "|".join(re.escape(t) for t in K.REPORT_SECTION_TITLES)
_TITLE_LINE = rf"(?im)^[ \t]*(?:#{{1,3}}\s*)?(?:\d+\.\s+)?({_TITLES})[ \t]*\r?$\n?"


def report_sections(report: Column) -> Column:
    """array<struct<title, body>>; the first entry is the intro and has no title."""
    pieces = F.split(F.regexp_replace(report, _TITLE_LINE, "\x00$1\x01"), "\x00")

    def titled(piece: Column, i: Column) -> Column:
        intro = F.struct(F.lit(None).cast("string").alias("title"), strip(piece).alias("body"))
        part = F.struct(F.substring_index(piece, "\x01", 1).alias("title"), strip(F.substring_index(piece, "\x01", -1)).alias("body"))
        return F.when(i == 0, intro).otherwise(part)

    return F.transform(pieces, titled)
