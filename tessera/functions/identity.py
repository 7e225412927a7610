"""Deterministic chunk identity and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tenant import tenant_prefix
from tessera.functions.text import blank_to_null


def as_uuid(hex32: Column) -> Column:
    return F.regexp_replace(hex32, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def chunk_identity(part: Column | None = None) -> Column:
    """The `::`-joined identity over the standard chunk columns; absent parts are left out.

    `part` adds an ordinal, which keeps several parts of one oversized untitled text apart.
    """
    c = F.col
    pieces = [
        tenant_prefix(c("user_id"), c("is_public")), c("repo"), c("branch"), c("file_path"), c("chunk_type"),
        blank_to_null(c("function_name")), blank_to_null(c("class_name")), blank_to_null(c("section_title")),
        c("start_line").cast("string"),
        F.concat(F.lit("issue"), c("issue_number").cast("string")),
        F.concat(F.lit("pr"), c("pr_number").cast("string")),
    ]
    if part is not None:
        pieces.append(F.concat(F.lit("part"), part.cast("string")))
    return F.concat_ws("::", *pieces)


def chunk_id(part: Column | None = None) -> Column:
    return as_uuid(F.md5(chunk_identity(part).cast("binary")))


def content_sha(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def text_key() -> Column:
    """The same for files of equal path and content, whatever their tenant, repository or branch."""
    return F.concat_ws(":", content_sha(F.col("content")), F.col("path"))
