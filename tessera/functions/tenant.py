"""Tenant scoping of identifiers and branch defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import blank_to_null


def tenant_prefix(user_id: Column, is_public: Column) -> Column:
    shared = F.when(is_public, F.lit("public")).otherwise(F.lit("anonymous"))
    return F.coalesce(blank_to_null(user_id), shared)


def scoped_id(raw_id: Column, user_id: Column, is_public: Column) -> Column:
    """`prefix::raw_id`; an id that already carries its own prefix is left alone."""
    marker = F.concat(tenant_prefix(user_id, is_public), F.lit("::"))
    return F.when(raw_id.startswith(marker), raw_id).otherwise(F.concat(marker, raw_id))


def strip_scope(value: Column) -> Column:
    at = F.instr(value, "::")
    return F.when(at > 0, F.substr(value, at + 2)).otherwise(value)


def branch_or_main(branch: Column) -> Column:
    return F.coalesce(branch, F.lit("main"))


def repo_branch(branch: Column, default_branch: Column) -> Column:
    return F.coalesce(branch, default_branch, F.lit("main"))


def raw_id(*parts: Column | str) -> Column:
    """`a::b::c`; plain strings are literals."""
    return F.concat_ws("::", *[F.lit(p) if isinstance(p, str) else p for p in parts])
