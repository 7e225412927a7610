"""Keyed merges and deletes over the chunk, node and edge tables.

Every function maps frames to frames; `sources.tables` persists the result.  A key that holds a large
share of the rows is reduced inside each task before anything moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import props as P
from tessera.functions.tenant import branch_or_main, scoped_id

NODE_KEY = ["label", "id"]
EDGE_KEY = ["src", "rel_type", "dst"]


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row per key by the order columns.  Rank pruning keeps one row per key and task."""
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n")


def _apart(existing: DataFrame, incoming: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Existing rows whose key comes in again, and the rest, which a merge hands on as it is."""
    keys = incoming.select(*key).distinct()
    return existing.join(keys, key, "left_semi").select(*existing.columns), existing.join(keys, key, "left_anti").select(*existing.columns)


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Incoming rows replace existing ones with the same id; the last of several incoming rows wins.

    Only existing rows whose id comes in again are ranked; the others pass by an anti-join on the id.
    """
    hit, rest = _apart(existing, incoming, [key])
    return latest(hit.unionByName(incoming, allowMissingColumns=True), [key], "run_seq", "ordinal").unionByName(rest, allowMissingColumns=True)


def in_scope(user_id: str, repo: str, branch: str | None = None) -> Column:
    """Rows of one tenant's repository, optionally one branch.  The tenant is not optional."""
    if not user_id:
        raise ValueError("a tenant is required")
    scope = (F.col("user_id") == user_id) & (F.col("repo") == repo)
    return scope if branch is None else scope & (branch_or_main(F.col("branch")) == branch)


def keep_outside(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows the condition does not select; a null counts as not selected."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def delete_files(chunks: DataFrame, doomed: DataFrame) -> DataFrame:
    """Drop the chunks of many files at once.  `doomed`: user_id, repo, branch (null = any), file_path."""
    exact = doomed.where(F.col("branch").isNotNull())
    anywhere = doomed.where(F.col("branch").isNull()).select("user_id", "repo", "file_path")
    kept = chunks.join(exact.select("user_id", "repo", "branch", "file_path"), ["user_id", "repo", "branch", "file_path"], "left_anti")
    return kept.join(anywhere, ["user_id", "repo", "file_path"], "left_anti")


def delete_repo(chunks: DataFrame, user_id: str, repo: str, branch: str | None = None) -> DataFrame:
    return keep_outside(chunks, in_scope(user_id, repo, branch))


def drop_stale_runs(rows: DataFrame, user_id: str, repo: str, branch: str, active_run: str) -> DataFrame:
    """Keep only the active run within a branch; rows that carry no run are stale too."""
    stale = in_scope(user_id, repo, branch) & ~F.col("ingest_run_id").eqNullSafe(F.lit(active_run))
    return keep_outside(rows, stale)


def roll_back_run(rows: DataFrame, user_id: str, repo: str, branch: str, run: str) -> DataFrame:
    return keep_outside(rows, in_scope(user_id, repo, branch) & (F.col("ingest_run_id") == run))


Store = Callable[[DataFrame, str], DataFrame]  # writes a frame under a name and reads it back


def _alike(rows: DataFrame, key: list[str], fixed: list[str], store: Store) -> tuple[DataFrame, DataFrame]:
    """(*key, *fixed, props) of the keys whose rows agree in all but `seq`, and the other keys.  Nulls say nothing."""
    filled = P.drop_nulls(F.coalesce("props", F.create_map().cast("map<string,string>")))
    said = F.struct(*fixed, F.sort_array(F.map_entries(filled)).alias("_e"))
    ends = rows.select(F.xxhash64(*key).alias("_h"), *key, said.alias("_s")).groupBy("_h", *key).agg(F.min("_s").alias("_s"), F.max("_s").alias("_t"))
    kept = store(ends.select(*key, "_s", F.col("_s").eqNullSafe(F.col("_t")).alias("_same")), "contributions")
    alike = kept.where("_same").select(*key, *[F.col(f"_s.{c}").alias(c) for c in fixed], F.map_from_entries("_s._e").alias("props"))
    return alike, store(kept.where("not _same").select(*key), "differing")


def merge_properties(rows: DataFrame, key: list[str], fixed: list[str], null_removes: bool = False, store: Store | None = None) -> DataFrame:
    """(*key, *fixed, props): per key and property the value of the highest `seq`; the fixed columns of the
    latest row.

    Values are reduced per (key, property) inside tasks, and again per key, so a key with very many
    contributions stays cheap.  With `null_removes` a last null removes the property; otherwise nulls
    never overwrite.  Between rows of equal seq the greater value wins, so arrival order is irrelevant.

    With `store` keys whose rows all say the same, as where one row comes for a key or rows come again, are told apart first and
    handed on as they are: only the properties of the others are taken apart.
    """
    if store is not None:
        alike, differ = _alike(rows, key, fixed, store)
        return alike.unionByName(merge_properties(rows.join(differ.hint("merge"), key, "left_semi"), key, fixed, null_removes))
    # The fixed columns travel with the first property of a row alone.
    # Ids begin alike, so sorting looks at a hash of the key before the key.
    entries = rows.select(F.xxhash64(*key).alias("_h"), *key, "seq", F.struct("seq", *fixed).alias("_all"), F.posexplode_outer("props").alias("_p", "_k", "_v"))
    entries = entries.withColumn("_f", F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("_all"))).drop("_all", "_p")
    if not null_removes:
        entries = entries.withColumn("_k", F.when(F.col("_v").isNotNull(), F.col("_k")))
    last = entries.groupBy("_h", *key, "_k").agg(F.max(F.struct("seq", "_v")).alias("_l"), F.max("_f").alias("_f"))
    pair = F.when(F.col("_k").isNotNull() & F.col("_l._v").isNotNull(), F.struct(F.col("_k"), F.col("_l._v").alias("_v")))
    merged = last.groupBy("_h", *key).agg(F.map_from_entries(F.collect_list(pair)).alias("props"), F.max("_f").alias("_f"))
    return merged.select(*key, *[F.col(f"_f.{c}").alias(c) for c in fixed], "props")


def _checked(column: str, allowed: list[str], what: str) -> Column:
    message = F.concat(F.lit(f"unsupported {what}: "), F.col(column))
    return F.when(F.col(column).isin(allowed), F.col(column)).otherwise(F.raise_error(message))


def merge_nodes(existing: DataFrame, incoming: DataFrame, null_removes: bool = False, store: Store | None = None) -> DataFrame:
    """Node table after merging.  `incoming`: label, raw_id, user_id, is_public, repo, branch, props, seq.

    Standard columns of a key come from its latest contribution; name and path follow the properties.  Nodes that nothing
    comes in for keep their rows: their properties are not taken apart.  `store`: see merge_properties.
    """
    fresh = incoming.withColumn("id", scoped_id(F.col("raw_id"), F.col("user_id"), F.col("is_public"))).withColumn(
        "label", _checked("label", K.NODE_LABELS, "node label")
    )
    fixed = ["raw_id", "user_id", "is_public", "repo", "branch"]
    columns = [*NODE_KEY, *fixed, "props", "seq"]
    hit, rest = _apart(existing, fresh, NODE_KEY)
    rows = hit.withColumn("seq", F.lit(0).cast("long")).select(*columns).unionByName(fresh.select(*columns))
    merged = merge_properties(rows, NODE_KEY, fixed, null_removes, store)
    value = lambda k: F.try_element_at(F.col("props"), F.lit(k))
    layout = ["id", "label", "raw_id", "user_id", "is_public", "repo", "branch", "name", "path", "props"]
    return merged.withColumns({"name": value("name"), "path": value("path")}).select(*layout).unionByName(rest.select(*layout))


def connected_edges(edges: DataFrame, nodes: DataFrame, spill: bool = False) -> DataFrame:
    """Edges whose two ends exist.  Tasks hash their share of the ids, so edges, which outnumber nodes, are not sorted.  Such a
    table must fit the task's memory; with `spill` both sides are sorted instead, by a hash of the id before the id."""
    if spill:
        ids = nodes.select(F.xxhash64("id").alias("_h"), F.col("id").alias("_id")).hint("merge")
        for end in ("src", "dst"):
            edges = edges.join(ids, (F.xxhash64(end) == F.col("_h")) & (F.col(end) == F.col("_id")), "left_semi")
        return edges
    ids = nodes.select("id").hint("shuffle_hash")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def merge_edges(existing: DataFrame, incoming: DataFrame, nodes: DataFrame | None, store: Store | None = None) -> DataFrame:
    """Edge table after merging: one edge per (source, type, target), properties overlaid, ends checked.

    Edges that nothing comes in for keep their rows.  Without `nodes` the ends are known to exist.  With `store` (see
    merge_properties) no join holds a table that cannot spill.
    """
    fixed = ["user_id", "repo", "branch"]
    columns = [*EDGE_KEY, *fixed, "props", "seq"]
    fresh = incoming.withColumn("rel_type", _checked("rel_type", K.REL_TYPES, "relationship type")).select(*columns)
    hit, rest = _apart(existing, fresh, EDGE_KEY)
    merged = merge_properties(hit.withColumn("seq", F.lit(0).cast("long")).select(*columns).unionByName(fresh), EDGE_KEY, fixed, store=store)
    layout = [*EDGE_KEY, *fixed, "props"]
    both = merged.select(*layout).unionByName(rest.select(*layout))
    return both if nodes is None else connected_edges(both, nodes, spill=store is not None).select(*layout)


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the nodes whose `id` is in `doomed` and every edge at either end."""
    ids = doomed.select("id").distinct()
    kept_edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_anti"
    )
    return nodes.join(ids, "id", "left_anti"), kept_edges


def file_subgraph(nodes: DataFrame, doomed_files: DataFrame) -> DataFrame:
    """Ids of a file's node and of everything below it.  `doomed_files`: user_id, repo, branch, path.

    A raw id below a file starts with `repo::branch::path`, so its first three parts are an equality key.
    """
    keys = doomed_files.select("user_id", F.concat_ws("::", "repo", "branch", "path").alias("_file")).distinct()
    owner = F.substring_index("raw_id", "::", 3)
    return nodes.withColumn("_file", owner).join(keys, ["user_id", "_file"], "left_semi").select("id")


def repo_subgraph(nodes: DataFrame, user_id: str, repo: str, branch: str | None = None) -> DataFrame:
    """Ids of all nodes of a repository (or branch), by column, full name, or raw-id prefix."""
    full_name = F.coalesce(F.try_element_at(F.col("props"), F.lit("full_name")), F.lit(""))
    named = (F.col("repo") == repo) | (full_name == repo)
    prefix = repo + "::" if branch is None else f"{repo}::{branch}"
    below = F.col("raw_id").startswith(prefix) if branch is None else (F.col("raw_id") == prefix) | F.col("raw_id").startswith(prefix + "::")
    if branch is not None:
        named = named & (branch_or_main(F.col("branch")) == branch)
    return nodes.where((F.col("user_id") == user_id) & (F.coalesce(named, F.lit(False)) | below)).select("id")


def delete_report(chunks: DataFrame, nodes: DataFrame, user_id: str, repo: str, branch: str | None = None) -> DataFrame:
    """What is left of a repository after deletion, and whether the deletion is complete."""
    zero = F.lit(0).cast("long")
    left_chunks = chunks.where(in_scope(user_id, repo, branch)).agg(F.count("*").alias("c")).select("c", zero.alias("g"))
    left_nodes = repo_subgraph(nodes, user_id, repo, branch).agg(F.count("*").alias("g")).select(zero.alias("c"), "g")
    both = left_chunks.unionByName(left_nodes).agg(F.sum("c").alias("chunks_remaining"), F.sum("g").alias("graph_remaining"))
    clean = (F.col("chunks_remaining") == 0) & (F.col("graph_remaining") == 0)
    return both.withColumn("status", F.when(clean, "success").otherwise("partial"))


def set_repo_properties(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Set or (with null) remove properties of Repository nodes.  `changes`: id, props.

    Rows of `changes` with unknown ids change nothing.
    """
    stays = nodes.join(changes.select("id").distinct(), "id", "left_anti").select(*nodes.columns)
    hit = nodes.join(changes.select("id", F.col("props").alias("_c")), "id")
    merged = hit.withColumn("props", P.drop_nulls(P.overlay(F.col("props"), F.col("_c")))).drop("_c")
    return stays.unionByName(merged.select(*nodes.columns))


def roll_back_graph(nodes: DataFrame, edges: DataFrame, user_id: str, repo: str, branch: str, run: str, status: str, error: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without what a failed run added; the branch's Repository node says how it ended."""
    added = F.try_element_at("props", F.lit("ingest_run_id")) == run
    doomed = nodes.where(in_scope(user_id, repo, branch) & F.coalesce(added, F.lit(False)) & (F.col("label") != "Repository")).select("id")
    left, links = detach_delete(nodes, edges, doomed)
    root = left.where(in_scope(user_id, repo, branch) & (F.col("label") == "Repository")).select("id")
    change = P.string_map(ingestion_status=F.lit(status), last_ingest_error=F.lit(error))
    return set_repo_properties(left, root.withColumn("props", change)), links
