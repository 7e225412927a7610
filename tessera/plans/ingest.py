"""From files to the chunk table and the graph: fresh ingest and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.functions import identity, redact, routing
from tessera.functions.config_text import flatten_config
from tessera.functions.tenant import scoped_id
from tessera.functions.text import strip_markup
from tessera.operators import chunk_code, chunk_docs, graph_extract, incremental, maintenance
from tessera.session import written

_CHUNKERS: dict[str, Callable[[Column], Column]] = {}


def register_chunker(language: str, parts: Callable[[Column], Column]) -> None:
    """Use `parts` (text column to an array of `chunk_docs.part` structs) for files of a language."""
    _CHUNKERS[language] = parts


def prepare_files(files: DataFrame) -> DataFrame:
    """Eligible files, redacted and classified.  `raw_content` keeps manifests in their own syntax."""
    kept = files.where(routing.is_indexable(F.col("path")))
    sha = F.coalesce(F.col("file_sha"), identity.content_sha(F.col("content")))
    safe = kept.withColumn("file_sha", sha).withColumn("secrets", redact.count_secrets(F.col("content")))
    safe = safe.withColumn("raw_content", redact.redact(F.col("content")))
    typed = safe.withColumns({"language": routing.language(F.col("path")), "source_type": routing.source_type(F.col("path"))})
    path, text, kind = F.col("path"), F.col("raw_content"), F.col("source_type")
    parsed = F.when(kind == "docs", strip_markup(text)).when(kind == "config", flatten_config(path, text)).otherwise(text)
    return typed.withColumn("content", parsed)


def file_changes(files: DataFrame, previous: DataFrame) -> DataFrame:
    """(user_id, repo, branch, path, file_sha, status) of files that are new, changed or removed; unchanged ones are left out.

    Only keys and hashes are compared, as a small table in the shared folder.  Content is read for files that come without a hash.
    """
    kept = files.where(routing.is_indexable(F.col("path")))
    return _differences(kept.select(*incremental.FILE_KEY, F.coalesce(F.col("file_sha"), identity.content_sha(F.col("content"))).alias("file_sha")), previous)


def _differences(heads: DataFrame, previous: DataFrame) -> DataFrame:
    key = incremental.FILE_KEY
    differ = incremental.change_status(heads, previous).where("status <> 'unchanged'").select(*key, "file_sha", "status")
    gone = incremental.removed_files(heads, previous).select(*key, F.lit(None).cast("string").alias("file_sha"), F.lit("removed").alias("status"))
    return written(differ.unionByName(gone), "changes")


def changed_content(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Prepared files that are new or changed.

    The content scan is joined with the keys of those alone, which Spark turns into a filter at the scan where that pays.  A
    text that stands at the same path in several branches or tenants is redacted and parsed once, and written once.
    """
    work = changes.where(F.col("status").isin("new", "changed")).select(*incremental.FILE_KEY, "file_sha")
    found = files.drop("file_sha").join(work, incremental.FILE_KEY)
    once = written(prepare_files(found.select("path", "file_sha", "content").dropDuplicates(["path", "file_sha"])), "prepared")
    places = written(files.drop("content", "file_sha").join(work, incremental.FILE_KEY), "places")
    return places.join(once, ["path", "file_sha"])


def chunk_files(files: DataFrame, run_id: str, run_seq: int, id_mode: str = "part") -> DataFrame:
    """Chunk rows of prepared files.

    `id_mode="reference"` leaves part ordinals out of the identity, so the last part of an oversized
    untitled text replaces the earlier ones; "part" keeps them all.
    """
    files = files.withColumn("fid", identity.text_key())
    meta = files.select("fid", "user_id", "is_public", "repo", "branch", "commit_sha", "file_sha", F.col("path").alias("file_path"),
                        "language", "source_type", "secrets")
    # A text that stands at the same path of several branches or tenants is chunked once.
    files = files.select("fid", "path", "language", "source_type", "content").dropDuplicates(["fid"])
    text, kind, lang = F.col("content"), F.col("source_type"), F.col("language")
    custom = lang.isin(list(_CHUNKERS)) if _CHUNKERS else F.lit(False)
    parts = F.when(kind == "docs", chunk_docs.doc_parts(text)).otherwise(chunk_docs.whole_parts(text))
    for name, rule in _CHUNKERS.items():
        parts = F.when(lang == name, rule(text)).otherwise(parts)
    prose = files.where((kind != "code") | custom)
    prose_rows = chunk_docs.explode_parts(prose, parts, ["fid"])
    code = files.where((kind == "code") & ~custom).select("fid", routing.grammar_key(lang, F.col("path")).alias("grammar"), "content")
    rows = prose_rows.unionByName(chunk_code.code_chunks(code), allowMissingColumns=True).join(meta, "fid")

    none = lambda t: F.lit(None).cast(t)
    rows = rows.withColumns({
        "ingest_run_id": F.lit(run_id), "run_seq": F.lit(run_seq).cast("long"), "ordinal": F.coalesce("ordinal", F.lit(0)),
        "large_function": F.coalesce("large_function", F.lit(False)), "issue_number": none("int"), "pr_number": none("int"),
        "state": none("string"), "labels": none("array<string>"), "secrets_redacted": F.col("secrets"),
        "security_censored": F.col("secrets") > 0, "indexed_at": F.current_timestamp(),
        "metadata": F.when(F.col("chunking") == "generic_window", F.create_map(F.lit("chunking"), F.col("chunking"))).otherwise(
            F.create_map().cast("map<string,string>")),
    })
    # Only parts without a line of their own need the ordinal to stay apart.
    part = F.when(F.col("start_line").isNull() & (F.col("ordinal") > 0), F.col("ordinal"))
    rows = rows.withColumn("chunk_id", identity.chunk_id(part if id_mode == "part" else None))
    rows = rows.select(*schemas.columns_of(schemas.CHUNKS))
    return rows if id_mode == "part" else maintenance.latest(rows, ["chunk_id"], "run_seq", "ordinal")


def refresh_chunks(existing: DataFrame | None, files: DataFrame, previous: DataFrame | None, run_id: str, run_seq: int) -> DataFrame:
    """The chunk table after a run: changed and removed files lose their old chunks, changed and new ones are chunked.

    `files` are prepared.  Unchanged files keep their rows and their old run id.
    """
    if existing is None or previous is None:
        return chunk_files(files, run_id, run_seq)
    changes = _differences(files.select(*incremental.FILE_KEY, "file_sha"), previous)
    work = changes.where(F.col("status").isin("new", "changed")).select(*incremental.FILE_KEY)
    return with_new_chunks(existing, files.join(work, incremental.FILE_KEY, "left_semi"), changes, run_id, run_seq)


def with_new_chunks(existing: DataFrame, work: DataFrame, changes: DataFrame, run_id: str, run_seq: int) -> DataFrame:
    """Chunk table after a run: chunks of changed and removed files go, those of `work` (prepared) come in."""
    doomed = changes.where(F.col("status").isin("changed", "removed")).select("user_id", "repo", "branch", F.col("path").alias("file_path"))
    kept = existing.join(doomed, ["user_id", "repo", "branch", "file_path"], "left_anti").select(*existing.columns)
    return maintenance.upsert_chunks(kept, chunk_files(work, run_id, run_seq))


def record_chunks(records: DataFrame, kind: str, run_id: str, run_seq: int) -> DataFrame:
    """Chunk rows of issues or pull requests.

    `records`: repository columns, number, state, labels array<string>, text (the prose form).
    """
    keep = ["user_id", "is_public", "repo", "branch", "number", "state", "labels", "_full"]
    whole = records.withColumn("_full", F.col("text")).select(*keep)
    rows = chunk_docs.explode_parts(whole, chunk_docs.whole_parts(redact.redact(F.col("_full"))), keep)
    none = lambda t: F.lit(None).cast(t)
    secrets = redact.count_secrets(F.col("_full"))
    number = F.col("number").cast("int")
    rows = rows.withColumns({
        "commit_sha": none("string"), "file_sha": none("string"), "ingest_run_id": F.lit(run_id), "run_seq": F.lit(run_seq).cast("long"),
        "file_path": F.concat(F.lit(f"{kind}_"), number.cast("string")), "language": F.lit("markdown"), "source_type": F.lit(kind),
        "function_name": none("string"), "class_name": none("string"), "signature": none("string"), "full_body": none("string"),
        "large_function": F.lit(False), "issue_number": number if kind == "issue" else none("int"),
        "pr_number": number if kind == "pr" else none("int"), "secrets_redacted": secrets, "security_censored": secrets > 0,
        "indexed_at": F.current_timestamp(), "metadata": F.create_map().cast("map<string,string>"),
    })
    part = F.when(F.col("ordinal") > 0, F.col("ordinal"))
    return rows.withColumn("chunk_id", identity.chunk_id(part)).select(*schemas.columns_of(schemas.CHUNKS))


def _empty(like: DataFrame, ddl: str) -> DataFrame:
    """No rows, and the optimizer knows it, so nothing is joined with them."""
    return like.limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])


def merge_file_graph(nodes: DataFrame | None, edges: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables after adding the graph of files (with raw ids, language and ingest_run_id)."""
    nodes = _empty(files, schemas.NODES) if nodes is None else nodes
    edges = _empty(files, schemas.EDGES) if edges is None else edges
    new_nodes, new_edges = graph_extract.file_graph(files)
    branches = files.select("user_id", "is_public", "repo", "branch", "branch_raw", "ingest_run_id").distinct()
    repos = branches.select(
        "user_id", "is_public", "repo", "branch", F.lit("Repository").alias("label"), F.col("branch_raw").alias("raw_id"),
        F.map_filter(F.create_map(F.lit("full_name"), F.col("repo"), F.lit("branch"), F.col("branch"), F.lit("ingest_run_id"), F.col("ingest_run_id")),
                     lambda _, v: v.isNotNull()).alias("props"),
        F.lit(1).cast("long").alias("seq"))
    new_nodes = new_nodes.unionByName(repos)
    # Both ends of a new edge are among the new nodes; those of the edges held may have gone.
    ids = nodes.select("id").unionByName(new_nodes.select(scoped_id(F.col("raw_id"), F.col("user_id"), F.col("is_public")).alias("id")))
    return maintenance.merge_nodes(nodes, new_nodes), maintenance.merge_edges(maintenance.connected_edges(edges, ids), new_edges, None)


def refresh_graph(nodes: DataFrame, edges: DataFrame, work: DataFrame, changes: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Graph after a run: subgraphs of changed and removed files go, changed and new files (`work`, prepared) are added."""
    doomed = changes.where(F.col("status").isin("changed", "removed")).select(*incremental.FILE_KEY)
    nodes, edges = maintenance.detach_delete(nodes, edges, maintenance.file_subgraph(nodes, doomed))
    raw = work.withColumns({"ingest_run_id": F.lit(run_id), "content": F.coalesce("raw_content", "content")})
    return merge_file_graph(nodes, edges, graph_extract.with_raw_ids(raw))


def parse_files(files: DataFrame) -> DataFrame:
    """Prepared files as a table: chunks and graph read it by column, so files are redacted and parsed once."""
    return written(prepare_files(files), "prepared")


def first_graph(ready: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a first run over prepared files."""
    raw = ready.withColumn("content", F.col("raw_content")).withColumn("ingest_run_id", F.lit(run_id))
    return merge_file_graph(None, None, graph_extract.with_raw_ids(raw))


def ingest(files: DataFrame, run_id: str, run_seq: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, nodes, edges) of a first run over raw `files`."""
    ready = parse_files(files)
    return chunk_files(ready, run_id, run_seq), *first_graph(ready, run_id)


def refresh(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, previous: DataFrame, run_id: str,
            run_seq: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, nodes, edges) after an incremental run over raw `files` against the previous file hashes.

    Hashes are compared first; only new and changed files are read, redacted, parsed and chunked.
    """
    changes = file_changes(files, previous)
    work = changed_content(files, changes)
    return with_new_chunks(chunks, work, changes, run_id, run_seq), *refresh_graph(nodes, edges, work, changes, run_id)
