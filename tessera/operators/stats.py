"""Counts and reports over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as K


def node_counts(nodes: DataFrame, by: list[str]) -> DataFrame:
    return nodes.groupBy(*by, "label").agg(F.count("*").alias("nodes"))


def rel_counts(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Relationships by type whose two ends agree in the `by` columns.

    Each task looks its edges up in a hash table of its share of the nodes: edges outnumber nodes, and sorting them by ids
    that begin alike was most of the work.
    """
    a = nodes.select(F.col("id").alias("src"), *by).hint("shuffle_hash")
    b = nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"_{c}") for c in by]).hint("shuffle_hash")
    both = edges.select("src", "dst", "rel_type").join(a, "src").join(b, "dst")
    for c in by:
        both = both.where(F.col(c) == F.col(f"_{c}"))
    return both.groupBy(*by, "rel_type").agg(F.count("*").alias("relationships"))


def global_stats(chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, chunks, nodes, repos, relationships): exact counts per tenant."""
    is_repo = F.col("label") == "Repository"
    parts = {
        "chunks": chunks.groupBy("user_id").agg(F.count("*").alias("n")),
        "nodes": nodes.groupBy("user_id").agg(F.count("*").alias("n")),
        "repos": nodes.where(is_repo).groupBy("user_id").agg(F.count("*").alias("n")),
        "relationships": rel_counts(nodes, edges, ["user_id"]).groupBy("user_id").agg(F.sum("relationships").alias("n")),
    }
    total = None
    for name, part in parts.items():
        row = part.select("user_id", *[(F.col("n") if other == name else F.lit(0)).cast("long").alias(other) for other in parts])
        total = row if total is None else total.unionByName(row)
    return total.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in parts])


def repo_ownership(repos: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (user_id, repo, branch): how many repositories the user has, and whether this one exists."""
    owned = repos.groupBy("user_id").agg(F.count_distinct("id").alias("repo_count"))
    existing = repos.select("user_id", "repo", F.coalesce("branch", "default_branch", F.lit("main")).alias("branch")).distinct()
    return (
        requests.join(owned, "user_id", "left")
        .join(existing.withColumn("_e", F.lit(True)), ["user_id", "repo", "branch"], "left")
        .withColumns({"repo_count": F.coalesce("repo_count", F.lit(0)), "exists": F.coalesce("_e", F.lit(False))})
        .drop("_e")
    )


def repo_status(chunks: DataFrame) -> DataFrame:
    """(user_id, repo, branch, file_count, chunk_count, languages).

    Files are counted through their own distinct step, so a repository with very many files is not
    held in one set; languages are few.
    """
    key = ["user_id", "repo", "branch"]
    per_file = chunks.groupBy(*key, "file_path", "language").agg(F.count("*").alias("n"))
    per_path = per_file.groupBy(*key, "file_path").agg(F.sum("n").alias("n"), F.collect_set("language").alias("l"))
    per_langs = per_path.groupBy(*key, "l").agg(F.count("*").alias("f"), F.sum("n").alias("n"))
    return per_langs.groupBy(*key).agg(
        F.sum("f").alias("file_count"), F.sum("n").alias("chunk_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))), ",").alias("languages"),
    )


def repo_overview(chunks: DataFrame, job_events: DataFrame) -> DataFrame:
    """`repo_status` with last_indexed and the state of the latest job event of each repository branch; null without one.

    `job_events`: user_id, repo, branch, state, ts, seq.
    """
    key = ["user_id", "repo", "branch"]
    indexed = chunks.groupBy(*key).agg(F.max("indexed_at").alias("last_indexed"))
    at = F.when(F.col("state").isNotNull(), F.struct("ts", "seq"))
    states = job_events.groupBy(*key).agg(F.max_by("state", at).alias("state"))
    return repo_status(chunks).join(indexed, key).join(states, key, "left")


def run_stats(files: DataFrame) -> DataFrame:
    """Counters of one run per (user_id, repo, branch).

    `files`: one row per considered file with eligible, status, chunks, edges, secrets.
    """
    done = F.col("eligible") & F.col("status").isin("new", "changed")
    n = lambda cond: F.count_if(cond)
    return files.groupBy("user_id", "repo", "branch").agg(
        F.count("*").alias("files_seen"),
        n(~F.col("eligible")).alias("files_skipped"),
        n(F.col("eligible") & (F.col("status") == "unchanged")).alias("files_unchanged"),
        n(done).alias("files_parsed"),
        n(done & (F.col("status") == "changed")).alias("files_reindexed"),
        n(F.col("status") == "removed").alias("files_deleted"),
        F.coalesce(F.sum(F.when(done, F.col("chunks"))), F.lit(0)).alias("chunks_created"),
        F.coalesce(F.sum(F.when(done, F.col("edges"))), F.lit(0)).alias("graph_edges_created"),
        n(done & (F.col("secrets") > 0)).alias("files_with_secrets"),
        F.coalesce(F.sum(F.when(done, F.col("secrets"))), F.lit(0)).alias("secrets_redacted"),
        F.coalesce(F.sum(F.when(done, F.col("secrets"))), F.lit(0)).alias("secrets_found"),
    )


def run_paths(files: DataFrame) -> DataFrame:
    """(user_id, repo, branch, path): the files a run saw and took, a row each, so a large repository is no one row's list."""
    return files.where("eligible").select("user_id", "repo", "branch", "path").distinct()


# The stages of this library's own runs, what their events may mention, and what is timed.
STAGES = {
    "listing": "listing files", "changes": "comparing hashes", "content": "reading files", "chunks": "cutting text", "vectors": "making vectors",
    "graph": "building the graph", "tables": "switching tables", "done": "finished",
}
HINTS = [
    (["vector", "posting"], "making vectors"), (["chunk", "cutting"], "cutting text"), (["graph", "edge"], "building the graph"),
    (["hash"], "comparing hashes"), (["waits", "accepted"], "waiting"), (["finished"], "finished"),
]
TIMINGS = {f"{stage}_ms": stage for stage in STAGES}


def stage_label(stage: Column, message: Column, labels: dict[str, str] = STAGES, hints: list[tuple[list[str], str]] = HINTS) -> Column:
    """Short reader-facing name of a stage: its own, else that of the first hint that stage or message holds, else the stage."""
    text = F.lower(F.concat(stage, F.lit(" "), F.coalesce(message, F.lit(""))))
    pairs = [F.lit(x) for item in labels.items() for x in item]
    guess = F.replace(stage, F.lit("_"), F.lit(" "))
    for words, label in reversed(hints):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        guess = F.when(hit, label).otherwise(guess)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), stage), guess)


def _seconds(ms: Column, digits: int) -> Column:
    """Milliseconds as seconds with so many decimals, rounded from the exact binary value as C and SQL do; format_string rounds
    the shortest decimal text, so that 585.0 would give 0.59."""
    return F.replace(F.format_number(ms / 1000.0, digits), F.lit(","), F.lit(""))


def timing_summary(timings: Column, labels: dict[str, str] = TIMINGS) -> Column:
    """`label: 1.2s | … | total: 3.4s` from map<stage key, milliseconds>; keys in name order, total last."""
    names = F.create_map(*[F.lit(x) for item in labels.items() for x in item])
    entries = F.array_sort(F.map_entries(timings))
    is_total = lambda e: e["key"] == "total_ms"
    ordered = F.concat(F.filter(entries, lambda e: ~is_total(e)), F.filter(entries, is_total))
    label = lambda key: F.coalesce(F.try_element_at(names, key), F.regexp_replace(key, "_ms$", ""))
    return F.array_join(
        F.transform(ordered, lambda e: F.concat(label(e["key"]), F.lit(": "), _seconds(e["value"], 1), F.lit("s"))),
        " | ",
    )


def limit_guard(usage: DataFrame, strict: bool = False) -> DataFrame:
    """Adds code, limit and unit of the first limit a repository exceeds (null when none).

    `usage`: repos_owned (of the user, before this one), size_kb, eligible_files, chunks.
    With `strict` the job fails instead.
    """
    limit = lambda code: K.LIMITS[code][0]
    checks = [
        ("repo_count_limit", F.col("repos_owned") >= limit("repo_count_limit")),
        ("repo_too_large", F.col("size_kb") / 1024 > limit("repo_too_large")),
        ("too_many_files", F.col("eligible_files") > limit("too_many_files")),
        ("too_many_chunks", F.col("chunks") > limit("too_many_chunks")),
    ]
    code, bound, unit = (F.lit(None).cast(t) for t in ("string", "int", "string"))
    for name, hit in reversed(checks):
        code, bound, unit = F.when(hit, name).otherwise(code), F.when(hit, limit(name)).otherwise(bound), F.when(hit, K.LIMITS[name][1]).otherwise(unit)
    if strict:
        code = F.when(code.isNotNull(), F.raise_error(F.concat(F.lit("limit exceeded: "), code)))
    return usage.withColumns({"code": code, "limit": bound, "unit": unit})


def timing_breakdown(timings: Column) -> Column:
    """`key=1.23s, …` from map<stage key, milliseconds>, slowest first."""
    slowest = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)
    entries = F.array_sort(F.map_entries(timings), slowest)
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), _seconds(e["value"], 2), F.lit("s"))), ", ")
    return F.when(F.size(timings) == 0, "{}").otherwise(text)
