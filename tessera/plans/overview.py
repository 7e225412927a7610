"""Repository snapshots, health signals and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K

REPO = ["user_id", "repo", "branch"]


def sample_rows(chunks: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first `limit` chunk rows of each group by id; a report sample, its size is its definition."""
    w = Window.partitionBy(*by).orderBy("chunk_id")
    sampled = chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return sampled.withColumn("place", F.col("_n") - 1).drop("_n")


def pick_evidence(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """(repo key, place, reason, chunk_id, file_path): one row per path of each repository branch.

    Patterns take turns in fixed order, each picking the first path (by its first chunk) that matches and was not picked
    before; all other paths follow in that order.  With `most`, only that many rows per branch.  A pattern can lose at most
    one path to each pattern before it, so only that many of its first matches are looked at together.
    """
    first = chunks.groupBy(*REPO, "file_path").agg(F.min("chunk_id").alias("chunk_id"))
    reasons = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(r).alias("reason")) for i, (p, r) in enumerate(K.EVIDENCE_PATTERNS)])
    matches = first.withColumn("_r", F.explode(F.filter(reasons, lambda r: F.lower("file_path").contains(r["p"]))))
    early = Window.partitionBy(*REPO, "_r.i").orderBy("chunk_id")
    few = matches.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= len(K.EVIDENCE_PATTERNS))
    packed = few.groupBy(*REPO).agg(F.array_sort(F.collect_list(F.struct("_r.i", "_n", "_r.reason", F.col("chunk_id").cast("string").alias("chunk_id"), "file_path"))).alias("_m"))

    def pick(acc: Column, row: Column) -> Column:
        free = ~F.exists(acc, lambda x: (x["i"] == row["i"]) | (x["file_path"] == row["file_path"]))
        return F.when(free, F.array_append(acc, row)).otherwise(acc)

    picked = packed.withColumn("_p", F.aggregate("_m", F.slice("_m", 1, 0), pick))
    chosen = picked.select(*REPO, F.posexplode("_p").alias("place", "_e")).select(*REPO, "place", "_e.reason", "_e.chunk_id", "_e.file_path")
    sizes = picked.select(*REPO, F.size("_p").alias("_k"))
    rest = first.join(chosen.select(*REPO, "file_path"), [*REPO, "file_path"], "left_anti").join(sizes, REPO, "left")
    order = F.row_number().over(Window.partitionBy(*REPO).orderBy("chunk_id")) - 1
    filler = rest.select(*REPO, (order + F.coalesce("_k", F.lit(0))).alias("place"), F.lit(K.EVIDENCE_FILLER_REASON).alias("reason"), F.col("chunk_id").cast("string").alias("chunk_id"), "file_path")
    out = chosen.unionByName(filler)
    return out if most is None else out.where(F.col("place") < most)


def evidence_rows(picked: DataFrame, chunks: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Picked rows with line range, text (an excerpt with `max_chars`) and whether they show a redaction."""
    body = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", "start_line", "end_line", "source_type", "language", "security_censored")
    both = F.coalesce(F.col("start_line"), F.lit(0)) * F.coalesce(F.col("end_line"), F.lit(0)) != 0
    span = F.when(both, F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")))
    censored = F.coalesce(F.col("security_censored"), F.lit(False)) | F.col("text").contains("[REDACTED]")
    return picked.join(body, "chunk_id").select(
        *REPO, "place", "reason", "file_path", span.alias("line_range"), "source_type", "language",
        (F.col("text") if max_chars is None else F.substring("text", 1, max_chars)).alias("excerpt"), censored.alias("secret_signal"))


def health_signals(evidence: DataFrame, nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """One row per repository branch: counts as `name=value` text plus evidence totals.

    `nodes`: repo key, label, nodes.  `rels`: repo key, rel_type, relationships.  Both are small.
    """
    text = lambda name, value: F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", name, value))), ";")
    node_text = nodes.groupBy(*REPO).agg(text("label", "nodes").alias("node_counts"))
    rel_text = rels.groupBy(*REPO).agg(text("rel_type", "relationships").alias("relationship_counts"))
    totals = evidence.groupBy(*REPO).agg(F.count_if("secret_signal").alias("secret_redaction_evidence_count"), F.count("*").alias("evidence_count"))
    return totals.join(node_text, REPO, "left").join(rel_text, REPO, "left")


def readme_pick(chunks: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(repo key, readme): the first readme among the docs rows, else the first docs row; `max_chars` shortens it for a prompt."""
    docs = chunks.where(F.col("source_type") == "docs")
    named = F.lower("file_path").contains("readme")
    first = docs.groupBy(*REPO).agg(
        F.min_by("text", F.when(named, F.col("chunk_id"))).alias("_readme"), F.min_by("text", "chunk_id").alias("_first"))
    text = F.coalesce(F.nullif("_readme", F.lit("")), "_first")
    return first.select(*REPO, (text if max_chars is None else F.substring(text, 1, max_chars)).alias("readme"))


def _listed(array: Column, line) -> Column:
    return F.array_join(F.transform(F.coalesce(array, F.array().cast("array<struct<a:string,b:string,c:string>>")), line), "")


def snapshot_context(repos: DataFrame, readme: DataFrame, nodes: DataFrame, hubs: DataFrame, imported: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo key, context): the orientation text of each repository branch.

    nodes: a=label, n; hubs: a=path, b=language, n=degree; imported: a=path, n; deps: a=name,
    b=ecosystem — each with the repo key and few rows per repository.
    """
    def packed(df: DataFrame, name: str, by_count: bool) -> DataFrame:
        b = F.col("b") if "b" in df.columns else F.lit("")
        n = F.col("n") if "n" in df.columns else F.lit(0)
        order = -n if by_count else F.lit(0)
        rows = df.groupBy(*REPO).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "a", b.alias("b"), n.alias("n")))).alias(name))
        return rows.withColumn(name, F.transform(name, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), r["n"].cast("string").alias("c"))))

    rows = repos.select(*REPO).distinct().join(readme, REPO, "left")
    for df, name, by_count in ((nodes, "_n", False), (hubs, "_h", True), (imported, "_i", True), (deps, "_d", False)):
        rows = rows.join(packed(df, name, by_count), REPO, "left")
    cat = F.concat
    intro = F.when(F.coalesce("readme", F.lit("")) != "", cat(
        F.lit("## What it says about itself\n"), F.col("readme"), F.lit("\n"))).otherwise("")
    context = cat(
        F.lit("Repository: "), F.col("repo"), F.lit("\nBranch: "), F.col("branch"), F.lit("\n\n"), intro,
        F.lit("## Nodes\n"), _listed(F.col("_n"), lambda r: cat(F.lit("- "), r["a"], F.lit(": "), r["c"], F.lit("\n"))),
        F.lit("\n## Files with most edges\n"),
        _listed(F.col("_h"), lambda r: cat(F.lit("- "), r["a"], F.lit(" ("), r["b"], F.lit(") — "), r["c"], F.lit(" connections\n"))),
        F.lit("\n## Files imported most\n"),
        _listed(F.col("_i"), lambda r: cat(F.lit("- "), r["a"], F.lit(" — imported by "), r["c"], F.lit(" files\n"))),
        F.lit("\n## Declared dependencies\n"),
        _listed(F.col("_d"), lambda r: cat(F.lit("- "), r["a"], F.lit(" ("), r["b"], F.lit(")\n"))),
    )
    return rows.select(*REPO, context.alias("context"))


def list_repos(nodes: DataFrame) -> DataFrame:
    """Every indexed repository branch with its state, in name order per tenant."""
    value = lambda k: F.try_element_at(F.col("props"), F.lit(k))
    named = nodes.where((F.col("label") == "Repository") & (F.coalesce(value("full_name"), F.lit("")) != ""))
    return named.select(
        "user_id", value("full_name").alias("repo"), F.coalesce("branch", value("default_branch"), F.lit("main")).alias("branch"),
        value("commit_sha").alias("commit_sha"), (F.coalesce(value("is_private"), F.lit("false")) == "true").alias("is_private"),
        F.coalesce(value("ingestion_status"), F.lit("ready")).alias("ingestion_status"), value("last_ingest_at").alias("last_indexed"),
    ).orderBy("user_id", "repo", "branch")
