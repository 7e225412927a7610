"""Questions over the node and edge tables, for many names, paths or modules per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.functions.tenant import branch_or_main
from tessera.session import written


def first_rows(rows: DataFrame, by: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first `limit` rows of each group, or all of them without a limit."""
    if limit is None:
        return rows
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def _scoped(nodes: DataFrame, repo: str | None, branch: str | None) -> DataFrame:
    if repo is not None:
        nodes = nodes.where(F.col("repo") == repo)
    if branch is not None:
        nodes = nodes.where(branch_or_main(F.col("branch")) == branch)
    return nodes


def call_graph(nodes: DataFrame, edges: DataFrame, names: DataFrame, repo: str | None = None, branch: str | None = None,
               limit: int | None = None) -> DataFrame:
    """(user_id, name, direction, other_name, other_repo): callers and callees of functions by name.

    `names`: user_id, name.  Both ends must belong to the asking tenant.
    """
    functions = _scoped(nodes.where(F.col("label") == "Function"), repo, branch).select("id", "user_id", "name", "repo")
    calls = edges.where(F.col("rel_type") == "CALLS").select("src", "dst")
    known = functions.join(names.select("user_id", "name").distinct().withColumn("asked", F.lit(True)), ["user_id", "name"], "left")
    end = lambda c: known.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("user_id", "name", "repo", "asked")])
    # Both ends are looked up once; a call counts for either end that is asked for.
    ends = calls.join(end("src"), "src").join(end("dst"), "dst").where(F.col("src_user_id") == F.col("dst_user_id"))

    def side(own: str, far: str, direction: str) -> Column:
        place = [] if limit is None else [F.col(far).alias("_o")]
        return F.when(F.col(f"{own}_asked"), F.struct(
            F.lit(direction).alias("direction"), F.col(f"{own}_name").alias("name"), F.col(f"{far}_name").alias("other_name"),
            F.col(f"{far}_repo").alias("other_repo"), *place))

    both = F.array_compact(F.array(side("dst", "src", "caller"), side("src", "dst", "callee")))
    rows = ends.select(F.col("src_user_id").alias("user_id"), F.explode(both).alias("_s")).select("user_id", "_s.*")
    found = first_rows(rows, ["user_id", "name", "direction"], [F.col("other_name"), F.col("_o")], limit)
    return found.select("user_id", "name", "direction", "other_name", "other_repo")


def call_graph_text(name: Column, callers: Column, callees: Column) -> Column:
    """The readable answer.  `callers`, `callees`: array<struct<other_name, other_repo, n>>; a line stands `n` times."""
    line = lambda e: F.repeat(F.concat(F.lit("  - "), e["other_name"], F.lit(" (in "), e["other_repo"], F.lit(")\n")), e["n"].cast("int"))
    block = lambda a: F.when(F.size(a) > 0, F.array_join(F.transform(a, line), "")).otherwise("  nothing known\n")
    empty = (F.size(callers) == 0) & (F.size(callees) == 0)
    text = F.concat(
        F.lit("Calls of "), name, F.lit("\n\nCalled by:\n"), block(callers),
        F.lit("\nCalls itself:\n"), block(callees),
    )
    return F.when(empty, F.concat(F.lit("The graph knows no calls of "), name)).otherwise(text)


def matching_paths(nodes: DataFrame, needles: list[str]) -> DataFrame:
    """File nodes paired with each needle their path contains; a projection, not a join.

    `needles` is a short list typed by a user, so it travels inside the expression.
    """
    listed = F.array(*[F.lit(n) for n in needles])
    hits = F.filter(listed, lambda n: F.col("path").contains(n))
    files = nodes.where((F.col("label") == "File") & F.col("path").isNotNull())
    return files.select("id", "user_id", "repo", "branch", "path", F.explode(hits).alias("needle"))


def file_history(files: DataFrame, nodes: DataFrame, edges: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """(*by, pr_number, pr_title, pr_state, issue_number): pull requests per group of matched files, newest first.

    `files`: id plus the `by` columns.  A limit counts rows before those without a pull request are
    dropped: rows without one sort first and take places.
    """
    value = lambda k: F.try_element_at(F.col("props"), F.lit(k))
    prs = nodes.where(F.col("label") == "PullRequest").select(
        F.col("id").alias("_pr"), value("number").cast("long").alias("pr_number"), value("title").alias("pr_title"),
        value("state").alias("pr_state"))
    issues = nodes.where(F.col("label") == "Issue").select(
        F.col("id").alias("_issue"), value("number").cast("long").alias("issue_number"))
    modifies = edges.where(F.col("rel_type") == "MODIFIES").select(F.col("src").alias("_pr"), F.col("dst").alias("id"))
    closes = edges.where(F.col("rel_type") == "CLOSES").select(F.col("src").alias("_pr"), F.col("dst").alias("_issue"))
    rows = (
        files.join(modifies.join(prs, "_pr"), "id", "left")
        .join(closes.join(issues, "_issue").drop("_issue"), "_pr", "left")
    )
    order = [F.col("pr_number").desc_nulls_first(), F.col("issue_number"), F.col("id")]
    newest = first_rows(rows, by, order, limit)
    return newest.where(F.col("pr_number").isNotNull()).select(*by, "pr_number", "pr_title", "pr_state", "issue_number")


def importers(nodes: DataFrame, edges: DataFrame, modules: DataFrame, limit: int | None = None) -> DataFrame:
    """(user_id, name, path): files that import each module.  `modules`: user_id, name."""
    wanted = nodes.where(F.col("label") == "Module").join(modules.distinct(), ["user_id", "name"])
    wanted = wanted.select(F.col("id").alias("dst"), "user_id", "name")
    files = nodes.where(F.col("label") == "File").select(F.col("id").alias("src"), F.col("user_id").alias("_u"), "path")
    found = edges.where(F.col("rel_type") == "IMPORTS").select("src", "dst").join(wanted, "dst").join(files, "src")
    found = found.where(F.col("_u") == F.col("user_id"))
    return first_rows(found, ["user_id", "name"], [F.col("path"), F.col("src")], limit).select("user_id", "name", "path")


def declared_version(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(user_id, name, version): the least declared version of each dependency name."""
    deps = nodes.where(F.col("label") == "Dependency").join(modules.distinct(), ["user_id", "name"])
    deps = deps.select(F.col("id").alias("dst"), "user_id", "name", F.try_element_at("props", F.lit("version")).alias("version"))
    used = deps.join(edges.where(F.col("rel_type") == "DEPENDS_ON").select("dst"), "dst", "left_semi")
    return used.groupBy("user_id", "name").agg(F.min("version").alias("version"))


def repo_dependencies(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo_id, name): declared dependencies per repository, with a limit the first by name."""
    repos = nodes.where(F.col("label") == "Repository").select(F.col("id").alias("src"))
    deps = nodes.where(F.col("label") == "Dependency").select(F.col("id").alias("dst"), "name")
    rows = edges.where(F.col("rel_type") == "DEPENDS_ON").select("src", "dst").join(repos, "src", "left_semi").join(deps, "dst")
    return first_rows(rows, ["src"], [F.col("name"), F.col("dst")], limit).select(F.col("src").alias("repo_id"), "name")


def explore(nodes: DataFrame, edges: DataFrame, user_id: str, repo: str, branch: str | None = None,
            center: str | None = None, depth: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node rows, edge rows) of a repository's neighbourhood; with a limit, its first edges in a fixed order.

    With a centre, only edges that touch a node whose name, path or id contains it; each further
    depth adds the edges that touch the nodes reached so far.
    """
    full_name = F.try_element_at(F.col("props"), F.lit("full_name"))
    inside = nodes.where((F.col("user_id") == user_id) & ((F.col("repo") == repo) | F.coalesce(full_name == repo, F.lit(False))))
    if branch is not None:
        inside = inside.where(branch_or_main(F.col("branch")) == branch)
    ids = inside.select("id")
    if center:
        shown = F.lower(F.coalesce("name", "path", "id"))
        chosen = expand(edges, inside.where(shown.contains(center.lower())).select("id"), max(1, depth), ids)
    else:
        chosen = _between(edges, ids)
    links = chosen if limit is None else chosen.orderBy("src", "rel_type", "dst").limit(limit)
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    found = inside.join(ends, "id", "left_semi").withColumn("props", P.visible_properties(F.col("props")))
    return found, links.withColumn("props", P.visible_properties(F.col("props")))


def expand(edges: DataFrame, start: DataFrame, depth: int, within: DataFrame | None = None) -> DataFrame:
    """The edges within `depth` steps of the nodes in `start` (id), in either direction; with `within` (id), only edges that
    have both ends there.

    Each round joins the edges with the newest nodes alone, tests the ends of what it finds and writes that to the shared
    folder. So the edges that no round reaches are neither moved nor sorted where the newest nodes are few, the plan of a
    round does not hold those before it, and a lost executor costs no more than its own round.  It ends early where nothing
    new is reached.
    """
    key = ["src", "rel_type", "dst"]
    frontier = written(start.distinct(), "frontier")
    seen, rounds = frontier, []
    for step in range(depth):
        near = _touching(edges, frontier)
        found = (near if within is None else _between(near, within)).dropDuplicates(key)
        if step < depth - 1:
            found = written(found, "links")
        rounds.append(found)
        if step == depth - 1:
            break
        ends = found.select(F.col("src").alias("id")).union(found.select("dst")).distinct()
        frontier = written(ends.join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    if len(rounds) == 1:
        return rounds[0]
    out = rounds[0]
    for found in rounds[1:]:
        out = out.unionByName(found)
    # An edge between two rounds' nodes is found by both.
    return out.dropDuplicates(key)


def _between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are in `ids`."""
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(
        edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"))


def explore_all(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """The one-hop neighbourhood of every (tenant, repository) at once."""
    ends = nodes.select("id", "user_id", "repo")
    src = ends.select(F.col("id").alias("src"), "user_id", "repo")
    dst = ends.select(F.col("id").alias("dst"), F.col("user_id").alias("_u"), F.col("repo").alias("_r"))
    local = edges.select("src", "dst", "rel_type").join(src, "src").join(dst, "dst").where(
        (F.col("user_id") == F.col("_u")) & (F.col("repo") == F.col("_r")))
    order = [F.col("src"), F.col("rel_type"), F.col("dst")]
    return first_rows(local, ["user_id", "repo"], order, limit).select("user_id", "repo", "src", "rel_type", "dst")


def hub_files(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(user_id, repo, id, degree): most connected files per repository; a self loop counts once."""
    files = nodes.where(F.col("label") == "File").select("id", "user_id", "repo")
    ends = edges.select(F.col("src").alias("id")).unionByName(
        edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    ranked = files.join(degree, "id")
    return first_rows(ranked, ["user_id", "repo"], [F.col("degree").desc(), F.col("id")], limit).select(
        "user_id", "repo", "id", "degree")


def most_imported(nodes: DataFrame, edges: DataFrame, limit: int, label: str = "File") -> DataFrame:
    """(user_id, repo, id, import_count): targets imported by most files, per repository."""
    targets = nodes.where(F.col("label") == label).select("id", "user_id", "repo")
    counts = edges.where(F.col("rel_type") == "IMPORTS").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("import_count"))
    ranked = targets.join(counts, "id")
    return first_rows(ranked, ["user_id", "repo"], [F.col("import_count").desc(), F.col("id")], limit).select(
        "user_id", "repo", "id", "import_count")
