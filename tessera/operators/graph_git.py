"""Graph rows and prose from issues, pull requests and commits.

Each builder returns (node rows, edge rows) to be merged by key.  Records carry `user_id`, `is_public`,
`repo` and `branch` columns, so one job covers many repositories and tenants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import props as P
from tessera.functions.tenant import raw_id, scoped_id

_WHERE = ["user_id", "is_public", "repo", "branch"]
# Fixed value: phrases that link a pull request to an issue.
LINKED_ISSUE = r"(?i)(?:close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved)\s+#(\d+)"


def linked_issues(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINKED_ISSUE), F.lit(1))
    return F.transform(found, lambda n: n.cast("long"))


def _branch() -> Column:
    return raw_id(F.col("repo"), F.col("branch"))


def _node(rows: DataFrame, label: str, raw: Column, **properties: Column) -> DataFrame:
    props = P.string_map(repo=F.col("repo"), branch=F.col("branch"), **properties)
    return rows.select(*_WHERE, F.lit(label).alias("label"), raw.alias("raw_id"), P.drop_nulls(props).alias("props"),
                       F.lit(1).cast("long").alias("seq"))


def _edge(rows: DataFrame, src: Column, dst: Column, rel: str, **properties: Column) -> DataFrame:
    props = P.string_map(**properties) if properties else F.create_map().cast("map<string,string>")
    scope = lambda raw: scoped_id(raw, F.col("user_id"), F.col("is_public"))
    return rows.select(scope(src).alias("src"), scope(dst).alias("dst"), F.lit(rel).alias("rel_type"), "user_id", "repo",
                       "branch", P.drop_nulls(props).alias("props"), F.lit(1).cast("long").alias("seq"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _contributors(rows: DataFrame, person: str, once: bool = False) -> tuple[DataFrame, Column]:
    login = F.col(f"{person}.login")
    raw = raw_id(_branch(), "contributor", login)
    known = rows.where(login.isNotNull())
    if once:
        known = known.select(*_WHERE, F.struct(login.alias("login"), F.col(f"{person}.type").alias("type")).alias(person)).distinct()
    kind = F.coalesce(F.col(f"{person}.type"), F.lit("User"))
    return _node(known, "Contributor", raw, login=login, name=login, type=kind), raw


def issue_graph(issues: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """With `once` a person with many records is one row, at the cost of a shuffle of the persons of each task."""
    issue = raw_id(_branch(), "issue", F.col("number").cast("string"))
    people, person = _contributors(issues, "user", once)
    labelled = issues.select(*_WHERE, "number", F.explode("labels.name").alias("label_name")).where(
        F.coalesce(F.col("label_name"), F.lit("")) != ""
    )
    label = raw_id(_branch(), "label", F.lower("label_name"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    nodes = _all([
        _node(issues, "Issue", issue, number=F.col("number"), title=text("title"), state=text("state"), created_at=text("created_at")),
        people,
        _node(labelled, "Label", label, name=F.col("label_name")),
    ])
    edges = _all([
        _edge(issues.where(F.col("user.login").isNotNull()), person, issue, "OPENED"),
        _edge(labelled, issue, label, "LABELED"),
    ])
    return nodes, edges


def pr_graph(prs: DataFrame, pr_files: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """`pr_files` carries the same repository columns plus pr_number.  `once`: see issue_graph."""
    pr = raw_id(_branch(), "pr", F.col("number").cast("string"))
    people, person = _contributors(prs, "user", once)
    closing = prs.select(*_WHERE, "number", F.explode(linked_issues(F.col("body"))).alias("issue"))
    touched = pr_files.where(F.coalesce(F.col("filename"), F.lit("")) != "").join(
        prs.select(*_WHERE, F.col("number").alias("pr_number")), [*_WHERE, "pr_number"], "left_semi"
    )
    file = raw_id(_branch(), F.col("filename"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    nodes = _all([
        _node(prs, "PullRequest", pr, number=F.col("number"), title=text("title"), state=text("state"),
              created_at=text("created_at"), merged_at=F.col("merged_at")),
        people,
        _node(touched, "File", file, path=F.col("filename")),
    ])
    edges = _all([
        _edge(prs.where(F.col("user.login").isNotNull()), person, pr, "OPENED"),
        _edge(closing, pr, raw_id(_branch(), "issue", F.col("issue").cast("string")), "CLOSES"),
        _edge(touched, raw_id(_branch(), "pr", F.col("pr_number").cast("string")), file, "MODIFIES", status=F.col("status")),
    ])
    return nodes, edges


def commit_graph(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    commit = raw_id(_branch(), "commit", F.col("sha"))
    people, person = _contributors(commits, "author")
    touched = commits.select(*_WHERE, "sha", F.explode("files").alias("f")).where(F.coalesce(F.col("f.filename"), F.lit("")) != "")
    file = raw_id(_branch(), F.col("f.filename"))
    nodes = _all([
        _node(commits, "Commit", commit, sha=F.col("sha"),
              message=F.coalesce(F.col("commit.message"), F.lit("")),
              date=F.coalesce(F.col("commit.author.date"), F.lit(""))),
        people,
        _node(touched, "File", file, path=F.col("f.filename")),
    ])
    edges = _all([
        _edge(commits.where(F.col("author.login").isNotNull()), person, commit, "AUTHORED"),
        _edge(touched, commit, file, "TOUCHES", status=F.col("f.status")),
    ])
    return nodes, edges


def _label_text(labels: Column) -> Column:
    names = F.filter(labels, lambda n: F.coalesce(n, F.lit("")) != "")
    listed = F.concat(F.lit(", labels: ["), F.array_join(names, ", "), F.lit("]"))
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, listed).otherwise("")


def issue_prose(number: Column, title: Column, state: Column, labels: Column, login: Column, created_at: Column,
                body: Column) -> Column:
    text = lambda c, default="": F.coalesce(c, F.lit(default))
    return F.concat(
        F.lit("Issue #"), number.cast("string"), F.lit(': "'), text(title), F.lit('" (state: '), text(state, "open"),
        _label_text(labels), F.lit(")\nOpened by: "), text(login, "unknown"), F.lit(" on "), text(created_at),
        F.lit("\nBody: "), text(body),
    )


def pr_prose(number: Column, title: Column, state: Column, labels: Column, base: Column, head: Column, login: Column,
             created_at: Column, body: Column, files: Column) -> Column:
    """`files`: array<struct<filename, status, additions, deletions>>, possibly null."""
    text = lambda c, default="": F.coalesce(c, F.lit(default))
    line = lambda f: F.concat(
        F.lit("- "), f["filename"], F.lit(" (status: "), f["status"], F.lit(", additions: "), f["additions"].cast("string"),
        F.lit(", deletions: "), f["deletions"].cast("string"), F.lit(")\n"),
    )
    listed = F.concat(F.lit("\nModified Files:\n"), F.array_join(F.transform(files, line), ""))
    return F.concat(
        F.lit("Pull Request #"), number.cast("string"), F.lit(': "'), text(title), F.lit('" (state: '),
        text(state, "open"), _label_text(labels), F.lit(")\nBase: "), text(base, "unknown"), F.lit(" <- Head: "),
        text(head, "unknown"), F.lit("\nOpened by: "), text(login, "unknown"), F.lit(" on "), text(created_at),
        F.lit("\nBody: "), text(body), F.lit("\n"),
        F.when(F.size(F.coalesce(files, F.array().cast("array<struct<filename:string,status:string,additions:bigint,deletions:bigint>>"))) > 0, listed).otherwise(""),
    )
