"""Citations, prompt contexts, routed questions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.functions import routing
from tessera.operators import graph_query
from tessera.plans import search
from tessera.session import written


def _hidden() -> Column:
    """Sensitive text asked for by a question that wants secret values."""
    sensitive = routing.is_sensitive_file(F.col("file_path")) | F.coalesce(F.col("security_censored"), F.lit(False))
    return routing.asks_for_secret_value(F.col("query")) & sensitive


def cite(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The cited sources of each question, in rank order, with protected text hidden."""
    rows = hits.join(questions.select("qid", "query"), "qid").join(chunks, "chunk_id")
    shown = F.when(_hidden(), K.HIDDEN_SOURCE_TEXT).otherwise(F.col("text"))
    source = F.concat(F.lit("Source ["), (F.col("rank") + 1).cast("string"), F.lit("]"))
    return rows.select(
        "qid", "rank", source.alias("source"), shown.alias("text"), "file_path", "branch", "commit_sha", "language",
        "function_name", "class_name", "section_title", "start_line", "end_line", "score", "source_type",
    )


def _block() -> Column:
    c = F.col
    text = F.when(_hidden(), K.HIDDEN_SOURCE_TEXT).otherwise(c("text"))
    code_text = F.when(_hidden(), K.HIDDEN_SOURCE_TEXT).otherwise(F.coalesce("full_body", "text"))
    has = lambda name: F.coalesce(c(name), F.lit("")) != ""
    lines = F.when(F.coalesce(c("start_line"), F.lit(0)) * F.coalesce(c("end_line"), F.lit(0)) != 0,
                   F.concat(F.lit("Lines: "), c("start_line").cast("string"), F.lit("-"), c("end_line").cast("string"), F.lit("\n"))).otherwise("")
    optional = lambda name, label: F.when(has(name), F.concat(F.lit(label), c(name), F.lit("\n"))).otherwise("")
    numbered = lambda label, number: F.concat(F.lit(label), F.coalesce(c(number).cast("string"), F.lit("None")), F.lit(" ("),
                                              F.coalesce(c("state"), F.lit("None")), F.lit(")\n"))
    content = F.concat(F.lit("Content:\n"), text, F.lit("\n"))
    body = (
        F.when(c("source_type") == "code", F.concat(
            F.lit("Type: Code ("), c("language"), F.lit(")\n"), optional("function_name", "Function/Class: "), lines,
            F.lit("```"), c("language"), F.lit("\n"), code_text, F.lit("\n```\n")))
        .when(c("source_type") == "issue", F.concat(numbered("Type: Issue #", "issue_number"), content))
        .when(c("source_type") == "pr", F.concat(numbered("Type: Pull Request #", "pr_number"), content))
        .otherwise(F.concat(optional("section_title", "Section: "), content))
    )
    head = F.concat(F.lit("--- Source ["), (c("rank") + 1).cast("string"), F.lit("] ---\nFile: "), c("file_path"), F.lit("\n"))
    return F.concat(head, optional("branch", "Branch: "), optional("commit_sha", "Commit: "), body)


def contexts(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, context, prompt): the text handed to a generator; hits per question are few by construction."""
    rows = hits.join(questions.select("qid", "query"), "qid").join(chunks, "chunk_id").select("qid", "rank", _block().alias("block"))
    joined = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_b"))
    with_context = questions.select("qid", "query").join(joined, "qid", "left").withColumn(
        "context", F.coalesce(F.array_join(F.col("_b.block"), "\n"), F.lit("")))
    prompt = F.concat(F.lit("Context from codebase:\n"), F.col("context"), F.lit("\n\nUser Question:\n"), F.col("query"), F.lit("\n"))
    return with_context.select("qid", "context", prompt.alias("prompt"))


def route_questions(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, route, tool, target, retrieval_mode, fallback_used): how each question will be answered.

    A named target is looked up in the graph; if the graph knows nothing about it the question falls
    back to plain retrieval.  A graph-style question without a target also falls back.
    """
    routed = questions.select("qid", "user_id", "query").withColumns({
        "route": routing.route(F.col("query")), "_t": routing.graph_target(F.col("query"))})
    routed = routed.select("qid", "user_id", "route", F.col("_t.tool").alias("tool"), F.col("_t.target").alias("target"))
    named = routed.where(F.col("target").isNotNull()).select("user_id", F.col("target").alias("name"), "tool").distinct()
    wanted = lambda tool: named.where(F.col("tool") == tool).select("user_id", "name")
    calls = graph_query.call_graph(nodes, edges, wanted("get_call_graph"), limit=1).select("user_id", "name", F.lit("get_call_graph").alias("tool"))
    imports = graph_query.importers(nodes, edges, wanted("get_dependencies"), limit=1).select("user_id", "name")
    declared = graph_query.declared_version(nodes, edges, wanted("get_dependencies")).select("user_id", "name")
    depends = imports.unionByName(declared).withColumn("tool", F.lit("get_dependencies"))
    known = calls.unionByName(depends).distinct().select(
        "user_id", F.col("name").alias("target"), "tool", F.lit(True).alias("_found"))
    out = routed.join(known, ["user_id", "target", "tool"], "left")
    asked, found = F.col("target").isNotNull(), F.coalesce(F.col("_found"), F.lit(False))
    mode = (
        F.when(asked & found, "hybrid").when(asked, "semantic_fallback").when(F.col("route") == "graph", "hybrid").otherwise(F.col("route"))
    )
    fallback = (asked & ~found) | (~asked & (F.col("route") == "graph"))
    return out.select("qid", "route", "tool", "target", mode.alias("retrieval_mode"), fallback.alias("fallback_used"))


def routed_trace(routed: DataFrame, hit_counts: DataFrame) -> DataFrame:
    """(qid, step, kind, tool, summary): the steps taken for each routed question.  `hit_counts`: qid, n."""
    rows = routed.join(hit_counts, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    graph = F.struct(F.lit("graph").alias("kind"), F.coalesce("tool", F.lit("graph_router")).alias("tool"),
                     F.when(F.col("tool").isNull(), "No symbol named in a graph question; plain retrieval used")
                     .when(F.col("fallback_used"), F.concat(F.lit("No graph data found for "), F.col("target")))
                     .otherwise(F.concat(F.lit("Found graph data for "), F.col("target"))).alias("summary"))
    search = F.struct(F.lit("semantic").alias("kind"), F.lit("hybrid_vector_search").alias("tool"),
                      F.concat(F.lit("Retrieved "), F.col("n").cast("string"), F.lit(" cited chunks")).alias("summary"))
    with_graph = (F.col("route") == "graph") | F.col("target").isNotNull()
    steps = F.when(with_graph, F.array(graph, search)).otherwise(F.array(search))
    return rows.select("qid", F.posexplode(steps).alias("_i", "s")).select("qid", (F.col("_i") + 1).alias("step"), "s.*")


class Answers(NamedTuple):
    """How each question was routed, what was found for it, and the steps taken."""

    routed: DataFrame
    hits: DataFrame
    trace: DataFrame


def answer_questions(questions: DataFrame, index: search.Index, nodes: DataFrame, edges: DataFrame, k: int = K.DEFAULT_TOP_K) -> Answers:
    """Routed retrieval for a batch of questions (qid, user_id, query, optional filters).

    hits: (qid, source, place, ref).  A question whose target the graph knows gets the graph's rows (callers and callees, or
    importing files), in name order, and all get their k best chunks; a question that the graph has nothing for is left with
    these, by an anti-join, and its route says so.
    """
    routed = written(route_questions(questions, nodes, edges), "routed")
    found = routed.where(~F.col("fallback_used") & F.col("target").isNotNull()).join(questions.select("qid", "user_id"), "qid")
    named = lambda tool: found.where(F.col("tool") == tool).select("qid", "user_id", F.col("target").alias("name"))
    calls = graph_query.call_graph(nodes, edges, named("get_call_graph").select("user_id", "name").distinct())
    calls = named("get_call_graph").join(calls, ["user_id", "name"]).select("qid", F.concat_ws(" ", "direction", "other_name").alias("ref"))
    paths = graph_query.importers(nodes, edges, named("get_dependencies").select("user_id", "name").distinct())
    paths = named("get_dependencies").join(paths, ["user_id", "name"]).select("qid", F.concat(F.lit("importer "), "path").alias("ref"))
    in_order = Window.partitionBy("qid").orderBy("ref")
    graph = calls.unionByName(paths).distinct().select("qid", F.lit("graph").alias("source"), (F.row_number().over(in_order) - 1).alias("place"), "ref")
    best = search.search(questions, index, k).select("qid", F.lit("semantic").alias("source"), F.col("rank").alias("place"), F.col("chunk_id").cast("string").alias("ref"))
    hits = written(graph.unionByName(best), "hits")
    counts = hits.where("source = 'semantic'").groupBy("qid").agg(F.count("*").alias("n"))
    return Answers(routed, hits, routed_trace(routed, counts))


def _names(names: DataFrame) -> DataFrame:
    return names.select("user_id", "name").distinct()


def call_graph_answers(nodes: DataFrame, edges: DataFrame, names: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """(user_id, name, answer): callers and callees of each named function as readable text.

    Equal lines are counted inside tasks before anything moves, so a name with very many calls gathers its different lines alone.
    """
    line = ["user_id", "name", "direction", "other_name", "other_repo"]
    found = graph_query.call_graph(nodes, edges, names, repo, branch).groupBy(*line).agg(F.count("*").alias("n"))
    entry = F.struct("other_name", "other_repo", "n")
    side = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, entry)))
    sides = found.groupBy("user_id", "name").agg(side("caller").alias("_in"), side("callee").alias("_out"))
    none = F.array().cast("array<struct<other_name:string,other_repo:string,n:bigint>>")
    rows = _names(names).join(sides, ["user_id", "name"], "left")
    answer = graph_query.call_graph_text(F.col("name"), F.coalesce("_in", none), F.coalesce("_out", none))
    return rows.select("user_id", "name", answer.alias("answer"))


def file_history_answers(nodes: DataFrame, edges: DataFrame, needles: list[str], user_id: str) -> DataFrame:
    """(needle, answer): the newest pull requests that touched files whose path contains each needle."""
    own = nodes.where(F.col("user_id") == user_id)
    files = graph_query.matching_paths(own, needles)
    found = graph_query.file_history(files.select("id", "needle"), own, edges, ["needle"])
    closes = F.when(F.col("issue_number").isNotNull(), F.concat(F.lit(" (Closes Issue #"), F.col("issue_number").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- PR #"), F.col("pr_number").cast("string"), F.lit(" ("), F.coalesce("pr_state", F.lit("None")), F.lit("): "),
                    F.coalesce("pr_title", F.lit("None")), closes, F.lit("\n"))
    order = F.struct((-F.col("pr_number")).alias("o"), F.col("issue_number"), line.alias("line"))
    texts = found.groupBy("needle").agg(F.array_sort(F.collect_list(order)).alias("_l"))
    asked = nodes.sparkSession.createDataFrame([(n,) for n in needles], "needle string")
    text = F.concat(F.lit("History for file '"), F.col("needle"), F.lit("':\n"), F.array_join(F.col("_l.line"), ""))
    missing = F.concat(F.lit("No PR history found for file containing '"), F.col("needle"), F.lit("'"))
    return asked.join(texts, "needle", "left").select("needle", F.when(F.col("_l").isNull(), missing).otherwise(text).alias("answer"))


def dependency_answers(nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(user_id, name, answer): the declared version and the importing files of each module."""
    files = graph_query.importers(nodes, edges, modules).groupBy("user_id", "name").agg(F.array_sort(F.collect_list("path")).alias("_p"))
    versions = graph_query.declared_version(nodes, edges, modules)
    rows = _names(modules).join(files, ["user_id", "name"], "left").join(
        versions.withColumn("_d", F.lit(True)), ["user_id", "name"], "left")
    declared = F.when(F.col("_d"), F.concat(F.lit("Declared with version "), F.coalesce("version", F.lit("None")), F.lit("\n"))).otherwise("")
    listed = F.when(F.col("_p").isNotNull(), F.array_join(F.transform("_p", lambda p: F.concat(F.lit("  - "), p, F.lit("\n"))), "")).otherwise("")
    nothing = F.when(F.col("_p").isNull() & F.col("_d").isNull(), "  nothing known\n").otherwise("")
    answer = F.concat(F.lit("Uses of "), F.col("name"), F.lit("\n"), declared,
                      F.lit("Imported by:\n"), listed, nothing)
    return rows.select("user_id", "name", answer.alias("answer"))


def code_answers(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, answer): code hits of each question as readable snippets, best first."""
    c = F.col
    shown = lambda name: F.coalesce(c(name).cast("string"), F.lit("None"))
    symbol = F.coalesce(F.nullif("function_name", F.lit("")), F.nullif("class_name", F.lit("")), F.lit("N/A"))
    block = F.concat(F.lit("FILE: "), c("file_path"), F.lit("\nFUNCTION/CLASS: "), symbol, F.lit("\nLINES: "), shown("start_line"), F.lit("-"),
                     shown("end_line"), F.lit("\nSNIPPET:\n```\n"), c("text"), F.lit("\n```\n"))
    rows = hits.join(chunks, "chunk_id").select("qid", F.struct("rank", block.alias("block")).alias("_b"))
    blocks = rows.groupBy("qid").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    return blocks.select("qid", F.array_join(F.col("_b.block"), "\n---\n").alias("answer"))
