"""Every registered query against its SQL on the same tables, and the shape of every plan."""

import io
from contextlib import redirect_stdout

import pytest
from harness import compare, connect
from pyspark.sql import functions as F

from tessera.catalog import ORACLES, QUERIES
from tessera.catalog.registry import Inputs
from tessera.operators import graph_query


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, folder, name):
    # At the smallest scale a scope may select nothing, so an empty result is fine if SQL agrees.
    ok, note = compare(spark, con, folder, name)
    assert ok or note.startswith("0 rows"), note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.endswith("_stream")])
def test_no_cross_joins(spark, folder, name):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, folder).explain()
    plan = out.getvalue()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["sparse_topk", "dense_topk", "upsert_latest", "event_retention", "sample_rows", "latest_stage", "history_last5", "quota_rejections"])
def test_ranking_prunes_before_the_shuffle(spark, folder, name):
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, folder).explain()
    assert "WindowGroupLimit" in out.getvalue()


@pytest.mark.parametrize("limited", ["callers", "neighbours"])
def test_limits_prune_before_the_shuffle(spark, folder, limited):
    t = Inputs(spark, folder)
    names = t.v_functions.select("user_id", "name")
    found = graph_query.call_graph(t.v_functions, t.v_calls, names, limit=3) if limited == "callers" else graph_query.explore_all(t.v_nodes, t.v_edges, limit=3)
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain()
    assert "WindowGroupLimit" in out.getvalue()


def test_stream_parts_are_written_by_many_tasks(spark, folder):
    import glob
    import os

    from tessera.catalog import streams
    from tessera.catalog.registry import Inputs

    t, seen = Inputs(spark, folder), []
    run = lambda stream, at: seen.append({p: len(glob.glob(f"{at}/in/{p}/*.parquet")) for p in os.listdir(f"{at}/in")})
    streams._out_of_order(t, streams._jobs(t).repartition(4), "2024-01-16", "parts", run, again=True)
    assert [sorted(s) for s in seen] == [["1"], ["1", "2"], ["1", "2", "3"]]
    assert set(seen[-1].values()) == {4}


def test_exploring_moves_no_edges_before_the_centre_is_met(spark, folder):
    t = Inputs(spark, folder)
    none = F.create_map().cast("map<string,string>")
    nodes, edges = t.v_nodes.withColumn("props", none), t.v_edges.withColumn("props", none)
    _, links = graph_query.explore(nodes, edges, "shared", "org/parts", center="Brand#1")
    out = io.StringIO()
    with redirect_stdout(out):
        links.explain()
    lines = out.getvalue().split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "l_partkey" in line]
    assert scans
    for i in scans:  # going up from the scan of line items, the small table of the centre comes before any exchange
        above = [line for line in reversed(lines[:i]) if "Exchange hashpartitioning" in line or "LeftSemi" in line]
        assert "BroadcastHashJoin" in above[0] and "LeftSemi" in above[0]


def test_equal_call_lines_are_counted_not_gathered(spark):
    from tessera.plans.answers import call_graph_answers

    nodes = spark.range(40).select(
        F.concat(F.lit("f"), "id").alias("id"), F.lit("Function").alias("label"), F.lit("u").alias("user_id"), F.when(F.col("id") != 7, "r").alias("repo"),
        F.lit(None).cast("string").alias("branch"), F.when(F.col("id") == 0, "hub").when(F.col("id") < 39, "leaf").otherwise("lone").alias("name"))
    calls = spark.range(1, 39).select(F.concat(F.lit("f"), "id").alias("src"), F.lit("f0").alias("dst"), F.lit("CALLS").alias("rel_type"))
    answers = call_graph_answers(nodes, calls, nodes.select("user_id", "name"))
    got = {r["name"]: r["answer"] for r in answers.collect()}
    assert got["hub"] == "Calls of hub\n\nCalled by:\n" + "  - leaf (in r)\n" * 37 + "\nCalls itself:\n  nothing known\n"
    assert got["leaf"].endswith("Calls itself:\n" + "  - hub (in r)\n" * 37 + "  - hub (in r)\n")
    assert got["lone"] == "The graph knows no calls of lone"
    out = io.StringIO()
    with redirect_stdout(out):
        answers.explain("formatted")
    assert "partial_count(1)" in out.getvalue()


def test_relationship_counts_look_nodes_up_without_sorting_edges(spark):
    from tessera.operators import stats

    rows = [("a", "u1"), ("b", "u1"), ("c", "u2"), ("b", "u2"), (None, "u1"), ("d", None)]
    nodes = spark.createDataFrame(rows, "id string, user_id string")
    links = [("a", "b", "X"), ("b", "b", "X"), ("a", "c", "X"), ("c", "b", "Y"), ("a", None, "X"), (None, "a", "X"), ("d", "d", "X"), ("a", "gone", "X")]
    edges = spark.createDataFrame(links, "src string, dst string, rel_type string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stats.rel_counts(nodes, edges, ["user_id"])
        got = {tuple(r) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # b stands twice, once a tenant; equal ids meet as in SQL's joins.
    assert got == {("u1", "X", 2), ("u2", "X", 1), ("u2", "Y", 1)}
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_ends_of_edges_are_checked_without_sorting_edges(spark):
    from tessera.operators import maintenance

    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    links = [("a", "X", "b", 1, "old"), ("a", "X", "b", 2, "new"), ("b", "X", "b", 1, "self"), ("a", "X", "gone", 1, "v"), ("gone", "X", "a", 1, "v"), (None, "X", "a", 1, "v")]
    edges = spark.createDataFrame(links, "src string, rel_type string, dst string, seq long, v string").select(
        "src", F.lit("CALLS").alias("rel_type"), "dst", *[F.lit("u").alias(c) for c in ("user_id", "repo", "branch")], F.create_map(F.lit("v"), "v").alias("props"), "seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = maintenance.merge_edges(edges.drop("seq").where("src = 'b'"), edges, nodes)
        got = sorted((r["src"], r["dst"], r["props"]["v"]) for r in found.collect())
        checked = maintenance.connected_edges(edges, nodes)
        plan = checked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", "b", "new"), ("b", "b", "self")]
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_graph_summaries_tell_keys_apart_by_short_hashes(spark):
    import hashlib

    from tessera.catalog import graph

    nodes = spark.createDataFrame([("File", "a"), ("File", "a"), ("File", "b|c"), ("Commit", "a"), ("File", None), ("File", "")], "label string, raw_id string")
    edges = spark.createDataFrame([("x", "File", "y"), ("x", "File", "y"), ("x|File", "File", "y"), ("y", "File", "x")], "src string, rel_type string, dst string")
    found = graph._summary((nodes, edges))
    head = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    want = {("node", "File"): ["File|a", "File|b|c", "File", "File|"], ("node", "Commit"): ["Commit|a"],
            ("edge", "File"): ["x|File|y", "x|File|File|y", "y|File|x"]}
    got = {(r["kind"], r["name"]): (r["n"], r["keys"]) for r in found.collect()}
    assert got == {k: (len(v), sum(map(head, v))) for k, v in want.items()}
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert moved and not any("k#" in line for line in moved) and any("md5#" in line for line in moved)


def test_commits_meet_their_files_without_sorting(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["commit_graph"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
