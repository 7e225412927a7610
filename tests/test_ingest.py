"""Whole runs: idempotence, refresh, rollback, tenants, tables, webhooks."""

import json
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_code import JS_MIXED, PY_BASIC

from tessera import schemas
from tessera.catalog import QUERIES
from tessera.operators import maintenance
from tessera.plans import answers, ingest, overview, search
from tessera.sources import artifacts, tables
from tessera.sources.files import read_checkout
from tessera.streaming import progress, quota, webhooks

README = "# App\nThis describes the application in a few words.\n\n## Use\nRun it, then look at what it prints to the screen."
SOURCES = {
    "README.md": README,
    "pkg/a.py": PY_BASIC,
    "web/k.js": JS_MIXED,
    "requirements.txt": "requests==2.31.0\nflask\n",
    "web/package.json": '{"dependencies": {"react": "18"}, "name": "the web part of the application"}',
    "conf/app.json": '{"db": {"token": "abcdefabcdefabcdef", "host": "localhost", "port": 5432}}',
    "node_modules/x/y.js": "ignored();",
    "logo.png": "binary",
}


def files(spark, sources, users=("u1",), repo="org/app"):
    rows = [(u, False, repo, "main", "c1", p, len(s), None, s) for u in users for p, s in sources.items()]
    return spark.createDataFrame(rows, schemas.FILES)


def previous(files_df):
    ready = ingest.prepare_files(files_df)
    return ready.select("user_id", "repo", "branch", "path", "file_sha")


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CONTENT = ("user_id", "file_path", "chunk_type", "chunk_id", "text")
EDGE = ("src", "rel_type", "dst")


@pytest.fixture(scope="module")
def first(spark):
    chunks, nodes, edges = ingest.ingest(files(spark, SOURCES, ("u1", "u2")), "run1", 1)
    return chunks.cache(), nodes.cache(), edges.cache()


def test_chunks(first):
    chunks, _, _ = first
    paths = {r["file_path"] for r in chunks.select("file_path").collect()}
    assert paths >= {"README.md", "pkg/a.py", "web/k.js", "web/package.json", "conf/app.json"}
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    config = chunks.where("file_path = 'conf/app.json' and user_id = 'u1'").first()
    assert config["security_censored"] and config["secrets_redacted"] == 1 and "abcdef" not in config["text"]


def test_graph(first):
    _, nodes, edges = first
    ids = {r["id"] for r in nodes.select("id").collect()}
    for e in edges.collect():
        assert e["src"] in ids and e["dst"] in ids
        assert e["src"].split("::")[0] == e["dst"].split("::")[0] == e["user_id"]
    found = {(r["label"], r["raw_id"], r["name"]) for r in nodes.where("user_id = 'u1'").collect()}
    assert ("Function", "org/app::main::pkg/a.py::func::helper", "helper") in found
    assert ("Module", "npm::react", "react") in found and ("Dependency", "pip::requests::2.31.0", "requests") in found
    assert nodes.count() == nodes.select("label", "id").distinct().count()
    assert edges.count() == edges.select(*EDGE).distinct().count()
    repo = nodes.where("label = 'Repository' and user_id = 'u1'").first()
    assert repo["props"]["full_name"] == "org/app" and repo["props"]["ingest_run_id"] == "run1"


def test_second_run_changes_nothing(spark, first):
    chunks, nodes, edges = first
    source = files(spark, SOURCES, ("u1", "u2"))
    again = maintenance.upsert_chunks(chunks, ingest.chunk_files(ingest.prepare_files(source), "run1", 1))
    assert rows_of(again, *CONTENT) == rows_of(chunks, *CONTENT)
    same_chunks, same_nodes, same_edges = ingest.refresh(chunks, nodes, edges, source, previous(source), "run2", 2)
    assert rows_of(same_chunks, *CONTENT, "ingest_run_id") == rows_of(chunks, *CONTENT, "ingest_run_id")
    assert rows_of(same_nodes, "id") == rows_of(nodes, "id") and rows_of(same_edges, *EDGE) == rows_of(edges, *EDGE)


def test_refresh_equals_fresh_run(spark, first):
    chunks, nodes, edges = first
    changed = {k: v for k, v in SOURCES.items() if k != "web/k.js"}
    changed["pkg/a.py"] = PY_BASIC.replace("def first", "def renamed").replace("first(1)", "renamed(1)")
    changed["docs/new.md"] = "# New\nA new page with enough words to be kept."
    old, new = files(spark, SOURCES, ("u1", "u2")), files(spark, changed, ("u1", "u2"))
    got = ingest.refresh(chunks, nodes, edges, new, previous(old), "run2", 2)
    want = ingest.ingest(new, "run2", 2)
    assert rows_of(got[0], *CONTENT) == rows_of(want[0], *CONTENT)
    runs = {r["file_path"]: r["ingest_run_id"] for r in got[0].collect()}
    assert runs["README.md"] == "run1" and runs["pkg/a.py"] == "run2"
    assert rows_of(got[2], *EDGE) == rows_of(want[2], *EDGE)
    # Shared targets (modules) of removed files stay behind as nodes without edges, as they may be used elsewhere.
    assert set(rows_of(want[1], "id")) <= set(rows_of(got[1], "id"))
    assert all("web/k.js" not in i for (i,) in rows_of(got[1], "id"))


def test_roll_back(spark, first):
    chunks, _, _ = first
    extra = ingest.chunk_files(ingest.prepare_files(files(spark, {"x.md": "# X\nA page that a failed run had added."})), "bad", 9)
    both = maintenance.upsert_chunks(chunks, extra)
    assert both.count() > chunks.count()
    assert rows_of(maintenance.roll_back_run(both, "u1", "org/app", "main", "bad"), *CONTENT) == rows_of(chunks, *CONTENT)


def test_tenants_stay_apart(spark, first):
    chunks, nodes, edges = first
    left = maintenance.delete_repo(chunks, "u1", "org/app")
    assert rows_of(left, *CONTENT) == rows_of(chunks.where("user_id = 'u2'"), *CONTENT)
    kept_nodes, kept_edges = maintenance.detach_delete(nodes, edges, maintenance.repo_subgraph(nodes, "u1", "org/app"))
    assert {r["user_id"] for r in kept_edges.collect()} == {"u2"}
    assert kept_nodes.where("user_id = 'u2'").count() == nodes.where("user_id = 'u2'").count()
    with pytest.raises(ValueError):
        maintenance.delete_repo(chunks, "", "org/app")


def test_part_identity_modes(spark):
    long = "\n\n".join("para %d " % i + "w" * 700 for i in range(6))
    ready = ingest.prepare_files(files(spark, {"long.txt": long}))
    assert ingest.chunk_files(ready, "r", 1).count() == 3
    only = ingest.chunk_files(ready, "r", 1, id_mode="reference").collect()
    assert len(only) == 1 and "para 5" in only[0]["text"]


def test_merge_nulls_and_order(spark):
    ddl = "label string, raw_id string, user_id string, is_public boolean, repo string, branch string, props map<string,string>, seq bigint"
    none = spark.createDataFrame([], schemas.NODES)
    at = lambda props, seq: ("File", "r::a", "u", False, "r", "main", props, seq)
    incoming = spark.createDataFrame([at({"x": "1", "y": "1"}, 1), at({"x": None, "y": "3"}, 3), at({"y": "2"}, 2)], ddl)
    assert maintenance.merge_nodes(none, incoming).first()["props"] == {"x": "1", "y": "3"}
    assert maintenance.merge_nodes(none, incoming, null_removes=True).first()["props"] == {"y": "3"}
    with pytest.raises(Exception, match="unsupported node label"):
        maintenance.merge_nodes(none, incoming.withColumn("label", F.lit("Nope"))).collect()


def test_search_and_answers(spark, first):
    chunks, nodes, edges = first
    index = search.index_chunks(chunks)
    asked = spark.createDataFrame([(1, "u1", "what does helper return", None), (2, "u2", "show the secret token of the db host", None), (3, "nobody", "helper", None)],
                                  "qid long, user_id string, query string, language string")
    hits = search.search(asked, index).cache()
    seen = hits.join(chunks, "chunk_id")
    assert {(r["qid"], r["user_id"]) for r in seen.collect()} == {(1, "u1"), (2, "u2")}
    assert hits.groupBy("qid").count().where("count > 7").count() == 0
    assert {r["source_type"] for r in search.search_code(asked, index).join(chunks, "chunk_id").collect()} == {"code"}
    cited = answers.cite(hits, asked, chunks).where("file_path = 'conf/app.json' and qid = 2").collect()
    assert cited and all(r["text"].startswith("[REDACTED: sensitive") for r in cited)
    context = answers.contexts(hits, asked, chunks).where("qid = 1").first()
    assert "--- Source [1] ---\nFile: " in context["prompt"] and context["prompt"].endswith("what does helper return\n")
    routed = answers.route_questions(spark.createDataFrame([(1, "u1", "who calls helper"), (2, "u1", "who calls missing"), (3, "u1", "imports"), (4, "u2", "who imports os")],
                                                           "qid long, user_id string, query string"), nodes, edges)
    assert {r["qid"]: (r["retrieval_mode"], r["fallback_used"]) for r in routed.collect()} == {
        1: ("hybrid", False), 2: ("semantic_fallback", True), 3: ("hybrid", True), 4: ("hybrid", False)}
    trace = answers.routed_trace(routed, hits.groupBy("qid").agg(F.count("*").alias("n")))
    assert trace.where("qid = 1").count() == 2
    assert "helper" in "".join(r["line"] for r in search.file_outline(chunks).where("file_path = 'pkg/a.py'").collect())
    assert overview.readme_pick(chunks).where("user_id = 'u1'").first()["readme"].startswith("# App")


def test_search_needs_a_tenant(spark, first):
    asked = spark.createDataFrame([(1, None, "helper")], "qid long, user_id string, query string")
    with pytest.raises(Exception, match="tenant is required"):
        search.search(asked, search.index_chunks(first[0])).collect()


def test_checkout(spark):
    import hashlib
    import os

    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{root}/a b/c")
    for path, data in {"x.py": b"ok\n", "a b/c/y.md": "ü".encode() + b"\xff\xfe!", "big.txt": b"z" * 600_000}.items():
        with open(f"{root}/{path}", "wb") as f:
            f.write(data)
    got = {r["path"]: r for r in read_checkout(spark, root).collect()}
    assert set(got) == {"x.py", "a b/c/y.md", "big.txt"}
    text = ("ü".encode() + b"\xff\xfe!").decode("utf8", errors="replace")
    assert got["a b/c/y.md"]["content"] == text and got["a b/c/y.md"]["file_sha"] == hashlib.sha1(text.encode()).hexdigest()
    assert got["big.txt"]["content"] == "z" * 600_000
    assert {r["path"] for r in read_checkout(spark, root, max_bytes=1000).collect()} == {"x.py", "a b/c/y.md"}


def test_node_and_edge_tables_lose_a_vanished_repository(spark, first):
    _, nodes, edges = first
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, rows, write, ddl in (("nodes", nodes, tables.write_nodes, schemas.NODES), ("edges", edges, tables.write_edges, schemas.EDGES)):
        path, columns = f"{root}/{name}", ["user_id", "repo", *schemas.columns_of(ddl)[:2]]
        write(rows, path)
        assert rows_of(tables.read_table(spark, path, ddl), *columns) == rows_of(rows, *columns)
        left = rows.where("user_id = 'u2'")
        write(left, path)
        assert rows_of(tables.read_table(spark, path, ddl), *columns) == rows_of(left, *columns)


def test_artifacts_of_two_kinds(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/artifacts"
    ddl = "kind string, user_id string, repo string, branch string, commit_sha string, text string, written_at timestamp"
    at = datetime(2024, 1, 1)
    artifacts.append_artifact(spark.createDataFrame([("snapshot", "u", "r", "main", "c", "one", at), ("health", "u", "r", "main", "c", "two", at)], ddl), path)
    artifacts.append_artifact(spark.createDataFrame([("snapshot", "u", "r", "main", "c", "newer", datetime(2024, 1, 2))], ddl), path)
    fresh = artifacts.fresh_artifacts(spark.read.schema(ddl).parquet(path), F.lit(datetime(2024, 1, 3)), 7 * 86400)
    asked = spark.createDataFrame([("snapshot", "u", "r", "main", "c"), ("health", "u", "r", "main", "c"), ("health", "u", "r", "main", None)], "kind string, user_id string, repo string, branch string, commit_sha string")
    assert rows_of(artifacts.lookup(asked, fresh, F.lit("-")), "kind", "text", "cached") == [("health", "-", False), ("health", "two", True), ("snapshot", "newer", True)]
    assert artifacts.fresh_artifacts(spark.read.schema(ddl).parquet(path), F.lit(datetime(2024, 1, 3)), 3600).count() == 0


def test_partition_replacement(spark, first):
    chunks, _, _ = first
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/chunks"
    assert tables.read_table(spark, path, schemas.CHUNKS).count() == 0
    tables.write_chunks(chunks, path)
    stored = tables.read_table(spark, path, schemas.CHUNKS)
    assert rows_of(stored, *CONTENT) == rows_of(chunks, *CONTENT)
    gone = tables.with_chunk_partitions(stored.where("user_id = 'u1'"))
    tables.replace_partitions(gone.limit(0), path, tables.CHUNK_PARTITIONS, gone)
    assert rows_of(tables.read_table(spark, path, schemas.CHUNKS), *CONTENT) == rows_of(chunks.where("user_id = 'u2'"), *CONTENT)
    # A table that loses a tenant and gains another: the first leaves nothing behind.
    tables.write_chunks(chunks.where("user_id = 'u1'"), path)
    assert rows_of(tables.read_table(spark, path, schemas.CHUNKS), *CONTENT) == rows_of(chunks.where("user_id = 'u1'"), *CONTENT)
    tables.drop_all(spark, path, schemas.CHUNKS, tables.CHUNK_PARTITIONS)
    assert tables.read_table(spark, path, schemas.CHUNKS).count() == 0


def test_readers_and_batches_open_only_the_named_partitions(spark, first):
    chunks, _, _ = first
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/chunks"
    more = chunks.withColumn("branch", F.lit("dev")).withColumn("chunk_id", F.concat("chunk_id", F.lit("-dev")))
    tables.write_chunks(chunks.unionByName(more), path)
    version = tables.current_version(spark, path)
    before = set(tables.read_table(spark, path, schemas.CHUNKS).inputFiles())
    only = spark.createDataFrame([("u1", "main")], "tenant string, p_branch string")
    some = tables.read_table(spark, path, schemas.CHUNKS, only, tables.CHUNK_PARTITIONS)
    assert some.inputFiles() and all("tenant=u1" in f and "p_branch=main" in f for f in some.inputFiles())
    assert rows_of(some, *CONTENT) == rows_of(chunks.where("user_id = 'u1'"), *CONTENT)
    # A push to one branch leaves the files of all others as they are, and a failed merge changes nothing.
    changes = spark.createDataFrame([("u1", False, "org/app", "main", "README.md", "remove", datetime(2024, 1, 1), "d1")], webhooks.MARKS)
    with pytest.raises(Exception):
        tables.merge_chunks(spark, path, changes, lambda rows: rows.withColumn("text", F.raise_error(F.lit("broken"))))
    assert tables.current_version(spark, path) == version
    webhooks.apply_pushes(changes, path, lambda c: files(spark, {}), "push-1", 2)
    after = set(tables.read_table(spark, path, schemas.CHUNKS).inputFiles())
    assert {f for f in before if f not in after} and all("tenant=u1" in f and "p_branch=main" in f for f in before ^ after)
    left = chunks.unionByName(more).where("not (user_id = 'u1' and branch = 'main' and file_path = 'README.md')")
    assert rows_of(tables.read_table(spark, path, schemas.CHUNKS), *CONTENT) == rows_of(left, *CONTENT)
    tables.vacuum(spark, path)
    assert rows_of(tables.read_table(spark, path, schemas.CHUNKS), *CONTENT) == rows_of(left, *CONTENT)


def test_merges_hand_on_untouched_rows(spark):
    """Only rows whose key comes in are ranked or taken apart."""
    existing = spark.createDataFrame([(f"n{k}", "File", f"n{k}", "u", False, "r", "main", None, None, {"a": "1"}) for k in range(50)], schemas.NODES)
    held = existing.withColumn("id", F.concat(F.lit("u::"), "id"))
    ddl = "label string, raw_id string, user_id string, is_public boolean, repo string, branch string, props map<string,string>, seq bigint"
    incoming = spark.createDataFrame([("File", "n7", "u", False, "r", "main", {"b": "2"}, 1), ("File", "new", "u", False, "r", "main", {"c": "3"}, 1)], ddl)
    merged = maintenance.merge_nodes(held, incoming)
    got = {r["id"]: r["props"] for r in merged.collect()}
    assert len(got) == 51 and got["u::n7"] == {"a": "1", "b": "2"} and got["u::new"] == {"c": "3"} and got["u::n8"] == {"a": "1"}


def test_refresh_reads_content_of_changed_files_alone(spark, first):
    """Files whose hash is known and unchanged may hold anything: their content is not looked at."""
    chunks, nodes, edges = first
    source = files(spark, SOURCES, ("u1", "u2")).withColumn("file_sha", F.sha1(F.col("content").cast("binary")))
    known = source.select("user_id", "repo", "branch", "path", "file_sha")
    broken = F.when(F.col("path") == "docs/new.md", F.col("content")).otherwise(F.lit("changed without its hash"))
    new = files(spark, {"docs/new.md": "# New\nA new page with words."}, ("u1",)).withColumn("file_sha", F.lit("s"))
    got = ingest.refresh(chunks, nodes, edges, source.unionByName(new).withColumn("content", broken), known, "run2", 2)
    assert {r["file_path"] for r in got[0].where("ingest_run_id = 'run2'").collect()} == {"docs/new.md"}
    assert rows_of(got[0].where("ingest_run_id = 'run1'"), *CONTENT) == rows_of(chunks, *CONTENT)


def test_expired_jobs_are_told_once_however_late_an_event_comes(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ddl = "job_id string, ts timestamp, state string"
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [[("a", t(1), "done"), ("b", t(1), "running")], [("c", t(9), "running")], [("a", t(0), "running"), ("d", t(0, 30), "done")], [("a", t(9, 30), "running"), ("c", t(9, 59), "done")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    got = progress.job_expiry(stream, f"{root}/jobs", max_age_seconds=3600, keep_seconds=3600)
    assert sorted((r["job_id"], r["created_at"]) for r in got.collect()) == [("a", t(0)), ("d", t(0, 30))]
    held = tables.read_table(spark, f"{root}/jobs/ages", progress.AGES, partitions=["bucket"])
    assert "d" not in {r["job_id"] for r in held.collect()}  # its row's life is over


def delivery(i, event, **fields):
    base = {"delivery_id": f"d{i}", "ts": f"2024-01-01T00:00:{i:02d}Z", "event": event,
            "repository": {"full_name": "org/app", "name": "app", "owner": {"login": "org"}}, "ref": "refs/heads/main"}
    return json.dumps({**base, **fields})


def test_webhooks(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    push = lambda **k: [{"added": [], "modified": [], "removed": [], **k}]
    lines = [
        delivery(1, "push", commits=push(added=["a.md", "b.md", "logo.png"])),
        delivery(2, "push", commits=push(removed=["b.md"], modified=["a.md"])),
        delivery(3, "push", commits=push(removed=["c.md"], added=["c.md"])),
        delivery(4, "issues", issue={"number": 7, "title": "Bug", "state": "open", "body": 'password = "hunter22"', "user": {"login": "ann", "type": "User"}, "labels": [{"name": "Big"}]}),
        delivery(5, "pull_request", pull_request={"number": 8, "title": "Fix", "state": "closed", "body": "fixes #7", "user": {"login": "bob", "type": "User"}, "labels": []}),
        delivery(6, "star"),
    ]
    import os
    os.makedirs(f"{root}/in")
    with open(f"{root}/in/a.json", "w") as f:
        f.write("\n".join(lines))
    with open(f"{root}/in/b.json", "w") as f:
        f.write("\n".join(lines[:3]))
    targets = spark.createDataFrame([("org/app", "u1", False), ("org/app", "u2", False)], "repo string, user_id string, is_public boolean")

    def fetch(changes):
        text = F.concat(F.lit("# Page "), "path", F.lit("\nSome text that is long enough to be kept."))
        return changes.select("user_id", "is_public", "repo", "branch", F.lit("c1").alias("commit_sha"), "path", F.lit(60).cast("long").alias("size"),
                              F.lit(None).cast("string").alias("file_sha"), text.alias("content"))

    stream = webhooks.stream_webhooks(spark, f"{root}/in", files_per_trigger=1)
    webhooks.run_webhooks(stream, f"{root}/cp", targets, f"{root}/chunks", f"{root}/nodes", f"{root}/edges", fetch).awaitTermination()
    chunks = tables.read_table(spark, f"{root}/chunks", schemas.CHUNKS)
    assert rows_of(chunks, "user_id", "file_path") == [(u, p) for u in ("u1", "u2") for p in ("a.md", "c.md")]
    nodes, edges = tables.read_table(spark, f"{root}/nodes", schemas.NODES), tables.read_table(spark, f"{root}/edges", schemas.EDGES)
    assert rows_of(edges.where("user_id = 'u1'").select(F.col("rel_type")), "rel_type") == [("CLOSES",), ("LABELED",), ("OPENED",), ("OPENED",)]
    assert rows_of(nodes.where("user_id = 'u2'"), "label") == [("Contributor",), ("Contributor",), ("Issue",), ("Label",), ("PullRequest",)]
    # Applying the same changes again leaves the table as it is.
    changes = webhooks.push_changes(spark.read.schema(schemas.WEBHOOKS).json(f"{root}/in"), targets)
    before = rows_of(chunks, *CONTENT)
    webhooks.apply_pushes(changes, f"{root}/chunks", fetch, "again", 99)
    assert rows_of(tables.read_table(spark, f"{root}/chunks", schemas.CHUNKS), *CONTENT) == before


def test_merges_that_store_give_what_others_give(spark):
    from tessera.session import written

    rows = [("Issue", "a", {"x": "1", "n": None}, 1), ("Issue", "b", {"x": "1"}, 1), ("Issue", "b", {"x": "1", "n": None}, 2), ("Issue", "c", {"x": "1", "y": "1"}, 1),
            ("Issue", "c", {"x": None, "y": "2"}, 2), ("Issue", "d", None, 1), ("Issue", "d", {}, 1), ("Issue", "held", {"z": "9"}, 1), ("Label", "a", {"x": "2"}, 1)]
    nodes = spark.createDataFrame(rows, "label string, raw_id string, props map<string,string>, seq long").select(
        "*", F.lit("u").alias("user_id"), F.lit(False).alias("is_public"), F.lit("r").alias("repo"), F.lit("main").alias("branch"))
    held = spark.createDataFrame([("u::held", "Issue", {"y": "8", "z": "1"}), ("u::left", "Issue", {"x": "3"})], "id string, label string, props map<string,string>").select(
        "id", "label", F.substring_index("id", "::", -1).alias("raw_id"), F.lit("u").alias("user_id"), F.lit(False).alias("is_public"), F.lit("r").alias("repo"), F.lit("main").alias("branch"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("path"), "props")
    told = lambda frame, *columns: sorted((*(r[c] for c in columns), sorted(r["props"].items())) for r in frame.collect())
    for removes in (False, True):
        plain = told(maintenance.merge_nodes(held, nodes, removes), "label", "id", "repo")
        assert told(maintenance.merge_nodes(held, nodes, removes, store=written), "label", "id", "repo") == plain
        assert ("Issue", "u::held", "r", [("y", "8"), ("z", "9")]) in plain and len(plain) == 7
    links = [("u::a", "u::b", {"k": "1"}, 1), ("u::a", "u::b", {"k": "2"}, 2), ("u::a", "u::c", None, 1), ("u::a", "u::gone", {}, 1), ("u::gone", "u::a", {}, 1), (None, "u::a", {}, 1)]
    edges = spark.createDataFrame(links, "src string, dst string, props map<string,string>, seq long").select(
        "*", F.lit("CALLS").alias("rel_type"), *[F.lit("u").alias(c) for c in ("user_id", "repo", "branch")])
    ids = maintenance.merge_nodes(held, nodes)
    plain = told(maintenance.merge_edges(edges.drop("seq").where("dst = 'u::c'"), edges, ids), "src", "dst")
    assert told(maintenance.merge_edges(edges.drop("seq").where("dst = 'u::c'"), edges, ids, store=written), "src", "dst") == plain
    assert plain == [("u::a", "u::b", [("k", "2")]), ("u::a", "u::c", [])]
    plan = maintenance.connected_edges(edges, ids, spill=True)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" not in plan and plan.count("SortMergeJoin") >= 2


def test_records_are_merged_without_caching_a_batch(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    targets = spark.createDataFrame([("org/app", "u1", False)], "repo string, user_id string, is_public boolean")
    person = {"login": "ann", "type": "User"}
    issue = lambda n, title: {"number": n, "title": title, "state": "open", "user": person, "labels": []}
    batches = [
        [delivery(5, "issues", issue=issue(7, "new")), delivery(4, "issues", issue=issue(7, "old")), delivery(6, "pull_request", pull_request={"number": 8, "title": "Fix", "body": "fixes #7", "user": person})],
        [delivery(1, "issues", issue=issue(7, "older")), delivery(2, "issues", issue=issue(9, "other")), delivery(3, "issues", issue=issue(None, "no number"))],
    ]

    def refuse(*_, **__):
        raise AssertionError("cached")

    monkeypatch.setattr(type(targets), "persist", refuse)
    monkeypatch.setattr(type(targets), "cache", refuse)
    for lines in batches:
        events = spark.read.schema(schemas.WEBHOOKS).json(spark.sparkContext.parallelize(lines, 1))
        webhooks.apply_records(events, f"{root}/nodes", f"{root}/edges", targets, f"{root}/marks")
    nodes = tables.read_table(spark, f"{root}/nodes", schemas.NODES).collect()
    assert sorted((n["label"], n["props"].get("number"), n["props"].get("title")) for n in nodes if n["label"] != "Contributor") == [
        ("Issue", "7", "new"), ("Issue", "9", "other"), ("PullRequest", "8", "Fix")]
    assert [n["name"] for n in nodes if n["label"] == "Contributor"] == ["ann"]
    edges = tables.read_table(spark, f"{root}/edges", schemas.EDGES).collect()
    assert sorted((e["rel_type"], e["dst"].rpartition("::")[2]) for e in edges) == [("CLOSES", "7"), ("OPENED", "7"), ("OPENED", "8"), ("OPENED", "9")]
    marks = tables.read_table(spark, f"{root}/marks", webhooks.MARKS).collect()
    assert sorted((m["path"], m["delivery_id"]) for m in marks) == [("issue/7", "d5"), ("issue/9", "d2"), ("pr/8", "d6")]


def test_issue_chunks_are_redacted(spark):
    rows = spark.createDataFrame([("u1", False, "org/app", "main", 7, "open", ["bug"], 'Issue #7: something is wrong\npassword = "hunter22"')],
                                 "user_id string, is_public boolean, repo string, branch string, number int, state string, labels array<string>, text string")
    r = ingest.record_chunks(rows, "issue", "run1", 1).first()
    assert r["issue_number"] == 7 and r["pr_number"] is None and r["security_censored"] and "hunter22" not in r["text"]


def test_expired_jobs(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ddl = "job_id string, ts timestamp, state string"
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [[("a", t(0), "running"), ("b", t(0), "running")], [("a", t(0, 5), "done")], [("c", t(9), "running")], [("c", t(10), "running")], [("c", t(12), "running")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    expired = progress.expired_jobs(stream)
    query = expired.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["job_id"] for r in spark.read.parquet(f"{root}/out").collect()] == ["a"]


def test_progress_log_and_late_rows(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ddl = "user_id string, ts timestamp"
    days = [datetime(2024, 1, d) for d in (1, 1, 9, 9, 1)]
    for i, day in enumerate(days):
        spark.createDataFrame([("u", day)], ddl).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    done = quota.settle(quota.daily_counts(stream, ["user_id"], 1), ["user_id", "day"], f"{root}/q").orderBy("day").collect()
    assert [(r["total"], r["over_limit"]) for r in done] == [(2, True), (2, True)]
    progress.append_log(spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(f"{root}/in"), f"{root}/log", f"{root}/lcp").awaitTermination()
    assert spark.read.parquet(f"{root}/log").count() == 5


def test_daily_totals_count_late_rows(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ddl = "user_id string, ts timestamp"
    add = lambda name, day: spark.createDataFrame([("u", day)], ddl).coalesce(1).write.parquet(f"{root}/in/{name}")
    for i, day in enumerate((1, 1, 9, 9, 1)):
        add(i, datetime(2024, 1, day))

    def totals():
        stream = spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        done = quota.daily_totals(stream, ["user_id"], 2, f"{root}/q").orderBy("day")
        return [(str(r["day"]), r["total"], r["over_limit"]) for r in done.collect()]

    assert totals() == [("2024-01-01", 3, True), ("2024-01-09", 2, False)]
    # A later run goes on from the last one, and a run without new files changes nothing.
    add(5, datetime(2023, 12, 31, 23, 59, 59))
    again = totals()
    assert again == [("2023-12-31", 1, False), ("2024-01-01", 3, True), ("2024-01-09", 2, False)]
    assert totals() == again


def test_quota_query_reads_late_files_in_several_batches(spark, folder, monkeypatch):
    seen = []
    totals = quota.daily_totals
    monkeypatch.setattr(quota, "daily_totals", lambda requests, key, limit, at: (seen.append(at), totals(requests, key, limit, at))[1])
    rows = QUERIES["quota_stream"](spark, folder)
    events = spark.read.parquet(f"{folder}/events.parquet")
    assert rows.agg(F.sum("total")).first()[0] == events.count()
    batches = spark.read.parquet(f"{seen[0]}/rows").groupBy("batch").agg(F.min("day").alias("day")).orderBy("batch").collect()
    assert len(batches) > 1 and batches[0]["day"] > batches[-1]["day"]


def test_equal_texts_of_branches_are_parsed_once(spark, monkeypatch):
    from tessera.operators import chunk_code, graph_extract

    main = files(spark, {"a.py": "import os\n\ndef run(x):\n    return go(x)\n"})
    both = main.unionByName(main.withColumn("branch", F.lit("dev")))
    seen, parse, chunk = [], graph_extract.python_edges, chunk_code.code_chunks
    monkeypatch.setattr(graph_extract, "python_edges", lambda rows, *a: seen.append(rows.count()) or parse(rows, *a))
    monkeypatch.setattr(chunk_code, "code_chunks", lambda rows, *a: seen.append(rows.count()) or chunk(rows, *a))
    chunks, nodes, edges = ingest.ingest(both, "run1", 1)
    assert seen == [1, 1]
    assert {(r["branch"], r["n"]) for r in chunks.groupBy("branch").agg(F.count("*").alias("n")).collect()} == {("main", 2), ("dev", 2)}
    got = {(r["src"].split("::", 1)[1], r["rel_type"]) for r in edges.where("rel_type in ('CALLS', 'IMPORTS')").collect()}
    repo = main.first()["repo"]
    assert got == {(f"{repo}::{b}::a.py{rest}", rel) for b in ("main", "dev") for rest, rel in (("::func::run", "CALLS"), ("", "IMPORTS"))}
    assert edges.join(nodes.select("id"), edges["dst"] == nodes["id"], "left_anti").isEmpty()
