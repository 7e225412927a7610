"""Reports, logs, quotas, and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.catalog.files import SECRETS, quoted
from tessera.catalog.registry import Inputs, query, view
from tessera.catalog.retrieval import _FUSED, text_hits
from tessera.functions import props as P
from tessera.functions import routing
from tessera.operators import dense, events, hybrid, maintenance, sparse, stats
from tessera.plans import answers, overview, search
from tessera.sources import artifacts, files

_ORDER = ["ts", "event_id"]

# Questions about the graph and about history, one per document, in several phrasings.
view("v_asked", """
SELECT doc_id AS qid, 'shared' AS user_id, concat(
  CASE doc_id % 9 WHEN 0 THEN concat('What calls `fn_', cast(doc_id AS string), '` here?')
  WHEN 1 THEN concat('call graph for job.run', cast(doc_id AS string)) WHEN 2 THEN 'who imports Brand#13'
  WHEN 3 THEN 'package usage of module Brand' WHEN 4 THEN 'show the history of this file' WHEN 5 THEN 'print the API key value '
  WHEN 6 THEN 'which PR changed it' WHEN 7 THEN 'imported by Brand' ELSE 'explain ' END, ' ', lang) AS query
FROM {documents}
""")


def _has_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(term)})" for term in terms) + ")"


_ROUTE = f"CASE WHEN {_has_any('lower(query)', K.CALL_ROUTE_TERMS + K.IMPORT_ROUTE_TERMS)} THEN 'graph' WHEN {_has_any('lower(query)', K.HISTORY_ROUTE_TERMS)} THEN 'agent' ELSE 'semantic' END"
_TARGET = f"""
t AS (SELECT *, {_ROUTE} AS route,
  nullif(regexp_extract(query, {quoted(routing.CALL_PHRASE)}, 1), '') AS c1, nullif(regexp_extract(query, {quoted(routing.CALL_PHRASE)}, 2), '') AS c2,
  nullif(regexp_extract(query, {quoted(routing.IMPORT_PHRASE)}, 1), '') AS d1,
  list_filter(regexp_extract_all(query, {quoted(routing.WORD)}), lambda w: NOT list_contains([{', '.join(quoted(w) for w in K.TARGET_STOPWORDS)}], lower(w))) AS words
  FROM {{v_asked}}),
g AS (SELECT qid, user_id, query, route, CASE WHEN coalesce(c1, c2) IS NOT NULL THEN 'get_call_graph' WHEN d1 IS NOT NULL THEN 'get_dependencies'
  WHEN {_has_any('lower(query)', K.DEPENDENCY_HINTS)} AND len(words) > 0 THEN 'get_dependencies' END AS tool,
  coalesce(c1, c2, d1, CASE WHEN {_has_any('lower(query)', K.DEPENDENCY_HINTS)} THEN words[-1] END) AS target FROM t)
"""


@query("route_intent", f"SELECT qid, {_ROUTE} AS route FROM {{v_asked}}")
def route_intent(t: Inputs):
    return t.v_asked.select("qid", routing.route(F.col("query")).alias("route"))


@query("graph_intent", "WITH " + _TARGET + "SELECT qid, coalesce(tool, '') AS tool, coalesce(target, '') AS target FROM g")
def graph_intent(t: Inputs):
    rows = t.v_asked.select("qid", routing.graph_target(F.col("query")).alias("g"))
    return rows.select("qid", F.coalesce("g.tool", F.lit("")).alias("tool"), F.coalesce("g.target", F.lit("")).alias("target"))


@query("secret_requests", f"SELECT qid, {_has_any('lower(query)', K.SECRET_TERMS)} AND {_has_any('lower(query)', K.SECRET_VERBS)} AS asks FROM {{v_asked}}")
def secret_requests(t: Inputs):
    return t.v_asked.select("qid", routing.asks_for_secret_value(F.col("query")).alias("asks"))


@query("route_questions", "WITH " + _TARGET + """,
known AS (SELECT DISTINCT p_brand AS target, 'get_dependencies' AS tool FROM part UNION SELECT s_name, 'get_dependencies' FROM supplier),
j AS (SELECT g.*, k.target IS NOT NULL AS found FROM g LEFT JOIN known k ON k.target = g.target AND k.tool = g.tool)
SELECT qid, route, coalesce(tool, '') AS tool, coalesce(target, '') AS target,
  CASE WHEN target IS NOT NULL AND found THEN 'hybrid' WHEN target IS NOT NULL THEN 'semantic_fallback' WHEN route = 'graph' THEN 'hybrid' ELSE route END AS retrieval_mode,
  (target IS NOT NULL AND NOT found) OR (target IS NULL AND route = 'graph') AS fallback_used FROM j""")
def route_questions(t: Inputs):
    nodes = t.v_nodes.withColumn("props", F.create_map().cast("map<string,string>"))
    routed = answers.route_questions(t.v_asked, nodes, t.v_edges)
    return routed.withColumns({"tool": F.coalesce("tool", F.lit("")), "target": F.coalesce("target", F.lit(""))})


# Suppliers' questions about functions of a call graph, and plain ones.
view("v_call_asked", """
SELECT s_suppkey AS qid, 'u1' AS user_id, CASE WHEN s_suppkey % 4 = 3 THEN concat('how is stock number ', cast(s_suppkey AS string), ' kept')
  ELSE concat('who calls fn_', cast(s_suppkey AS string)) END AS query FROM {supplier}
""")

# Function k, where k does not leave 1 by 3, calls the one three further on.
_CALLED = """,
fn AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 1), call AS (SELECT a.k AS src, b.k AS dst FROM fn a JOIN fn b ON b.k = a.k + 3),
o AS (SELECT dst AS k, 'caller fn_' || src AS ref FROM call UNION ALL SELECT src, 'callee fn_' || dst FROM call),
j AS (SELECT g.*, (SELECT count(*) FROM o WHERE 'fn_' || o.k = g.target) AS n_graph, (SELECT least(count(*), 7) FROM {v_chunks} c WHERE c.user_id = 'u1') AS n FROM g)
"""


def answered(t: Inputs):
    none = F.lit(None).cast("string")
    some = t.part.where("p_partkey % 3 <> 1").select("p_partkey")
    node = lambda k: F.concat(F.lit("u1::org/a::main::f::"), k.cast("string"))
    nodes = some.select(node(F.col("p_partkey")).alias("id"), F.lit("Function").alias("label"), node(F.col("p_partkey")).alias("raw_id"), F.lit("u1").alias("user_id"),
                        F.lit(False).alias("is_public"), F.lit("org/a").alias("repo"), F.lit("main").alias("branch"),
                        F.concat(F.lit("fn_"), "p_partkey").alias("name"), none.alias("path"), F.create_map().cast("map<string,string>").alias("props"))
    edges = some.join(some.select((F.col("p_partkey") - 3).alias("p_partkey")), "p_partkey").select(
        node(F.col("p_partkey")).alias("src"), node(F.col("p_partkey") + 3).alias("dst"), F.lit("CALLS").alias("rel_type"))
    chunks = t.v_chunks.where("user_id = 'u1'")
    return answers.answer_questions(t.v_call_asked, search.index_chunks(chunks), nodes, edges)


@query("routed_hits", "WITH " + _TARGET.replace("{v_asked}", "{v_call_asked}") + _CALLED + """
SELECT qid, 'graph' AS source, row_number() OVER (PARTITION BY qid ORDER BY ref) - 1 AS place, ref FROM j JOIN o ON 'fn_' || o.k = j.target
UNION ALL SELECT qid, 'semantic', unnest(range(n)), NULL FROM j""")
def routed_hits(t: Inputs):
    """What each question gets: rows of the graph, or none by fallback, and its best chunks (whose ids hybrid rows compare)."""
    return answered(t).hits.withColumn("ref", F.when(F.col("source") == "graph", F.col("ref")))


@query("routed_trace", "WITH " + _TARGET.replace("{v_asked}", "{v_call_asked}") + _CALLED + """,
s AS (SELECT *, route = 'graph' OR target IS NOT NULL AS steps FROM j)
SELECT qid, 1 AS step, 'graph' AS kind, coalesce(tool, 'graph_router') AS tool, CASE WHEN tool IS NULL THEN 'No symbol named in a graph question; plain retrieval used'
  WHEN n_graph = 0 THEN 'No graph data found for ' || target ELSE 'Found graph data for ' || target END AS summary FROM s WHERE steps
UNION ALL SELECT qid, 1 + steps::INT, 'semantic', 'hybrid_vector_search', 'Retrieved ' || n || ' cited chunks' FROM s""")
def routed_trace(t: Inputs):
    return answered(t).trace


_FILTERED = _FUSED.split("sparse_scored AS (")[0].replace(
    "SELECT 'd' || doc_id AS id, text AS txt FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark",
    "SELECT 'd' || chunk_id AS id, text AS txt FROM {v_chunks} UNION ALL SELECT 'q' || qid, query FROM {v_questions}") + """
allowed AS (SELECT q.qid, c.chunk_id FROM {v_questions} q JOIN {v_chunks} c ON c.user_id = q.user_id AND (q.language IS NULL OR c.language = q.language)),
cells AS (SELECT id, ('0x' || substr(h, 25, 8))::BIGINT % 64 AS d, sum(CASE WHEN h[1] < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM hashed GROUP BY ALL),
unit AS (SELECT id, d, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS x FROM cells),
ds AS (SELECT a.qid, a.chunk_id, round(coalesce(sum(x.x * y.x), 0), 9) + 0.0 AS score FROM allowed a
  LEFT JOIN unit x ON x.id = 'q' || a.qid LEFT JOIN unit y ON y.id = 'd' || a.chunk_id AND y.d = x.d GROUP BY ALL),
ss AS (SELECT a.qid, a.chunk_id, round(sum(x.w * y.w), 9) AS score FROM allowed a JOIN posts x ON x.id = 'q' || a.qid
  JOIN posts y ON y.id = 'd' || a.chunk_id AND y.term_idx = x.term_idx GROUP BY ALL),
l AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS dr, NULL::BIGINT AS sr FROM ds QUALIFY dr < 7
  UNION ALL SELECT qid, chunk_id, NULL, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS r FROM ss QUALIFY r < 7),
m AS (SELECT qid, chunk_id, max(dr) AS dr, max(sr) AS sr FROM l GROUP BY ALL),
f AS (SELECT *, coalesce(1.0::DOUBLE / (dr + 60), 0) + coalesce(1.0::DOUBLE / (sr + 60), 0) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr NULLS LAST, sr) - 1 AS rank FROM f)
"""


@query("hybrid_filtered", _FILTERED + "SELECT qid, chunk_id, round(score, 9) AS score, rank FROM r WHERE rank < 7")
def hybrid_filtered(t: Inputs):
    hits = search.search(t.v_questions, search.index_chunks(t.v_chunks))
    return hits.select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("search_code", _FILTERED.replace("q.language)),", "q.language) AND c.source_type = 'code'),").replace("< 7", "< 5")
       + "SELECT qid, chunk_id, round(score, 9) AS score, rank FROM r WHERE rank < 5")
def search_code(t: Inputs):
    """Code alone: the filter holds inside both searches."""
    hits = search.search_code(t.v_questions, search.index_chunks(t.v_chunks))
    return hits.select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("search_issues", _FILTERED + """
SELECT r.qid, r.chunk_id, c.source_type, c.state, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) - 1 AS place
FROM r JOIN {v_chunks} c USING (chunk_id) WHERE r.rank < 7 AND c.source_type IN ('issue', 'pr') AND c.state = 'open'""")
def search_issues(t: Inputs):
    """Open issues and pull requests among each question's best hits: the filter comes after ranking."""
    found = search.search_issues(t.v_questions, search.index_chunks(t.v_chunks), t.v_chunks, state="open")
    return found.select("qid", "chunk_id", "source_type", "state", "place")


def _chunks(t: Inputs):
    none = F.lit(None)
    code = F.col("source_type") == "code"
    return t.v_chunks.withColumns({
        "commit_sha": F.when(F.col("branch") == "dev", "c0ffee"), "class_name": none.cast("string"), "section_title": F.when(F.col("source_type") == "docs", F.col("repo")),
        "start_line": F.when(code, 1), "end_line": F.when(code, F.col("n_chars")).cast("int"), "full_body": F.when(code, F.concat(F.lit("whole "), "text")),
        "security_censored": F.col("n_chars") % 3 == 0,
    })


_CHUNKS = """
k AS (SELECT *, CASE WHEN branch = 'dev' THEN 'c0ffee' END AS commit_sha, CASE WHEN source_type = 'docs' THEN repo END AS section_title,
  CASE WHEN source_type = 'code' THEN 'whole ' || text END AS full_body, n_chars % 3 = 0 AS security_censored FROM {v_chunks}),
asked AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'show the secret token ' ELSE '' END || text AS query FROM benchmark),
hid AS (SELECT qid, {terms} AND {verbs} AS secret FROM asked)
""".replace("{terms}", _has_any("lower(query)", K.SECRET_TERMS)).replace("{verbs}", _has_any("lower(query)", K.SECRET_VERBS))
_HIDDEN = quoted(K.HIDDEN_SOURCE_TEXT)


def _asked(t: Inputs):
    lead = F.when(F.col("item_id") % 2 == 0, "show the secret token ").otherwise("")
    return t.benchmark.select(F.col("item_id").alias("qid"), F.concat(lead, "text").alias("query"))


@query("citations", _FUSED.replace("{k}", "7") + "," + _CHUNKS + f"""
SELECT r.qid, r.rank, 'Source [' || (r.rank + 1) || ']' AS source, md5(CASE WHEN h.secret AND k.security_censored THEN {_HIDDEN} ELSE k.text END) AS body,
  k.file_path, k.source_type FROM ranked r JOIN k USING (chunk_id) JOIN hid h ON h.qid = r.qid WHERE r.rank < 7""")
def citations(t: Inputs):
    cited = answers.cite(hybrid.fuse(*text_hits(t)), _asked(t), _chunks(t))
    return cited.select("qid", "rank", "source", F.md5("text").alias("body"), "file_path", "source_type")


@query("rag_context", _FUSED.replace("{k}", "7") + "," + _CHUNKS + f""",
b AS (SELECT r.qid, r.rank, '--- Source [' || (r.rank + 1) || '] ---' || chr(10) || 'File: ' || file_path || chr(10) || 'Branch: ' || branch || chr(10)
  || coalesce('Commit: ' || commit_sha || chr(10), '') || CASE source_type
  WHEN 'code' THEN 'Type: Code (' || language || ')' || chr(10) || 'Function/Class: ' || function_name || chr(10) || 'Lines: 1-' || n_chars || chr(10)
    || '```' || language || chr(10) || CASE WHEN secret AND security_censored THEN {_HIDDEN} ELSE full_body END || chr(10) || '```' || chr(10)
  WHEN 'issue' THEN 'Type: Issue #' || issue_number || ' (' || state || ')' || chr(10) || 'Content:' || chr(10) || CASE WHEN secret AND security_censored THEN {_HIDDEN} ELSE text END || chr(10)
  WHEN 'pr' THEN 'Type: Pull Request #' || pr_number || ' (' || state || ')' || chr(10) || 'Content:' || chr(10) || CASE WHEN secret AND security_censored THEN {_HIDDEN} ELSE text END || chr(10)
  ELSE 'Section: ' || section_title || chr(10) || 'Content:' || chr(10) || CASE WHEN secret AND security_censored THEN {_HIDDEN} ELSE text END || chr(10) END AS block
  FROM ranked r JOIN k USING (chunk_id) JOIN hid h ON h.qid = r.qid WHERE r.rank < 7)
SELECT qid, string_agg(block, chr(10) ORDER BY rank) AS context FROM b GROUP BY qid""")
def rag_context(t: Inputs):
    return answers.contexts(hybrid.fuse(*text_hits(t)), _asked(t), _chunks(t)).select("qid", "context")


# --- reports ----------------------------------------------------------------------

@query("repo_status", """
SELECT user_id, repo, branch, count(DISTINCT file_path) AS file_count, count(*) AS chunk_count, string_agg(DISTINCT language, ',' ORDER BY language) AS languages
FROM {v_chunks} GROUP BY ALL""")
def repo_status(t: Inputs):
    return stats.repo_status(t.v_chunks)


@query("repo_overview", """
WITH c AS (SELECT user_id, repo, branch, count(DISTINCT file_path) AS file_count, count(*) AS chunk_count, string_agg(DISTINCT language, ',' ORDER BY language) AS languages,
  1700000000 + max(chunk_id) AS last_indexed FROM {v_chunks} GROUP BY ALL),
j AS (SELECT 'u' || user_id % 4 AS user_id, 'org/src' || user_id % 3 AS repo, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1, 2, 3)
SELECT c.*, j.state FROM c LEFT JOIN j USING (user_id, repo, branch)""")
def repo_overview(t: Inputs):
    chunks = t.v_chunks.withColumn("indexed_at", F.timestamp_seconds(F.lit(1700000000) + F.col("chunk_id")))
    events = t.events.select(
        F.concat(F.lit("u"), F.col("user_id") % 4).alias("user_id"), F.concat(F.lit("org/src"), F.col("user_id") % 3).alias("repo"),
        F.when(F.col("user_id") % 2 == 0, "main").otherwise("dev").alias("branch"), F.col("event_type").alias("state"), "ts", F.col("event_id").alias("seq"))
    return stats.repo_overview(chunks, events).withColumn("last_indexed", F.unix_seconds("last_indexed"))


@query("run_paths", """
SELECT user_id, repo, branch, path FROM {v_files} WHERE NOT (path LIKE '%.min.js' OR path LIKE '%.lock' OR path LIKE '%node_modules/%' OR path LIKE '%/dist/%' OR NOT contains(path, '.'))""")
def run_paths(t: Inputs):
    rows = t.v_files.withColumn("eligible", routing.is_indexable(F.col("path")))
    return stats.run_paths(rows)


@query("roll_back_graph", """
WITH r AS (SELECT p_partkey, p_partkey % 4 = 0 AS bad FROM part)
SELECT 'u1::org/a::main::' || p_partkey AS id, NULL AS status, NULL AS error FROM r WHERE NOT bad
UNION ALL SELECT 'u1::org/a::main', 'failed', 'no space left'""")
def roll_back_graph(t: Inputs):
    """Nodes of a run that failed go, with their edges, and the repository says why."""
    top = lambda c: F.concat(F.lit("u1::org/a::main"), F.substring(c, 1, 0))  # noqa: E731  a column, as in a real table
    run = F.when(F.col("p_partkey") % 4 == 0, "run2").otherwise("run1")
    base = t.part.select(
        F.concat(F.lit("u1::org/a::main::"), "p_partkey").alias("id"), F.lit("File").alias("label"), F.concat(F.lit("org/a::main::"), "p_partkey").alias("raw_id"),
        F.lit("u1").alias("user_id"), F.lit(False).alias("is_public"), F.lit("org/a").alias("repo"), F.lit("main").alias("branch"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("path"), P.string_map(ingest_run_id=run).alias("props"))
    root = base.limit(1).withColumns({"id": top("id"), "label": F.lit("Repository"), "raw_id": F.lit("org/a::main"), "props": P.string_map(ingest_run_id=F.lit("run1"), ingestion_status=F.lit("ready"))})
    nodes = base.unionByName(root)
    edges = base.select(top("id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("rel_type"), "user_id", "repo", "branch", "props")
    left, links = maintenance.roll_back_graph(nodes, edges, "u1", "org/a", "main", "run2", "failed", "no space left")
    value = lambda k: F.try_element_at("props", F.lit(k))
    held = left.join(links.select(F.col("dst").alias("id"), F.lit(1).alias("linked")), "id", "left").where("linked = 1 or label = 'Repository'")
    return held.select("id", value("ingestion_status").alias("status"), value("last_ingest_error").alias("error"))


@query("safe_properties", """
SELECT o_orderkey, 'day=' || strftime(o_orderdate, '%Y-%m-%d') || ';list=["' || o_orderstatus || '",null]' || ';nested={{"a":' || o_custkey || '}}' || ';text=' || o_orderpriority AS props FROM orders""")
def safe_properties(t: Inputs):
    day = F.col("o_orderdate").cast("date")
    props = P.safe_map(text=F.col("o_orderpriority"), day=day, list=F.array("o_orderstatus", F.lit(None).cast("string")), nested=F.struct(F.col("o_custkey").alias("a")),
                       snapshot=F.lit("hidden"), none=F.lit(None).cast("string"))
    return t.orders.select("o_orderkey", P.entries_text(P.visible_properties(props)).alias("props"))


@query("repo_ownership", """
WITH r AS (SELECT DISTINCT user_id, repo, branch FROM {v_chunks})
SELECT f.doc_id, coalesce((SELECT count(*) FROM r WHERE r.user_id = f.user_id), 0) AS repo_count,
  EXISTS (SELECT 1 FROM r WHERE r.user_id = f.user_id AND r.repo = f.repo AND r.branch = f.lang) AS "exists" FROM
  (SELECT doc_id, user_id, repo, CASE WHEN lang = 'de' THEN 'dev' WHEN lang = 'en' THEN 'main' ELSE lang END AS lang FROM {v_files}) f""")
def repo_ownership(t: Inputs):
    repos = t.v_chunks.select("user_id", "repo", "branch").distinct().withColumns({
        "id": F.concat_ws("::", "user_id", "repo", "branch"), "default_branch": F.lit("main")})
    branch = F.when(F.col("lang") == "de", "dev").when(F.col("lang") == "en", "main").otherwise(F.col("lang"))
    asked = t.v_files.select("doc_id", "user_id", "repo", branch.alias("branch"))
    return stats.repo_ownership(repos, asked).select("doc_id", "repo_count", "exists")


@query("run_stats", r"""
WITH d AS (SELECT f.user_id, f.repo, f.size, f.content, NOT (path LIKE '%.min.js' OR path LIKE '%.lock' OR path LIKE '%node_modules/%' OR path LIKE '%/dist/%' OR NOT contains(path, '.'))
  AS eligible, CASE WHEN p.path IS NULL THEN 'new' WHEN p.file_sha = sha1(f.content) THEN 'unchanged' ELSE 'changed' END AS status,
  len(regexp_extract_all(content, SECRETS)) AS secrets FROM {v_files} f LEFT JOIN {v_prev} p USING (user_id, repo, branch, path))
SELECT user_id, repo, count(*) AS files_seen, count(*) FILTER (NOT eligible) AS files_skipped, count(*) FILTER (eligible AND status = 'unchanged') AS files_unchanged,
  count(*) FILTER (eligible AND status <> 'unchanged') AS files_parsed, count(*) FILTER (eligible AND status = 'changed') AS files_reindexed, 0::BIGINT AS files_deleted,
  coalesce(sum(size) FILTER (eligible AND status <> 'unchanged'), 0)::BIGINT AS chunks_created, count(*) FILTER (eligible AND status <> 'unchanged') AS graph_edges_created,
  count(*) FILTER (eligible AND status <> 'unchanged' AND secrets > 0) AS files_with_secrets,
  coalesce(sum(secrets) FILTER (eligible AND status <> 'unchanged'), 0)::BIGINT AS secrets_redacted,
  coalesce(sum(secrets) FILTER (eligible AND status <> 'unchanged'), 0)::BIGINT AS secrets_found FROM d GROUP BY ALL""".replace("SECRETS", quoted(SECRETS)))
def run_stats(t: Inputs):
    from tessera.catalog.graph import current_files
    from tessera.functions.redact import count_secrets
    from tessera.operators.incremental import change_status

    diff = change_status(current_files(t), t.v_prev)
    rows = diff.withColumns({"eligible": routing.is_indexable(F.col("path")), "secrets": count_secrets(F.col("content")),
                             "chunks": F.col("size"), "edges": F.lit(1)})
    return stats.run_stats(rows).drop("branch")


@query("stage_timings", """
WITH s AS (SELECT job_id, stage, round(sum(value), 2) AS ms FROM {v_events} GROUP BY ALL)
SELECT job_id, string_agg(CASE stage WHEN 'view' THEN 'clone' WHEN 'click' THEN 'walk' WHEN 'purchase' THEN 'total' ELSE stage END || ': ' || printf('%.1f', ms / 1000) || 's',
  ' | ' ORDER BY stage = 'purchase', CASE stage WHEN 'view' THEN 'clone_ms' WHEN 'click' THEN 'file_walk_ms' ELSE stage || '_ms' END) AS timings FROM s GROUP BY job_id""")
def stage_timings(t: Inputs):
    key = F.when(F.col("stage") == "view", "clone_ms").when(F.col("stage") == "click", "file_walk_ms").when(
        F.col("stage") == "purchase", "total_ms").otherwise(F.concat("stage", F.lit("_ms")))
    sums = t.v_events.groupBy("job_id", key.alias("key")).agg(F.round(F.sum("value"), 2).alias("ms"))
    per_job = sums.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "ms"))).alias("m"))
    return per_job.select("job_id", stats.timing_summary(F.col("m"), {"clone_ms": "clone", "file_walk_ms": "walk"}).alias("timings"))


@query("stage_labels", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'reading files' WHEN 'signup' THEN 'comparing hashes' WHEN 'purchase' THEN 'waiting' WHEN 'view' THEN 'building the graph' ELSE 'some click' END AS label FROM events""")
def stage_labels(t: Inputs):
    stage = F.when(F.col("event_type") == "error", "content").when(F.col("event_type") == "view", "graph_x").when(
        F.col("event_type") == "click", "some_click").otherwise(F.col("event_type"))
    message = F.when(F.col("event_type") == "signup", "Comparing the Hash values").when(F.col("event_type") == "purchase", "job accepted")
    return t.events.select("event_id", stats.stage_label(stage, message).alias("label"))


@query("limit_guard", """
WITH u AS (SELECT c_nationkey AS n, count(*) AS files, sum(c_acctbal) AS kb FROM customer GROUP BY ALL),
s AS (SELECT s_nationkey AS n, count(*) AS chunks FROM supplier GROUP BY ALL),
x AS (SELECT u.n, files, kb, coalesce(chunks, 0) * 1000 AS chunks, u.n % 4 AS owned FROM u LEFT JOIN s USING (n))
SELECT n::BIGINT AS n, CASE WHEN owned >= 2 THEN 'repo_count_limit' WHEN kb / 1024 > 500 THEN 'repo_too_large' WHEN files > 500 THEN 'too_many_files' WHEN chunks > 3000 THEN 'too_many_chunks' ELSE 'ok' END AS code FROM x""")
def limit_guard(t: Inputs):
    usage = t.customer.groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").alias("eligible_files"), F.sum("c_acctbal").alias("size_kb"))
    chunks = t.supplier.groupBy(F.col("s_nationkey").alias("n")).agg((F.count("*") * 1000).alias("chunks"))
    rows = usage.join(chunks, "n", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(0)), "repos_owned": F.col("n") % 4})
    return stats.limit_guard(rows).select("n", F.coalesce("code", F.lit("ok")).alias("code"))


@query("listing_projection", """
SELECT n_name AS full_name, n_regionkey = 1 AS private, coalesce(CASE WHEN n_regionkey > 2 THEN n_nationkey END, 0)::BIGINT AS stars,
  CASE WHEN n_regionkey = 0 THEN 'trunk' ELSE 'main' END AS default_branch FROM nation WHERE n_name <> ''""")
def listing_projection(t: Inputs):
    r = F.col("n_regionkey")
    raw = t.nation.select(F.lit("n").alias("name"), F.col("n_name").alias("full_name"), F.when(r != 2, r == 1).alias("private"), F.lit("x").alias("language"),
                          F.when(r > 2, F.col("n_nationkey")).alias("stargazers_count"), F.when(r == 0, "trunk").when(r == 3, "").alias("default_branch"))
    return files.repo_listing(raw).select("full_name", "private", "stars", "default_branch")


@query("tree_listing", "SELECT o_orderkey::VARCHAR AS path, o_custkey AS size, md5(o_orderkey::VARCHAR) AS file_sha FROM orders WHERE o_orderstatus <> 'F'")
def tree_listing(t: Inputs):
    kind = F.when(F.col("o_orderstatus") == "F", "tree").otherwise("blob")
    key = F.col("o_orderkey").cast("string")
    return files.read_listing(t.orders.select(key.alias("path"), kind.alias("type"), F.col("o_custkey").alias("size"), F.md5(key).alias("sha")))


@query("artifact_lookup", """
WITH a AS (SELECT c_mktsegment AS repo, o_orderpriority AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'health' ELSE 'snapshot' END AS kind, max(o_orderkey) AS text FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY ALL)
SELECT c_custkey, coalesce(a.text::VARCHAR, c_name) AS text, a.text IS NOT NULL AS cached
FROM customer LEFT JOIN a ON a.repo = c_mktsegment AND a.kind = CASE WHEN c_custkey % 2 = 0 THEN 'health' ELSE 'snapshot' END AND a.c = CASE WHEN c_nationkey % 2 = 0 THEN '1-URGENT' ELSE 'unknown' END""")
def artifact_lookup(t: Inputs):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    written = F.timestamp_add("SECOND", F.col("o_orderkey").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    stored = rows.select(F.when(F.col("o_orderkey") % 3 == 0, "health").otherwise("snapshot").alias("kind"), F.lit("u").alias("user_id"), F.col("c_mktsegment").alias("repo"), F.lit("main").alias("branch"), F.col("o_orderpriority").alias("commit_sha"),
                         F.col("o_orderkey").cast("string").alias("text"), written.alias("written_at"))
    asked = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, "health").otherwise("snapshot").alias("kind"), F.lit("u").alias("user_id"), F.col("c_mktsegment").alias("repo"), F.lit("main").alias("branch"),
                              F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").alias("commit_sha"))
    found = artifacts.lookup(asked, artifacts.fresh_artifacts(stored, F.lit("2024-01-01").cast("timestamp_ntz"), None), F.col("c_name"))
    return found.select("c_custkey", "text", "cached")


@query("sample_rows", "SELECT repo, chunk_id FROM {v_chunks} QUALIFY row_number() OVER (PARTITION BY repo ORDER BY chunk_id) <= 20")
def sample_rows(t: Inputs):
    return overview.sample_rows(t.v_chunks, ["repo"], 20).select("repo", "chunk_id")


@query("payload_projection", """
SELECT chunk_id, 'branch=' || branch || ';language=' || coalesce(CASE WHEN n_chars % 2 = 0 THEN 'override' END, language) || ';repo=' || repo AS payload FROM {v_chunks}""")
def payload_projection(t: Inputs):
    base = P.string_map(repo=F.col("repo"), branch=F.col("branch"), language=F.col("language"))
    extra = F.when(F.col("n_chars") % 2 == 0, P.string_map(language=F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    return t.v_chunks.select("chunk_id", P.entries_text(P.overlay(base, extra)).alias("payload"))


@query("chunk_payload", """
SELECT chunk_id, concat_ws(';', 'branch=' || branch, 'chunk_type=' || chunk_type, 'commit_sha=c0', 'end_line=' || CASE WHEN n_chars % 3 = 0 THEN n_chars END, 'extra=' || CASE WHEN n_chars % 2 = 0 THEN 'mine' END,
  'file_path=' || file_path, 'function_name=' || function_name, 'indexed_at=' || strftime(make_timestamp((1700000000 + chunk_id) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z'), 'is_public=false',
  'issue_number=' || issue_number, 'labels=["' || language || '","b"]', 'language=' || CASE WHEN n_chars % 2 = 0 THEN 'override' ELSE language END, 'pr_number=' || pr_number, 'repo=' || repo,
  'source_type=' || source_type, 'state=' || state, 'text=' || text, 'user_id=' || user_id) AS payload FROM {v_chunks}""")
def chunk_payload(t: Inputs):
    """All fields of a chunk; those it lacks are left out, its metadata wins."""
    none = F.lit(None).cast("string")
    rows = t.v_chunks.withColumns({
        "commit_sha": F.lit("c0"), "file_sha": none, "ingest_run_id": none, "class_name": none, "signature": none, "section_title": none, "start_line": none.cast("int"),
        "end_line": F.when(F.col("n_chars") % 3 == 0, F.col("n_chars")), "labels": F.array("language", F.lit("b")), "indexed_at": F.timestamp_seconds(F.lit(1700000000) + F.col("chunk_id"))})
    extra = F.when(F.col("n_chars") % 2 == 0, P.string_map(language=F.lit("override"), extra=F.lit("mine")))
    return rows.select("chunk_id", P.entries_text(P.payload(extra)).alias("payload"))


@query("text_caps", """
SELECT chunk_id, CASE WHEN source_type = 'issue' THEN 'ISSUE #' ELSE 'PR #' END || coalesce(issue_number, pr_number) || ' (' || state || ')' || chr(10) || 'CONTENT: '
  || text || chr(10) AS shown FROM {v_chunks} WHERE source_type IN ('issue', 'pr')""")
def text_caps(t: Inputs):
    rows = t.v_chunks.where(F.col("source_type").isin("issue", "pr"))
    return rows.select("chunk_id", search.hit_text(F.col("source_type"), F.coalesce("issue_number", "pr_number"), F.col("state"), F.col("text")).alias("shown"))


@query("file_outline", """
WITH l AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS x FROM {v_lines}),
w AS (SELECT doc_id, len(x) AS n, unnest(generate_series(0, greatest(ceil((len(x) - 100) / 80.0)::INT * 80, 0), 80)) AS s FROM l)
SELECT doc_id, s // 80 AS place, '- function: sig (Lines ' || (s + 1) || '-' || least(s + 100, n) || ')' AS line FROM w WHERE n > 100""")
def file_outline(t: Inputs):
    from tessera.operators.chunk_docs import explode_parts, window_parts

    source = t.wide.v_lines.withColumn("text", F.rtrim(F.col("text"), F.lit("\n")))
    parts = explode_parts(source, window_parts(F.col("text")), ["doc_id"]).withColumns({
        "user_id": F.lit("u"), "repo": F.lit("r"), "branch": F.lit("main"), "file_path": F.col("doc_id").cast("string"), "source_type": F.lit("code"),
        "signature": F.lit("sig"), "chunk_id": F.col("ordinal").cast("string")})
    return search.file_outline(parts).select(F.col("file_path").cast("long").alias("doc_id"), "place", "line")


@query("file_text", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM {v_lines} WHERE doc_id % 4 = 0)
SELECT doc_id, md5(array_to_string(x, chr(10))) AS body FROM l""")
def file_text(t: Inputs):
    lines = t.v_lines.withColumnRenamed("doc_id", "chunk_id").withColumnRenamed("text", "lines")
    rows = t.v_chunks.join(lines, "chunk_id").withColumns({"text": F.col("lines"), "full_body": F.lit(""), "start_line": F.lit(1)})
    shown = search.file_text(rows)
    return shown.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), F.md5("text").alias("body"))


@query("health_evidence", """
WITH RECURSIVE s AS (SELECT user_id, repo, branch, chunk_id, CASE WHEN chunk_id % 9 = 0 THEN 'tests/conf' || (chunk_id % 5) WHEN chunk_id % 9 = 1 THEN 'auth/config.py'
    WHEN chunk_id % 9 = 2 THEN 'a/.env' WHEN chunk_id % 9 = 3 THEN 'requirements.txt' ELSE file_path END AS path,
  row_number() OVER (PARTITION BY user_id, repo, branch ORDER BY chunk_id) AS n FROM {v_chunks}),
p AS (SELECT * FROM (VALUES (1, '.env', 'environment and secrets surface'), (2, 'requirements', 'python dependencies'), (3, 'package.json', 'javascript dependencies'),
  (4, 'pyproject', 'python project configuration'), (5, 'docker', 'container/deployment configuration'), (6, 'test', 'test coverage signals'),
  (7, 'auth', 'authentication and authorization surface'), (8, 'middleware', 'request middleware surface'), (9, 'config', 'configuration surface')) v(i, pat, reason)),
r AS (SELECT user_id, repo, branch, list(path ORDER BY n) AS paths FROM s GROUP BY ALL),
st(user_id, repo, branch, paths, i, picked, reasons) AS (SELECT user_id, repo, branch, paths, 0, []::VARCHAR[], []::VARCHAR[] FROM r
  UNION ALL
  SELECT user_id, repo, branch, paths, i1, CASE WHEN hit IS NULL THEN picked ELSE list_append(picked, hit) END, CASE WHEN hit IS NULL THEN reasons ELSE list_append(reasons, reason) END
  FROM (SELECT st.user_id, st.repo, st.branch, st.paths, st.picked, st.reasons, p.i AS i1, p.reason,
    list_filter(st.paths, lambda x: contains(lower(x), p.pat) AND NOT list_contains(st.picked, x))[1] AS hit FROM st JOIN p ON p.i = st.i + 1)),
d AS (SELECT * FROM st WHERE i = 9),
rest AS (SELECT d.user_id, d.repo, d.branch, s.path, min(s.n) AS n, len(d.picked) AS k FROM d JOIN s USING (user_id, repo, branch)
  WHERE NOT list_contains(d.picked, s.path) GROUP BY ALL),
fill AS (SELECT user_id, repo, branch, path, k + row_number() OVER (PARTITION BY user_id, repo, branch ORDER BY n) - 1 AS place FROM rest)
SELECT user_id, repo, branch, unnest(range(len(picked))) AS place, unnest(reasons) AS reason, unnest(picked) AS file_path FROM d
UNION ALL SELECT user_id, repo, branch, place, 'representative indexed chunk', path FROM fill""")
def health_evidence(t: Inputs):
    m = F.col("chunk_id") % 9
    path = F.when(m == 0, F.concat(F.lit("tests/conf"), F.col("chunk_id") % 5)).when(m == 1, "auth/config.py").when(m == 2, "a/.env").when(
        m == 3, "requirements.txt").otherwise(F.col("file_path"))
    picked = overview.pick_evidence(t.v_chunks.withColumn("file_path", path))
    return picked.select("user_id", "repo", "branch", "place", "reason", "file_path")


@query("secret_evidence", """
SELECT user_id, repo, branch, count(*) FILTER (secret) AS secret_redaction_evidence_count, count(*) AS evidence_count FROM
  (SELECT *, n_chars % 3 = 0 OR contains(text, '[REDACTED]') AS secret FROM {v_chunks}) GROUP BY ALL""")
def secret_evidence(t: Inputs):
    chunks = _chunks(t)
    picked = overview.pick_evidence(chunks.withColumn("file_path", F.concat(F.lit("x/"), "chunk_id")))
    evidence = overview.evidence_rows(picked, chunks)
    counts = chunks.groupBy("user_id", "repo", "branch", F.lit("File").alias("label")).agg(F.count("*").alias("nodes"))
    signals = overview.health_signals(evidence, counts, counts.select("user_id", "repo", "branch", F.lit("X").alias("rel_type"), F.col("nodes").alias("relationships")))
    return signals.select("user_id", "repo", "branch", "secret_redaction_evidence_count", "evidence_count")


@query("health_signals", """
WITH e AS (SELECT user_id, repo, branch, count(*) FILTER (n_chars % 3 = 0 OR contains(text, '[REDACTED]')) AS secret_redaction_evidence_count, count(*) AS evidence_count FROM {v_chunks} GROUP BY ALL),
n AS (SELECT user_id, repo, branch, string_agg(source_type || '=' || c, ';' ORDER BY source_type) AS node_counts FROM (SELECT user_id, repo, branch, source_type, count(*) AS c FROM {v_chunks} GROUP BY ALL) GROUP BY ALL),
r AS (SELECT user_id, repo, branch, string_agg(state || '=' || c, ';' ORDER BY state) AS relationship_counts FROM
  (SELECT user_id, repo, branch, state, count(*) AS c FROM {v_chunks} WHERE state IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT * FROM e LEFT JOIN n USING (user_id, repo, branch) LEFT JOIN r USING (user_id, repo, branch)""")
def health_signals(t: Inputs):
    """All four signals; a branch without relationships has none."""
    chunks, key = _chunks(t), ["user_id", "repo", "branch"]
    picked = overview.pick_evidence(chunks.withColumn("file_path", F.concat(F.lit("x/"), "chunk_id")))
    nodes = chunks.groupBy(*key, F.col("source_type").alias("label")).agg(F.count("*").alias("nodes"))
    rels = t.v_chunks.where("state is not null").groupBy(*key, F.col("state").alias("rel_type")).agg(F.count("*").alias("relationships"))
    return overview.health_signals(overview.evidence_rows(picked, chunks), nodes, rels)


@query("snapshot_context", """
WITH docs AS (SELECT *, row_number() OVER (PARTITION BY user_id, repo, branch ORDER BY chunk_id) AS n FROM {v_chunks} WHERE source_type = 'docs'),
readme AS (SELECT user_id, repo, branch, coalesce(nullif(arg_min(text, n) FILTER (n_chars % 4 = 0), ''), arg_min(text, n)) AS readme FROM docs GROUP BY ALL),
files AS (SELECT user_id, repo, branch, chunk_id, file_path, n_chars, language, row_number() OVER (PARTITION BY user_id, repo, branch ORDER BY n_chars DESC, file_path) AS n FROM {v_chunks}),
n AS (SELECT user_id, repo, branch, string_agg('- ' || source_type || ': ' || c || chr(10), '' ORDER BY source_type) AS t FROM (SELECT user_id, repo, branch, source_type, count(*) AS c FROM {v_chunks} GROUP BY ALL) GROUP BY ALL),
h AS (SELECT user_id, repo, branch, string_agg('- ' || file_path || ' (' || language || ') — ' || n_chars || ' connections' || chr(10), '' ORDER BY n) AS t FROM files GROUP BY ALL),
i AS (SELECT user_id, repo, branch, string_agg('- ' || file_path || ' — imported by ' || n_chars || ' files' || chr(10), '' ORDER BY n) AS t FROM files GROUP BY ALL),
d AS (SELECT user_id, repo, branch, string_agg('- ' || language || ' (pip)' || chr(10), '' ORDER BY language) AS t FROM (SELECT DISTINCT user_id, repo, branch, language FROM {v_chunks}) GROUP BY ALL)
SELECT user_id, repo, branch, 'Repository: ' || repo || chr(10) || 'Branch: ' || branch || chr(10) || chr(10)
  || coalesce('## What it says about itself' || chr(10) || readme || chr(10), '') || '## Nodes' || chr(10) || n.t || chr(10)
  || '## Files with most edges' || chr(10) || h.t || chr(10) || '## Files imported most' || chr(10) || i.t || chr(10)
  || '## Declared dependencies' || chr(10) || d.t AS context
FROM n LEFT JOIN readme USING (user_id, repo, branch) JOIN h USING (user_id, repo, branch) JOIN i USING (user_id, repo, branch) JOIN d USING (user_id, repo, branch)""")
def snapshot_context(t: Inputs):
    key = overview.REPO
    chunks = t.v_chunks
    named = chunks.withColumn("file_path", F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("README"), "chunk_id")).otherwise(F.col("file_path")))
    counted = chunks.groupBy(*key, F.col("source_type").alias("a")).agg(F.count("*").alias("n"))
    ranked = chunks.select(*key, F.col("file_path").alias("a"), F.col("language").alias("b"), F.col("n_chars").alias("n"))
    deps = chunks.select(*key, F.col("language").alias("a"), F.lit("pip").alias("b")).distinct()
    return overview.snapshot_context(chunks, overview.readme_pick(named), counted, ranked, ranked.drop("b"), deps)


# --- logs, history, quotas --------------------------------------------------------

@query("event_retention", """
WITH r AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY job_id) AS total FROM {v_events})
SELECT job_id, event_id, position, greatest(total - 50, 0) AS "offset" FROM r WHERE position >= total - 50""")
def event_retention(t: Inputs):
    return events.retained_events(t.v_events, _ORDER, keep=50).select("job_id", "event_id", "position", "offset")


def _cursors(t: Inputs):
    known = t.customer.select(F.concat(F.lit("job"), "c_custkey").alias("job_id"), (F.col("c_nationkey") * 3).cast("long").alias("cursor"))
    return known


@query("event_cursor", """
WITH r AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY job_id) AS total FROM {v_events}),
c AS (SELECT 'job' || c_custkey AS job_id, c_nationkey * 3 AS cursor FROM customer)
SELECT r.job_id, event_id, position FROM r JOIN c USING (job_id) WHERE position >= cursor""")
def event_cursor(t: Inputs):
    rows, _ = events.events_since(t.v_events, _cursors(t), _ORDER)
    return rows.select("job_id", "event_id", "position")


@query("event_heads", """
WITH j AS (SELECT job_id, count(*) AS n, bool_or(state IN ('done', 'error', 'lost')) AS done FROM {v_events} GROUP BY ALL),
c AS (SELECT 'job' || c_custkey AS job_id, c_nationkey * 3 AS cursor FROM customer)
SELECT job_id, cursor::BIGINT AS cursor, coalesce(n, cursor) AS new_cursor, coalesce(done, true) AS done, n IS NULL AS lost FROM c LEFT JOIN j USING (job_id)""")
def event_heads(t: Inputs):
    _, heads = events.events_since(t.v_events, _cursors(t), _ORDER)
    return heads.select("job_id", "cursor", "new_cursor", "done", "lost")


@query("job_status", """
SELECT job_id, arg_max(state, (ts, event_id)) AS status, bool_or(state IN ('done', 'error')) AS done FROM {v_events} GROUP BY ALL""")
def job_status(t: Inputs):
    return events.job_status(t.v_events, _ORDER)


@query("job_expiry", """
WITH j AS (SELECT job_id, min(ts) AS created_at, bool_or(state = 'done') AS done FROM {v_events} GROUP BY ALL)
SELECT job_id FROM j WHERE NOT (done AND datediff('second', created_at, TIMESTAMP '2024-01-01 03:00:00') > 3600)""")
def job_expiry(t: Inputs):
    jobs = t.v_events.groupBy("job_id").agg(F.min("ts").alias("created_at"), F.bool_or(F.col("state") == "done").alias("done"))
    return events.live_jobs(jobs, F.lit("2024-01-01 03:00:00").cast("timestamp_ntz")).select("job_id")


@query("latest_stage", """
WITH s AS (SELECT * FROM {v_events} QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts DESC, event_id DESC) = 1)
SELECT job_id, stage, event_id FROM s""")
def latest_stage(t: Inputs):
    return events.latest_per_stage(t.v_events, _ORDER).select("job_id", "stage", "event_id")


@query("history_last5", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM
  (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)""")
def history_last5(t: Inputs):
    return events.recent_history(t.conversations, "conv_id", "turn", 5).select("conv_id", "turn", "place")


@query("trace_pairs", r"""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn + 1 AS turn, CASE turn % 3 WHEN 0 THEN 'get_call_graph' WHEN 1 THEN 'search_code' ELSE 'get_file_content' END AS tool FROM conversations WHERE role = 'user')
SELECT r.conv_id, step, coalesce(tool, 'unknown_tool') AS tool, CASE tool WHEN 'get_call_graph' THEN 'graph' WHEN 'search_code' THEN 'semantic' WHEN 'get_file_content' THEN 'file' ELSE 'agent' END AS kind,
  CASE WHEN trim(text) = '' THEN 'Returned no visible output' WHEN text LIKE 'No %' THEN string_split(text, chr(10))[1]
  ELSE 'Returned ' || len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) || ' lines of tool output' END AS summary
FROM r LEFT JOIN c USING (conv_id, turn)""")
def trace_pairs(t: Inputs):
    m = F.col("turn") % 3
    tool = F.when(m == 0, "get_call_graph").when(m == 1, "search_code").otherwise("get_file_content")
    talk = t.conversations
    calls = talk.where("role = 'user'").select(F.col("conv_id").alias("conv"), (F.col("turn") + 1).alias("call_id"), tool.alias("tool"), F.lit("{}").alias("input"))
    results = talk.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), F.col("turn").alias("call_id"), F.col("turn").alias("seq"),
                                                      F.lit("").alias("name"), F.col("text").alias("content"))
    return events.trace_steps(calls, results).select(F.col("conv").alias("conv_id"), "step", "tool", "kind", "summary")


@query("daily_quota", """
SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS total, least(count(*), 3) AS accepted, greatest(count(*) - 3, 0) AS rejected FROM events GROUP BY ALL""")
def daily_quota(t: Inputs):
    counts = events.quota_counts(t.events, ["user_id"], 3)
    return counts.withColumn("day", F.col("day").cast("string"))


@query("quota_rejections", """
SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) > 3""")
def quota_rejections(t: Inputs):
    return events.over_quota(t.events, ["user_id"], _ORDER, 3).select("event_id")


@query("timing_breakdown", """
WITH s AS (SELECT job_id, stage, round(sum(value), 2) AS ms FROM {v_events} GROUP BY ALL)
SELECT job_id, string_agg(stage || '=' || printf('%.2f', ms / 1000) || 's', ', ' ORDER BY ms DESC, stage) AS timings FROM s GROUP BY job_id""")
def timing_breakdown(t: Inputs):
    sums = t.v_events.groupBy("job_id", "stage").agg(F.round(F.sum("value"), 2).alias("ms"))
    per_job = sums.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "ms"))).alias("m"))
    return per_job.select("job_id", stats.timing_breakdown(F.col("m")).alias("timings"))


@query("grammar_keys", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'tsx' WHEN 1 THEN 'go' WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN 'typescript' ELSE lower(lang) END AS grammar FROM documents""")
def grammar_keys(t: Inputs):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (F.col("doc_id") % 6 + 1).cast("int"))
    lang = pick([" TypeScript ", "golang", "unknown", "?", "typescript", F.col("lang")])
    path = pick(["a/b.tsx", "x.rs", "m.py", "v.jsx", "q.ts", "none"])
    return t.documents.select("doc_id", routing.grammar_key(lang, path).alias("grammar"))


@query("code_hits_text", _FUSED.replace("{k}", "7") + "," + _CHUNKS + """
SELECT qid, string_agg('FILE: ' || file_path || chr(10) || 'FUNCTION/CLASS: ' || coalesce(function_name, 'N/A') || chr(10) || 'LINES: ' || CASE WHEN source_type = 'code' THEN '1-' || n_chars ELSE 'None-None' END
  || chr(10) || 'SNIPPET:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS answer
FROM ranked JOIN k USING (chunk_id) WHERE rank < 7 GROUP BY qid""")
def code_hits_text(t: Inputs):
    return answers.code_answers(hybrid.fuse(*text_hits(t)), _chunks(t))
