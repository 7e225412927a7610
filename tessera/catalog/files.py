"""Files: selection, redaction, parsing, chunking, source graphs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.catalog.registry import Inputs, query, view
from tessera.functions import identity, redact, report, routing, tenant, text
from tessera.operators import chunk_code, chunk_docs, graph_extract
from tessera.session import checkpoint_root
from tessera.sources import git_records


def quoted(value: str) -> str:
    """A Python string as an SQL literal inside oracle text."""
    return "'" + value.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


_STRIP = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def stripped(expr: str) -> str:
    return _STRIP.replace("{x}", expr)


# Fixed value, written out so that the oracle does not follow the engine's own pattern.
SECRETS = (
    r"(?:-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)|(?:\bA(?:KIA|SIA)[0-9A-Z]{16}\b)|(?:\bgh[pousr]_[A-Za-z0-9]{20,})"
    r"|(?:\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})|(?:\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@)"
    r"|(?:(?i:(?:key|token|secret|password|passwd)\"?\s*[:=]\s*(?:\"[^\"\n]{6,}\"|'[^'\n]{6,}')))"
)


@query("file_filter", r"""
SELECT doc_id, path, NOT ('/' || path LIKE '%/node_modules/%' OR '/' || path LIKE '%/.git/%' OR '/' || path LIKE '%/dist/%'
           OR '/' || path LIKE '%/build/%' OR '/' || path LIKE '%/__pycache__/%' OR path LIKE '%.min.js'
           OR path LIKE '%.min.css' OR path LIKE '%.pb.go' OR contains(path, '_generated.') OR path LIKE '%.lock')
  AND regexp_matches(lower(path), '\.(py|js|ts|jsx|tsx|go|rs|java|cs|rb|php|md|rst|txt|mdx|yaml|yml|json|toml|ini|ipynb)$')
  AS eligible FROM {v_files}""")
def file_filter(t: Inputs):
    return t.v_files.select("doc_id", "path", routing.is_indexable(F.col("path")).alias("eligible"))


@query("file_classify", r"""
SELECT doc_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown'
  WHEN path LIKE '%.json' THEN 'json' ELSE 'unknown' END AS language,
  CASE WHEN path LIKE '%.md' THEN 'docs' WHEN path LIKE '%.json' THEN 'config' ELSE 'code' END AS source_type FROM {v_files}""")
def file_classify(t: Inputs):
    return t.v_files.select("doc_id", routing.language(F.col("path")).alias("language"),
                            routing.source_type(F.col("path")).alias("source_type"))


@query("line_counts", "SELECT doc_id, len(string_split(rtrim(text, chr(10)), chr(10))) AS lines FROM {v_lines}")
def line_counts(t: Inputs):
    return t.wide.v_lines.select("doc_id", text.line_count(F.rtrim(F.col("text"), F.lit("\n"))).cast("long").alias("lines"))


@query("secret_counts", f"SELECT doc_id, len(regexp_extract_all(text, {quoted(SECRETS)})) AS secrets FROM documents")
def secret_counts(t: Inputs):
    return t.wide.documents.select("doc_id", redact.count_secrets(F.col("text")).cast("long").alias("secrets"))


@query("redact_text", f"""
SELECT doc_id, md5(regexp_replace(text, {quoted(SECRETS)}, '[REDACTED]', 'g')) AS clean,
  regexp_matches(text, {quoted(SECRETS)}) AS security_censored FROM documents""")
def redact_text(t: Inputs):
    done = redact.redact_fields(t.wide.documents.select("doc_id", "text"), ["text"])
    return done.select("doc_id", F.md5("text").alias("clean"), (F.col("secrets_redacted") > 0).alias("security_censored"))


@query("html_strip", rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
  '(?is)<template\b[^>]*>.*?</template\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[!/?A-Za-z][^>]*>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
  '&nbsp;', chr(160)), '&amp;', '&') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10) || chr(10), 'g') AS x FROM b)
SELECT page_id, {stripped('x')} AS text FROM c""")
def html_strip(t: Inputs):
    return t.wide.pages.select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("doc_sections", f"""
WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l FROM documents),
s AS (SELECT doc_id, i, CASE WHEN i = 1 THEN '# Doc ' || doc_id ELSE '## Part' END AS head, {stripped('l')} AS l FROM lines),
b AS (SELECT doc_id, i, head[3 + (i > 1)::INT:] AS title, CASE WHEN l = '' THEN head ELSE head || chr(10) || l END AS body FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal,
  title || CASE WHEN length(body) > 1500 THEN ' (part 1)' ELSE '' END AS section_title, md5(body) AS body
FROM b UNION ALL SELECT doc_id, 0, NULL, md5('Preamble of document ' || doc_id) FROM documents""")
def doc_sections(t: Inputs):
    parts = chunk_docs.explode_parts(t.wide.v_docs_md, chunk_docs.doc_parts(F.col("text")), ["doc_id"])
    return parts.select("doc_id", "ordinal", "section_title", F.md5("text").alias("body"))


@query("sliding_windows", f"""
WITH l AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS x FROM {{v_lines}}),
n AS (SELECT *, len(x) AS n FROM l),
w AS (SELECT doc_id, x, n, unnest(generate_series(0, greatest(ceil((n - 100) / 80.0)::INT * 80, 0), 80)) AS s FROM n),
p AS (SELECT doc_id, n, s, {stripped("array_to_string(x[s + 1:s + 100], chr(10))")} AS body FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ordinal, CASE WHEN n <= 100 THEN 'whole_doc' ELSE 'function' END AS chunk_type,
  s + 1 AS start_line, least(s + 100, n) AS end_line, md5(body) AS body FROM p WHERE length(body) >= 1""")
def sliding_windows(t: Inputs):
    source = t.wide.v_lines.withColumn("text", F.rtrim(F.col("text"), F.lit("\n")))
    parts = chunk_docs.explode_parts(source, chunk_docs.window_parts(F.col("text")), ["doc_id"])
    return parts.select("doc_id", "ordinal", "chunk_type", "start_line", "end_line", F.md5("text").alias("body"))


# Greedy packing as a recursion over paragraph positions.
_PACK = f"""WITH RECURSIVE paras AS (
  SELECT doc_id, generate_subscripts(string_split_regex(text, '\\n\\n+'), 1) AS i, unnest(string_split_regex(text, '\\n\\n+')) AS p FROM {{v_paragraphs}}),
st(doc_id, i, len, g) AS (
  SELECT doc_id, 1::BIGINT, length(p)::BIGINT, 0::BIGINT FROM paras WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i + 1, CASE WHEN s.len = 0 OR s.len + length(p) + 2 > 1500 THEN length(p) ELSE s.len + 2 + length(p) END,
         s.g + CASE WHEN s.len > 0 AND s.len + length(p) + 2 > 1500 THEN 1 ELSE 0 END
  FROM st s JOIN paras q ON q.doc_id = s.doc_id AND q.i = s.i + 1),
packed AS (SELECT doc_id, g, {stripped("string_agg(p, chr(10) || chr(10) ORDER BY i)")} AS body FROM st JOIN paras USING (doc_id, i) GROUP BY doc_id, g)
"""


@query("paragraph_pack", _PACK + "SELECT doc_id, g AS part, md5(body) AS body FROM packed")
def paragraph_pack(t: Inputs):
    parts = t.wide.v_paragraphs.select("doc_id", F.posexplode(chunk_docs.pack_paragraphs(F.col("text"), K.SECTION_MAX_CHARS)).alias("part", "body"))
    return parts.select("doc_id", "part", F.md5(text.strip(F.col("body"))).alias("body"))


@query("whole_chunks", _PACK + f""",
x AS (SELECT p.doc_id, p.g, p.body FROM packed p JOIN {{v_paragraphs}} v USING (doc_id) WHERE length(v.text) > 2000
  UNION ALL SELECT doc_id, 0, {stripped('text')} FROM {{v_paragraphs}} WHERE length(text) <= 2000)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS ordinal, md5(body) AS body FROM x WHERE length(body) >= 1""")
def whole_chunks(t: Inputs):
    parts = chunk_docs.explode_parts(t.wide.v_paragraphs, chunk_docs.whole_parts(F.col("text")), ["doc_id"])
    return parts.select("doc_id", "ordinal", F.md5("text").alias("body"))


@query("chunk_ids", """
WITH s AS (SELECT chunk_id, concat_ws('::', user_id, repo, branch, file_path, chunk_type, function_name,
  'issue' || issue_number, 'pr' || pr_number) AS x FROM {v_chunks}), h AS (SELECT *, md5(x) AS m FROM s)
SELECT chunk_id AS doc_id, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS id FROM h""")
def chunk_ids(t: Inputs):
    none = F.lit(None).cast("string")
    rows = t.v_chunks.withColumns({"class_name": none, "section_title": none, "start_line": none.cast("int")})
    return rows.select(F.col("chunk_id").alias("doc_id"), identity.chunk_id().alias("id"))


@query("tenant_scope", """
WITH u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE user_id END AS u, doc_id % 10 = 0 AS pub,
  repo || '::' || branch || '::' || path AS raw FROM {v_files}),
p AS (SELECT *, CASE WHEN coalesce(u, '') <> '' THEN u WHEN pub THEN 'public' ELSE 'anonymous' END AS prefix FROM u)
SELECT doc_id, prefix, prefix || '::' || raw AS scoped, prefix || '::' || raw AS again, raw AS stripped FROM p""")
def tenant_scope(t: Inputs):
    d = F.col("doc_id")
    user = F.when(d % 5 == 0, None).when(d % 7 == 0, "").otherwise(F.col("user_id"))
    rows = t.v_files.select("doc_id", user.alias("u"), (d % 10 == 0).alias("pub"), tenant.raw_id(F.col("repo"), F.col("branch"), F.col("path")).alias("raw"))
    rows = rows.withColumn("scoped", tenant.scoped_id(F.col("raw"), F.col("u"), F.col("pub")))
    return rows.select("doc_id", tenant.tenant_prefix(F.col("u"), F.col("pub")).alias("prefix"), "scoped",
                       tenant.scoped_id(F.col("scoped"), F.col("u"), F.col("pub")).alias("again"),
                       tenant.strip_scope(F.col("scoped")).alias("stripped"))


@query("branch_default", """
SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN 'dev' END, 'main') AS file_branch,
  coalesce(CASE WHEN lang = 'de' THEN 'dev' END, CASE WHEN lang = 'fr' THEN 'trunk' END, 'main') AS repo_branch FROM documents""")
def branch_default(t: Inputs):
    own, default = F.when(F.col("lang") == "de", "dev"), F.when(F.col("lang") == "fr", "trunk")
    return t.documents.select("doc_id", tenant.branch_or_main(own).alias("file_branch"), tenant.repo_branch(own, default).alias("repo_branch"))


@query("sensitive_files", """
SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS sensitive FROM documents""")
def sensitive_files(t: Inputs):
    names = [".env", "conf\\.ENV.local", ".env.example", "keys/a.pem", "x.key.md"]
    path = F.concat(F.lit("a/"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 5 + 1).cast("int")))
    return t.documents.select("doc_id", routing.is_sensitive_file(path).alias("sensitive"))


@query("js_imports", r"""
WITH f AS (SELECT page_id, unnest(list_concat(regexp_extract_all(content, 'import\s+(?:.*from\s+)?[''"]([^''"]+)[''"]', 1),
  regexp_extract_all(content, 'require\([''"]([^''"]+)[''"]\)', 1))) AS target FROM {v_scripts})
SELECT page_id, target, target[1] IN ('.', '/') AS local, count(*) AS n FROM f GROUP BY ALL""")
def js_imports(t: Inputs):
    rows = t.wide.v_scripts.select("page_id", F.explode(graph_extract.js_import_targets(F.col("content"))).alias("target"))
    local = F.col("target").startswith(".") | F.col("target").startswith("/")
    return rows.groupBy("page_id", "target", local.alias("local")).agg(F.count("*").alias("n"))


@query("manifest_deps", r"""
WITH l AS (SELECT s_suppkey, trim(string_split(u, '#')[1]) AS l FROM (SELECT s_suppkey, unnest(string_split(content, chr(10))) AS u FROM {v_manifests} WHERE path = 'requirements.txt')),
r AS (SELECT s_suppkey, 'pip' AS ecosystem, regexp_extract(l, '^([a-zA-Z0-9_\-]+)[=<>~\^]*(.*)', 1) AS name,
  coalesce(nullif(trim(regexp_extract(l, '^([a-zA-Z0-9_\-]+)[=<>~\^]*(.*)', 2)), ''), 'latest') AS version FROM l WHERE l <> ''),
j AS (SELECT s_suppkey, 'npm', 'left', s_suppkey::VARCHAR FROM supplier UNION ALL SELECT s_suppkey, 'npm', 'only' || s_nationkey, '2' FROM supplier)
SELECT s_suppkey, ecosystem, name, version FROM r WHERE name <> '' UNION ALL SELECT * FROM j""")
def manifest_deps(t: Inputs):
    files = t.v_manifests.select(F.concat(F.col("s_suppkey"), F.lit(":"), F.col("path")).alias("fid"),
                                 F.col("s_suppkey").cast("string").alias("branch_raw"), "path", "content")
    edges = graph_extract.manifest_edges(files)
    return edges.select(F.col("from_raw").cast("long").alias("s_suppkey"), F.col("props")["ecosystem"].alias("ecosystem"),
                        F.col("props")["name"].alias("name"), F.col("props")["version"].alias("version"))


def _python_files(t: Inputs):
    fid = F.col("doc_id").cast("string")
    return t.wide.v_python.select(fid.alias("fid"), F.lit("python").alias("grammar"), fid.alias("file_raw"), F.lit("r::main").alias("branch_raw"), "content")


@query("code_chunks", """
SELECT doc_id, 'module_header' AS chunk_type, NULL AS class_name, NULL AS function_name, 0::BIGINT AS start_line, 0::BIGINT AS end_line, false AS large_function FROM {v_python}
UNION ALL SELECT doc_id, 'function', NULL, 'f_' || doc_id, 4, 5, false FROM {v_python}
UNION ALL SELECT doc_id, 'class', 'C_' || doc_id, NULL, 7, 7, false FROM {v_python}
UNION ALL SELECT doc_id, 'method', 'C_' || doc_id, 'm', 8, 9 + doc_lines, doc_lines + 2 > 150 FROM {v_python}""")
def code_chunks(t: Inputs):
    rows = chunk_code.code_chunks(_python_files(t))
    return rows.select(F.col("fid").cast("long").alias("doc_id"), "chunk_type", "class_name", "function_name",
                       F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "large_function")


@query("python_edges", """
WITH d AS (SELECT doc_id::VARCHAR AS f, (doc_id % 10)::VARCHAR AS g FROM documents)
SELECT f AS file, 'IMPORTS' AS rel_type, f AS src, 'python::os' AS dst FROM d
UNION ALL SELECT f, 'IMPORTS', f, 'python::requests' FROM d
UNION ALL SELECT f, 'IMPORTS', f, 'r::main::local/mod' FROM d
UNION ALL SELECT f, 'DEFINED_IN', f || '::func::f_' || f, f FROM d
UNION ALL SELECT f, 'DEFINED_IN', f || '::func::m', f FROM d
UNION ALL SELECT f, 'DEFINED_IN', f || '::class::C_' || f, f FROM d
UNION ALL SELECT f, 'INHERITS_FROM', f || '::class::C_' || f, f || '::class::Base' FROM d
UNION ALL SELECT f, 'CALLS', f || '::func::f_' || f, f || '::func::g_' || g FROM d
UNION ALL SELECT f, 'CALLS', f || '::func::m', f || '::func::f_' || f FROM d""")
def python_edges(t: Inputs):
    edges = graph_extract.python_edges(_python_files(t).drop("grammar"))
    return edges.select(F.col("fid").alias("file"), "rel_type", F.col("from_raw").alias("src"), F.col("to_raw").alias("dst"))


@query("uncovered_lines", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS n FROM {v_lines})
SELECT l.doc_id, count(*) AS lines FROM l LEFT JOIN labels b ON b.doc_id = l.doc_id AND l.n BETWEEN 2 AND 4 + 3 * b.quality
WHERE b.doc_id IS NULL GROUP BY l.doc_id""")
def uncovered_lines(t: Inputs):
    files = t.v_lines.select(F.col("doc_id").alias("fid"), F.lit("x").alias("grammar"), F.rtrim(F.col("text"), F.lit("\n")).alias("content"))
    ranges = t.labels.select(F.col("doc_id").alias("fid"), F.lit(2).alias("start_line"), (4 + 3 * F.col("quality")).alias("end_line"))
    left = chunk_code.uncovered_lines(chunk_code.file_lines(files), ranges)
    return left.groupBy(F.col("fid").alias("doc_id")).agg(F.count("*").alias("lines"))


@query("report_sections", f"""
SELECT doc_id, 0::BIGINT AS place, NULL AS title, 'Report on ' || source AS body FROM documents
UNION ALL SELECT doc_id, 1, 'Overall Summary', {stripped('text')} FROM documents
UNION ALL SELECT doc_id, 2, 'Dependency Surface', 'Language ' || lang FROM documents""")
def report_sections(t: Inputs):
    rows = t.wide.v_reports.select("doc_id", F.posexplode(report.report_sections(F.col("report"))).alias("place", "p"))
    return rows.select("doc_id", "place", "p.title", "p.body")


@query("config_flatten", """
SELECT event_id, 'outer.k = ' || json_extract_string(props, '$.k') || chr(10) || 'outer2.deep.kind = ' || event_type || chr(10) || 'outer2.deep.late = '
  || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'None' END || chr(10) || 'outer2.list = [1,"' || event_type || '"]' || chr(10) || 'value = ' || event_id AS text FROM events
UNION ALL SELECT -1 - s_suppkey, 'dependencies.left = 1.0' || chr(10) || 'dependencies.only' || s_nationkey || ' = 2' || chr(10) || 'devDependencies.left = ' || s_suppkey FROM supplier
UNION ALL SELECT 1000000000 + doc_id, text FROM documents""")
def config_flatten(t: Inputs):
    from tessera.functions.config_text import flatten_config

    late = F.when(F.col("event_id") % 2 == 0, "true").otherwise("null")
    nested = F.concat(F.lit('{"outer": '), "props", F.lit(', "outer2": {"deep": {"kind": "'), "event_type", F.lit('", "late": '), late, F.lit('}, "list": [1, "'),
                      "event_type", F.lit('"]}, "value": '), "event_id", F.lit("}"))
    rows = t.events.select("event_id", F.lit("a.json").alias("path"), nested.alias("content"))
    rows = rows.unionByName(t.v_manifests.where(F.col("path").endswith("json")).select((-1 - F.col("s_suppkey")).alias("event_id"), "path", "content"))
    rows = rows.unionByName(t.documents.select((1000000000 + F.col("doc_id")).alias("event_id"), F.lit("no.json").alias("path"), F.col("text").alias("content")))
    return rows.select("event_id", flatten_config(F.col("path"), F.col("content")).alias("text"))


# Functions of 100 to 219 lines, with a signature over two lines and a docstring; above 150 lines they are shortened.
view("v_large", '''
SELECT p_partkey AS k, 102 + p_partkey % 118 AS n, concat('def run_', cast(p_partkey AS string), '(first,', chr(10), '        second="(")', ':', chr(10)) AS head,
       concat('    """Says "', p_brand, '" and', chr(10), '    no more."""', chr(10)) AS doc, repeat(concat('    first += ', cast(p_size AS string), chr(10)), cast(97 + p_partkey % 118 AS int)) AS steps
FROM {part}
''')


@query("large_definitions", """
SELECT k, 'run_' || k AS function_name, 2 AS start_line, n AS end_line, rtrim(head, chr(10)) AS signature, n - 1 > 150 AS large_function,
  CASE WHEN n - 1 > 150 THEN rtrim(head || substr(doc, 5), chr(10)) ELSE rtrim(head || doc || steps, chr(10)) END AS text,
  CASE WHEN n - 1 > 150 THEN md5(head || doc || steps) END AS full_body FROM {v_large}""")
def large_definitions(t: Inputs):
    content = F.concat(F.lit("import os\n"), "head", "doc", "steps")
    files_ = t.wide.v_large.select(F.col("k").alias("fid"), F.lit("python").alias("grammar"), content.alias("content"))
    found = chunk_code.code_chunks(files_, shorten_above=K.LARGE_DEFINITION_LINES).where("chunk_type = 'function'")
    return found.select(F.col("fid").alias("k"), "function_name", "start_line", "end_line", "signature", "large_function", "text", F.md5("full_body").alias("full_body"))


@query("issue_records", """
SELECT o_orderkey AS number, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS state, 'c' || o_custkey % 50 AS login, o_orderpriority AS label
FROM orders WHERE o_orderkey % 5 <> 0""")
def issue_records(t: Inputs):
    """Orders as a JSON dump of issues; every fifth one is a pull request in disguise."""
    user = F.struct(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("login"), F.lit("User").alias("type"))
    rows = t.orders.select(
        F.col("o_orderkey").cast("int").alias("number"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        user.alias("user"), F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("labels"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("{}")).alias("pull_request"))
    folder = _dump(t, rows)
    found = git_records.read_issues(t.spark, folder)
    return found.select("number", "title", "state", F.col("user.login").alias("login"), F.col("labels")[0]["name"].alias("label"))


@query("commit_records", """
WITH c AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') DESC, 'sha' || o_orderkey) AS n FROM orders)
SELECT 'sha' || o_orderkey AS sha, 'Commit of ' || o_orderkey AS message FROM c WHERE n <= 100""")
def commit_records(t: Inputs):
    """The hundred newest of the orders as a JSON dump of commits."""
    author = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("date"))
    rows = t.orders.select(F.concat(F.lit("sha"), "o_orderkey").alias("sha"), F.struct(F.concat(F.lit("Commit of "), "o_orderkey").alias("message"), author.alias("author")).alias("commit"))
    return git_records.read_commits(t.spark, _dump(t, rows), newest=100).select("sha", F.col("commit.message").alias("message"))


def _dump(t: Inputs, rows):
    folder = os.path.join(checkpoint_root(t.spark), "dumps", uuid.uuid4().hex)
    rows.write.json(folder)
    return folder


# Where each part of a brace source stands: lines before it, and its own.
@query("brace_chunks", """
WITH s AS (SELECT *, 2 * n AS b FROM {v_brace})
SELECT doc_id, 'js' AS grammar, 'function' AS chunk_type, NULL AS class_name, 'f_' || doc_id AS function_name, b + 4 AS start_line, b + 7 AS end_line,
  'export function f_' || doc_id || '(a, b) {{' AS signature, md5('export function f_' || doc_id || '(a, b) {{' || chr(10) || '  const r = /[{{(\\]"''`]+\\/{{/g.test(a) ? "}}}}" : ''{{{{'';'
    || chr(10) || '  return r; // }} }}' || chr(10) || '}}') AS body FROM s
UNION ALL SELECT doc_id, 'js', 'method', 'C_' || doc_id, 'm', b + 9, b + 11, '  m(x) {{', md5('m(x) {{' || chr(10) || '    return `}}${{x}}`;' || chr(10) || '  }}') FROM s
UNION ALL SELECT doc_id, 'js', 'function', NULL, 'page_' || doc_id, b + 13, b + 16, 'const page_' || doc_id || ' = (x) => {{', md5('const page_' || doc_id || ' = (x) => {{' || chr(10)
    || '  const t = `x ' || chr(36) || '{{ `b {{ ' || chr(36) || '{{x}}` }} c (`;' || chr(10) || '  return <p title="{{">Don''t (say {{x ? `]` : ''[''}} it</p>;' || chr(10) || '}};') FROM s
UNION ALL SELECT doc_id, 'js', 'function', NULL, 'last_' || doc_id, b + 17, b + 19, 'function last_' || doc_id || '() {{',
  md5('function last_' || doc_id || '() {{' || chr(10) || '  return <b key={{1}}/> || 4 / 2 / 1;' || chr(10) || '}}') FROM s
UNION ALL SELECT doc_id, 'go', 'function', NULL, 'F' || doc_id, n + 3, n + 5, 'func F' || doc_id || '(x string) string {{',
  md5('func F' || doc_id || '(x string) string {{' || chr(10) || '	return x + `\\{{` + "{{"' || chr(10) || '}}') FROM s
UNION ALL SELECT doc_id, 'go', 'class', NULL, NULL, n + 7, n + 9, 'type T' || doc_id || ' struct {{', md5('type T' || doc_id || ' struct {{' || chr(10) || '	a int' || chr(10) || '}}') FROM s""")
def brace_chunks(t: Inputs):
    rows = t.wide.v_brace
    js = rows.select(F.concat("doc_id", F.lit(":js")).alias("fid"), F.lit("javascript").alias("grammar"), F.col("js").alias("content"))
    go = rows.select(F.concat("doc_id", F.lit(":go")).alias("fid"), F.lit("go").alias("grammar"), F.col("go").alias("content"))
    found = chunk_code.code_chunks(js.unionByName(go)).where("chunk_type <> 'module_header' and not (chunk_type = 'class' and class_name is not null)")
    key = F.split("fid", ":")
    return found.select(key[0].cast("long").alias("doc_id"), key[1].alias("grammar"), "chunk_type", "class_name", "function_name", "start_line", "end_line", "signature", F.md5("text").alias("body"))
