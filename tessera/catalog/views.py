"""Engine inputs derived from the given tables.

The text below runs unchanged in Spark SQL and in the oracle database, so both sides start from the
same rows.  No view samples or caps a table.
"""

from tessera.catalog.registry import view

# Documents as repository files of four users; the extension cycles.
view("v_files", """
SELECT doc_id, concat('u', cast(doc_id % 4 AS string)) AS user_id, false AS is_public,
       concat('org/', source) AS repo, 'main' AS branch,
       concat(CASE WHEN doc_id % 11 = 3 THEN 'node_modules/' WHEN doc_id % 13 = 5 THEN 'web/dist/' ELSE 'docs/' END,
              cast(doc_id AS string), CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.json'
              WHEN 3 THEN '.min.js' WHEN 4 THEN '.lock' ELSE '' END) AS path,
       n_chars AS size, lang, text AS content
FROM {documents}
""")

# The state of an earlier run: the labelled documents, whose text differed when quality was 0, plus
# files (the pages) that are gone now.
view("v_prev", """
SELECT f.user_id, f.repo, f.branch, f.path,
       sha1(CASE WHEN l.quality = 0 THEN concat(f.content, '~') ELSE f.content END) AS file_sha
FROM {v_files} f JOIN {labels} l ON f.doc_id = l.doc_id
UNION ALL
SELECT concat('u', cast(page_id % 4 AS string)), 'org/site', 'main', concat('pages/', cast(page_id AS string), '.html'),
       sha1(html)
FROM {pages}
""")

# Documents with headers and blank lines between paragraphs.
view("v_docs_md", """
SELECT doc_id, concat('Preamble of document ', cast(doc_id AS string), chr(10), chr(10), '# Doc ',
       cast(doc_id AS string), chr(10), chr(10),
       replace(text, chr(10), concat(chr(10), chr(10), '## Part', chr(10), chr(10)))) AS text
FROM {documents}
""")

# Documents with a blank line between sentences, for paragraph packing.
view("v_paragraphs", """
SELECT doc_id, replace(text, '. ', concat('.', chr(10), chr(10))) AS text FROM {documents}
""")

# Documents with one sentence per line.
view("v_lines", """
SELECT doc_id, replace(text, '. ', concat('.', chr(10))) AS text FROM {documents}
""")

# Chunk rows: one per document, of four source types, in two runs per branch.
view("v_chunks", """
SELECT doc_id AS chunk_id, concat('u', cast(doc_id % 4 AS string)) AS user_id, false AS is_public,
       concat('org/', source) AS repo, CASE WHEN lang = 'de' THEN 'dev' ELSE 'main' END AS branch,
       concat('docs/', cast(doc_id AS string), '.txt') AS file_path, lang AS language,
       CASE doc_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'docs' WHEN 2 THEN 'issue' ELSE 'pr' END AS source_type,
       CASE WHEN doc_id % 4 = 0 THEN 'function' ELSE 'whole_doc' END AS chunk_type,
       CASE WHEN doc_id % 4 = 0 THEN concat('fn_', cast(doc_id AS string)) END AS function_name,
       CASE WHEN doc_id % 4 = 2 THEN cast(doc_id AS int) END AS issue_number,
       CASE WHEN doc_id % 4 = 3 THEN cast(doc_id AS int) END AS pr_number,
       CASE WHEN doc_id % 4 >= 2 THEN CASE WHEN n_chars % 2 = 0 THEN 'open' ELSE 'closed' END END AS state,
       CASE WHEN doc_id % 5 = 0 THEN 'run1' ELSE 'run2' END AS ingest_run_id,
       md5(text) AS file_sha, text, n_chars
FROM {documents}
""")

# Questions: the benchmark passages, asked by the four users in turn, some about one language.
view("v_questions", """
SELECT item_id AS qid, concat('u', cast(item_id % 4 AS string)) AS user_id, text AS query,
       CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS language
FROM {benchmark}
""")

# Property graph over the star schema.  Customers and their orders belong to the market segment as
# tenant; everything else is shared.
view("v_nodes", """
SELECT concat('contributor::', cast(c_custkey AS string)) AS id, 'Contributor' AS label, c_mktsegment AS user_id,
       concat('org/', c_mktsegment) AS repo, c_name AS name, cast(NULL AS string) AS path FROM {customer}
UNION ALL
SELECT concat('commit::', cast(o_orderkey AS string)), 'Commit', c_mktsegment, concat('org/', c_mktsegment),
       cast(NULL AS string), cast(NULL AS string) FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT concat('file::', cast(p_partkey AS string)), 'File', 'shared', 'org/parts', cast(NULL AS string),
       concat('parts/', replace(p_type, ' ', '/'), '/', cast(p_partkey AS string), '.py') FROM {part}
UNION ALL
SELECT DISTINCT concat('module::', p_brand), 'Module', 'shared', 'org/parts', p_brand, cast(NULL AS string) FROM {part}
UNION ALL
SELECT DISTINCT concat('label::', o_orderpriority), 'Label', 'shared', 'org/parts', o_orderpriority,
       cast(NULL AS string) FROM {orders}
UNION ALL
SELECT concat('dependency::', cast(s_suppkey AS string)), 'Dependency', 'shared', 'org/parts', s_name,
       cast(NULL AS string) FROM {supplier}
UNION ALL
SELECT concat('repository::', n_name), 'Repository', 'shared', concat('org/', n_name), n_name, cast(NULL AS string)
FROM {nation}
""")

view("v_edges", """
SELECT concat('contributor::', cast(o_custkey AS string)) AS src, concat('commit::', cast(o_orderkey AS string)) AS dst,
       'AUTHORED' AS rel_type FROM {orders}
UNION ALL
SELECT DISTINCT concat('commit::', cast(l_orderkey AS string)), concat('file::', cast(l_partkey AS string)), 'TOUCHES'
FROM {lineitem}
UNION ALL
SELECT concat('commit::', cast(o_orderkey AS string)), concat('label::', o_orderpriority), 'LABELED' FROM {orders}
UNION ALL
SELECT concat('file::', cast(p_partkey AS string)), concat('module::', p_brand), 'IMPORTS' FROM {part}
UNION ALL
SELECT concat('repository::', n_name), concat('dependency::', cast(s_suppkey AS string)), 'DEPENDS_ON'
FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey
""")

# Calls between functions: the part of line n calls the part of line n+1 of the same order.
view("v_calls", """
SELECT DISTINCT concat('func::', cast(a.l_partkey AS string)) AS src, concat('func::', cast(b.l_partkey AS string)) AS dst,
       'CALLS' AS rel_type
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
""")

view("v_functions", """
SELECT concat('func::', cast(p_partkey AS string)) AS id, 'Function' AS label, 'shared' AS user_id,
       concat('org/', p_brand) AS repo, 'main' AS branch, p_name AS name, cast(NULL AS string) AS path FROM {part}
""")

# Fulfilled orders as pull requests over part files, closing the customer's issue.
view("v_prs", """
SELECT o_orderkey AS number, concat('Order ', cast(o_orderkey AS string)) AS title,
       CASE WHEN o_totalprice > 150000 THEN 'open' ELSE 'closed' END AS state,
       concat('fixes #', cast(o_custkey AS string)) AS body, o_custkey AS issue_number, c_name AS login,
       o_orderpriority AS label
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
""")

view("v_pr_files", """
SELECT l_orderkey AS number, concat('parts/', cast(l_partkey AS string), '.py') AS filename,
       min(CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'modified' END) AS status,
       cast(sum(l_quantity) AS bigint) AS additions, cast(count(*) AS bigint) AS deletions
FROM {lineitem} GROUP BY l_orderkey, l_partkey
""")

# Events as the progress log of one job per user.
view("v_events", """
SELECT concat('job', cast(user_id AS string)) AS job_id, concat('u', cast(user_id AS string)) AS user_id, event_id, ts,
       event_type AS stage, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END AS state,
       value
FROM {events}
""")

# Python sources around each document: two imports, a function, a class with one method whose docstring
# is the document (without quotes).
view("v_python", """
SELECT doc_id, concat('import os, requests', chr(10), 'from .local.mod import x', chr(10), chr(10),
       'def f_', cast(doc_id AS string), '(x):', chr(10), '    return g_', cast(doc_id % 10 AS string), '(x)', chr(10), chr(10),
       'class C_', cast(doc_id AS string), '(Base):', chr(10), '    def m(self):', chr(10),
       '        ', chr(34), chr(34), chr(34), replace(replace(replace(text, chr(34), ''), chr(39), ''), chr(92), ''),
       chr(34), chr(34), chr(34), chr(10), '        return f_', cast(doc_id AS string), '(1)', chr(10)) AS content,
       1 + length(text) - length(replace(text, chr(10), '')) AS doc_lines
FROM {documents}
""")

# JavaScript and Go sources around each document: its text stands in a comment over several lines and in raw strings, after
# brackets that pair with nothing. `n` is how many lines the text has.
view("v_brace", r"""
SELECT doc_id, n,
  concat('/* {{ (', chr(10), body, chr(10), '*/', chr(10), 'const note = `{{[', body, ' \\` (', '`;', chr(10), chr(10),
    'export function f_', cast(doc_id AS string), '(a, b) {{', chr(10), '  const r = /[{{(\\]"', chr(39), '`]+\\/{{/g.test(a) ? "}}}}" : ', chr(39), '{{{{', chr(39), ';', chr(10),
    '  return r; // }} }}', chr(10), '}}', chr(10), 'class C_', cast(doc_id AS string), ' extends Base {{', chr(10), '  m(x) {{', chr(10), '    return `}}', chr(36), '{{x}}`;', chr(10), '  }}', chr(10), '}}', chr(10),
    'const page_', cast(doc_id AS string), ' = (x) => {{', chr(10), '  const t = `x ', chr(36), '{{ `b {{ ', chr(36), '{{x}}` }} c (`;', chr(10),
    '  return <p title="{{">Don', chr(39), 't (say {{x ? `]` : ', chr(39), '[', chr(39), '}} it</p>;', chr(10), '}};', chr(10),
    'function last_', cast(doc_id AS string), '() {{', chr(10), '  return <b key={{1}}/> || 4 / 2 / 1;', chr(10), '}}', chr(10)) AS js,
  concat('package p', chr(10), 'var raw = `{{', body, '\\`', chr(10), '// }}', chr(10), 'func F', cast(doc_id AS string), '(x string) string {{', chr(10), chr(9), 'return x + `\\{{` + "{{"', chr(10), '}}', chr(10), chr(10),
    'type T', cast(doc_id AS string), ' struct {{', chr(10), chr(9), 'a int', chr(10), '}}', chr(10)) AS go
FROM (SELECT doc_id, replace(replace(replace(text, chr(96), ''), chr(92), ''), '*/', '') AS body, 1 + length(text) - length(replace(text, chr(10), '')) AS n FROM {documents})
""")

# Pages as scripts that import what the page links to.
view("v_scripts", """
SELECT page_id, concat('u', cast(page_id % 4 AS string)) AS user_id, concat('web/', cast(page_id AS string), '.js') AS path,
       replace(replace(html, 'href=', 'import '), '<li>', chr(10)) AS content
FROM {pages}
""")

# Requirement and package manifests of suppliers.
view("v_manifests", """
SELECT s_suppkey, 'requirements.txt' AS path, concat('# pins', chr(10), 'pkg', cast(s_suppkey AS string), '==', cast(s_nationkey AS string),
       '.0', chr(10), 'lib-', cast(s_nationkey AS string), chr(10), chr(10), 'uvicorn[standard]~=0.3 # note', chr(10), '-r base.txt') AS content
FROM {supplier}
UNION ALL
SELECT s_suppkey, 'web/package.json', concat('{{"dependencies": {{"left": "1.0", "only', cast(s_nationkey AS string),
       '": "2"}}, "devDependencies": {{"left": "', cast(s_suppkey AS string), '"}}}}')
FROM {supplier}
""")

# File nodes and the functions below them, with raw ids.
view("v_tree", """
SELECT concat('t1::org/parts::main::parts/', cast(p_partkey AS string), '.py') AS id, 'File' AS label,
       concat('org/parts::main::parts/', cast(p_partkey AS string), '.py') AS raw_id, 't1' AS user_id, 'org/parts' AS repo,
       'main' AS branch, p_size AS size FROM {part}
UNION ALL
SELECT concat('t1::org/parts::main::parts/', cast(p_partkey AS string), '.py::func::', p_brand), 'Function',
       concat('org/parts::main::parts/', cast(p_partkey AS string), '.py::func::', p_brand), 't1', 'org/parts', 'main', p_size FROM {part}
""")

# Review reports: an intro and two titled parts.
view("v_reports", """
SELECT doc_id, concat('Report on ', source, chr(10), '## Overall Summary', chr(10), text, chr(10), '2. Dependency Surface', chr(10),
       'Language ', lang, chr(10)) AS report
FROM {documents}
""")

# Two states of five repositories with two branches each: modules, pages and settings made of parts. The second one lacks
# some files, has some that are new, and some whose size differs in one branch or both.
view("v_places", " UNION ALL ".join(
    f"SELECT p_partkey, p_brand, p_size, '{branch}' AS branch, {run} AS run FROM {{part}}" for branch in ("main", "dev") for run in (1, 2)))
view("v_parts_as_files", """
SELECT p_partkey AS k, p_partkey % 3 AS kind, p_brand AS brand, concat('u', cast(p_partkey % 4 AS string)) AS user_id,
       concat('org/r', cast(p_partkey % 5 AS string)) AS repo, branch, run,
       concat(CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' ELSE 'conf/' END, cast(p_partkey AS string),
              CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.json' END) AS path,
       p_size + CASE WHEN run = 2 AND (p_partkey % 5 = 0 OR (p_partkey % 7 = 2 AND branch = 'dev')) THEN 1 ELSE 0 END AS size
FROM {v_places} WHERE NOT (run = 1 AND p_partkey % 11 = 3) AND NOT (run = 2 AND p_partkey % 13 = 4)
""")
_FILE = """
SELECT k, kind, brand, size, user_id, repo, branch, path, CASE kind
       WHEN 0 THEN concat('import os', chr(10), 'import lib', cast(k % 50 AS string), chr(10), chr(10), 'def run_', cast(k AS string), '(x):', chr(10),
                          '    return os.getcwd(', cast(size AS string), ')', chr(10), chr(10), 'def main_', cast(k AS string), '():', chr(10),
                          '    return run_', cast(k AS string), '(1)', chr(10))
       WHEN 1 THEN concat('# Part ', cast(k AS string), chr(10), 'Size ', cast(size AS string), ' of ', brand, '.')
       ELSE concat('{{"name": "', brand, '", "inner": {{"size": ', cast(size AS string), '}}}}') END AS content
FROM {v_parts_as_files} WHERE run = """
view("v_run1", _FILE + "1")
view("v_run2", _FILE + "2")
