"""One registered query per operator, over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    binary_output, decontamination, html_extraction, importance, language_model, line_dedup, near_dedup, neighbours, packing, prefix_trie, quality, secrets,
    substring_dedup,
)
from tessera.llm.language_model import remainder
from tessera.llm.shared import place

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(table(spark, folder, "documents"))


def op2_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    model = language_model.train(docs.where("not held_out"))
    return language_model.score(docs, model, keep=["doc_id", "held_out"]).drop("perplexity")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.digests(secrets.scan(docs, secrets.train(secrets.samples(docs))))


def op4_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    out = place(spark, "tokens")
    binary_output.write(table(spark, folder, "documents"), out, tokenizer_path(), end_id=1)
    return binary_output.digests(binary_output.read(spark, out))


def op5_containment(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_line_edit_join(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digests(table(spark, folder, "documents"))


def op7_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), end_id=2)


def quality_model(spark: SparkSession, docs: DataFrame, folder: str):
    """Learns from labelled rows that are not held out; the ids of the sample are broadcast, at most SAMPLED of them."""
    labels = table(spark, folder, "labels").where("quality is not null and doc_id is not null").where(remainder(F.col("doc_id"), 3) != 1)
    sample = labels.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(quality.SAMPLED)
    return quality.fit(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))


def op8_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_model(spark, docs, folder)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_block_join(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digests(table(spark, folder, "documents"))


def op11_block_field(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_extraction.extract(pages, html_extraction.fit(pages))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(table(spark, folder, "conversations"))))


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_hyperminhash, op2_kneser_ney, op3_secret_scan, op4_orc_tokens, op5_containment, op6_line_edit_join, op7_harmonic_packing,
    op8_rule_ensemble, op9_block_join, op10_repeated_substrings, op11_block_field, op12_prefix_trie, op13_importance,
)}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
_RUNS = "list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' ')))"
# CRC-32 bit by bit, the lowest bit of every byte first.
_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(range(length(hex(encode({0}))) // 2), lambda i:
  list_transform(range(8), lambda j: ((strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * i + 2, 1)) - 1) >> j & 1))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
_PARTS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES = {
    "op1_hyperminhash": rf"""
WITH RECURSIVE s AS (
  SELECT doc_id, CASE WHEN len(w) > 0 THEN {_RUNS} ELSE [] END AS runs FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
one AS (SELECT doc_id, len(runs) AS n, unnest(runs) AS run FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.run = b.run AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, len(runs) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN least ON a = doc_id""",
    "op5_containment": rf"""
WITH i AS (SELECT item_id, len(w) AS words, {_RUNS} AS runs FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
run AS (SELECT item_id, least(words, 5) AS width, len(runs) AS n, unnest(runs) AS run FROM i),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
held AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS run
  FROM d, (SELECT DISTINCT width FROM run) WHERE len(w) >= width)
SELECT doc_id, item_id, count(*) AS n_found, n AS n_shingles FROM held JOIN run USING (width, run)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n""",
    "op6_line_edit_join": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS x FROM documents),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, k) AS nth FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
firsts AS (SELECT doc_id, k, x, octet_length(encode(x)) AS n FROM full_lines WHERE nth = 1 AND octet_length(encode(x)) >= 20),
cut AS (SELECT *, unnest([0, 1, 2]) AS part FROM firsts),
keys AS (SELECT *, part * (n // 3) + greatest(0, part - 3 + n % 3) AS at, n // 3 + CASE WHEN part >= 3 - n % 3 THEN 1 ELSE 0 END AS size FROM cut),
near AS (
  SELECT DISTINCT b.doc_id, b.k FROM firsts a JOIN firsts b ON abs(a.n - b.n) <= 2 AND (a.doc_id, a.k) < (b.doc_id, b.k)
  WHERE (left(a.x, 6) = left(b.x, 6) OR right(a.x, 6) = right(b.x, 6) OR levenshtein(left(a.x, 12), left(b.x, 12)) <= 4) AND levenshtein(a.x, b.x) <= 2),
judged AS (SELECT l.doc_id, l.k, l.x, coalesce(f.nth > 1, false) AS again, (near.k IS NOT NULL AND coalesce(f.nth, 0) = 1) AS close
  FROM lines l LEFT JOIN full_lines f ON f.doc_id = l.doc_id AND f.k = l.k LEFT JOIN near ON near.doc_id = l.doc_id AND near.k = l.k),
told AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_exact, count(*) FILTER (close) AS n_near,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (NOT again AND NOT close), '')) AS kept_sha256 FROM judged GROUP BY doc_id)
SELECT * FROM told""",
    "op9_block_join": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM near)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op12_prefix_trie": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(octet_length(encode(r)) || ':' || r || x)) AS s, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
made AS (SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
one AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM made),
node AS (
  SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends
  FROM one GROUP BY 1, 2),
child AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (n - 1) * len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM node LEFT JOIN child USING (p)),
up AS (SELECT p, k, own, unnest(range(d + 1)) AS e FROM full_node),
below AS (SELECT p[1:e] AS p, count(*) FILTER (k = 0) AS leaves, sum(own)::BIGINT AS saved FROM up GROUP BY 1)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, a.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, a.ends AS ends_sha256
FROM full_node a JOIN below ON below.p = a.p LEFT JOIN node b ON a.d > 0 AND b.p = a.p[1:a.d - 1]""",
    "op13_importance": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_PARTS} AS w FROM documents), b AS (SELECT {_PARTS} AS w FROM benchmark),
pairs AS (SELECT row, doc_id, len(w) AS words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM d),
ones AS (SELECT row, unnest(f) AS f FROM pairs),
aims AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
crc AS (SELECT f, {_CRC.format("f")} % 10000 AS bucket FROM (SELECT f FROM ones UNION SELECT f FROM aims)),
s AS (SELECT bucket, count(*) AS s FROM ones JOIN crc USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aims JOIN crc USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM ones) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT row, sum(gain)::BIGINT AS g, count(*) AS n FROM ones JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, words, coalesce(n, 0) AS n_features, coalesce(CASE WHEN g % n < 0 THEN g // n - 1 ELSE g // n END, 0) AS weight,
    list_reduce([0] || list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || doc_id), i, 1)) - 1), lambda c, x: c * 16 + x) AS h
  FROM pairs LEFT JOIN sums USING (row)),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM noisy WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank FROM noisy LEFT JOIN ranked USING (row)""",
}
