"""Search: term vectors, dense vectors, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Inputs, query
from tessera.operators import dense, hybrid, sparse
from tessera.operators import dense_clusters as clusters
from tessera.operators import sparse_blocks as blocks

# Oracle text shared by several queries: terms, hashed counts and scores.
_TERMS = r"""
terms AS (
  SELECT id, unnest(string_split(lower(regexp_replace(replace(txt, 'Σ', 'σ'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS t
  FROM texts),
hashed AS (
  SELECT id, t, md5(t) AS h FROM terms WHERE length(t) >= 2),
indexed AS (
  SELECT id, t, h, (((('0x' || substr(h, 1, 8))::BIGINT % 1000000 * 4294967296 + ('0x' || substr(h, 9, 8))::BIGINT) % 1000000
     * 4294967296 + ('0x' || substr(h, 17, 8))::BIGINT) % 1000000
     * 4294967296 + ('0x' || substr(h, 25, 8))::BIGINT) % 1000000 AS term_idx
  FROM hashed),
posts AS (SELECT id, term_idx, count(*) AS tf, count(*) / (count(*) + 0.5::DOUBLE) AS w FROM indexed GROUP BY id, term_idx)
"""
_BOTH = "WITH texts AS (SELECT 'd' || doc_id AS id, text AS txt FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark)," + _TERMS
_SPARSE = _BOTH + """,
sparse_scored AS (
  SELECT substr(q.id, 2)::BIGINT AS qid, substr(d.id, 2)::BIGINT AS chunk_id, round(sum(q.w * d.w), 9) AS score
  FROM posts q JOIN posts d USING (term_idx) WHERE q.id[1] = 'q' AND d.id[1] = 'd' GROUP BY ALL),
sparse_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS sparse_rank FROM sparse_scored)
"""
_EMBED = """,
cells AS (
  SELECT id, ('0x' || substr(h, 25, 8))::BIGINT % 64 AS d,
         sum(CASE WHEN h[1] < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM hashed GROUP BY ALL),
unit AS (SELECT id, d, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS x FROM cells),
ids AS (SELECT DISTINCT id FROM texts)
"""
_DENSE_TEXT = _EMBED + """,
dense_scored AS (
  SELECT substr(q.id, 2)::BIGINT AS qid, substr(c.id, 2)::BIGINT AS chunk_id,
         round(coalesce(s.score, 0), 9) + 0.0 AS score
  FROM ids q JOIN ids c ON q.id[1] = 'q' AND c.id[1] = 'd'
  LEFT JOIN (SELECT a.id AS qi, b.id AS ci, sum(a.x * b.x) AS score FROM unit a JOIN unit b USING (d)
             WHERE a.id[1] = 'q' AND b.id[1] = 'd' GROUP BY ALL) s ON s.qi = q.id AND s.ci = c.id),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS dense_rank FROM dense_scored)
"""


def _documents(t: Inputs):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(t: Inputs):
    return t.benchmark.select(F.col("item_id").alias("qid"), "text")


@query("term_frequency", "WITH texts AS (SELECT doc_id AS id, text AS txt FROM documents)," + _TERMS
       + "SELECT id AS chunk_id, term_idx, tf, round(w, 9) AS w FROM posts")
def term_frequency(t: Inputs):
    return sparse.postings(_documents(t), "chunk_id").select(
        "chunk_id", F.col("term_idx").cast("long").alias("term_idx"), "tf", F.round("w", 9).alias("w")
    )


@query("sparse_topk", _SPARSE + "SELECT qid, chunk_id, score, sparse_rank AS rank FROM sparse_ranked WHERE sparse_rank < 7")
def sparse_topk(t: Inputs):
    hits = sparse.sparse_top_k(sparse.term_vectors(_documents(t), "chunk_id"), sparse.postings(_questions(t), "qid"))
    return hits.withColumnRenamed("sparse_rank", "rank")


@query("sparse_blocks", _SPARSE + "SELECT qid, chunk_id, score, sparse_rank AS rank FROM sparse_ranked WHERE sparse_rank < 7")
def sparse_blocks(t: Inputs):
    """The same hits from a block-max index."""
    index = blocks.block_index(sparse.postings(_documents(t), "chunk_id"))
    return blocks.block_top_k(index, sparse.postings(_questions(t), "qid")).hits.withColumnRenamed("sparse_rank", "rank")


def centroid_questions(t: Inputs):
    """One question per label: the mean vector of the label, reduced per dimension before it moves."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    means = cells.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v"))
    return packed.select(F.col("label").alias("qid"), F.col("v.m").alias("qdense"))


_CENTROIDS = """
WITH cells AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, d, avg(x) AS m FROM cells GROUP BY ALL),
q AS (SELECT label::BIGINT AS qid, list(m ORDER BY d) AS v FROM means GROUP BY label),
s AS (SELECT qid, vec_id AS chunk_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank FROM s)
SELECT qid, chunk_id, score, rank FROM r WHERE rank < 7"""


@query("dense_topk", _CENTROIDS)
def dense_topk(t: Inputs):
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    return dense.dense_top_k(chunks, centroid_questions(t)).withColumnRenamed("dense_rank", "rank")


@query("dense_clusters", _CENTROIDS)
def dense_clusters(t: Inputs):
    """The same hits from a clustered index."""
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"))
    return clusters.cluster_top_k(clusters.cluster_index(chunks), centroid_questions(t)).hits.withColumnRenamed("dense_rank", "rank")


@query("embed_default", "WITH texts AS (SELECT doc_id AS id, text AS txt FROM documents)," + _TERMS + _EMBED
       + "SELECT id AS chunk_id, d AS dim, round(x, 9) AS value FROM unit WHERE round(x, 9) <> 0")
def embed_default(t: Inputs):
    vectors = dense.hash_embed(_documents(t), "chunk_id")
    cells = vectors.select("chunk_id", F.posexplode("dense").alias("dim", "value"))
    return cells.select("chunk_id", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value")).where(
        F.col("value") != 0
    )


@query("validate_vectors", """
SELECT label::BIGINT AS label, count(*) AS vectors, sum(len(embedding))::BIGINT AS numbers FROM embeddings GROUP BY label""")
def validate_vectors(t: Inputs):
    checked = dense.validate_vectors(t.embeddings, 64, "embedding")
    return checked.groupBy("label").agg(F.count("*").alias("vectors"), F.sum(F.size("embedding")).alias("numbers"))


def text_hits(t: Inputs, k: int = 7):
    """Both hit lists of the benchmark questions over all documents."""
    found_sparse = sparse.sparse_top_k(sparse.term_vectors(_documents(t), "chunk_id"), sparse.postings(_questions(t), "qid"), k)
    vectors = dense.hash_embed(_documents(t), "chunk_id")
    asked = dense.hash_embed(_questions(t), "qid").withColumnRenamed("dense", "qdense")
    return dense.dense_top_k(vectors, asked, k), found_sparse


_FUSED = _SPARSE + _DENSE_TEXT + """,
lists AS (
  SELECT qid, chunk_id, dense_rank AS dr, NULL::BIGINT AS sr FROM dense_ranked WHERE dense_rank < {k}
  UNION ALL SELECT qid, chunk_id, NULL, sparse_rank FROM sparse_ranked WHERE sparse_rank < {k}),
merged AS (
  SELECT qid, chunk_id, max(dr) AS dr, max(sr) AS sr FROM lists GROUP BY ALL),
fused AS (
  SELECT *, coalesce(1.0::DOUBLE / (dr + 60), 0) + coalesce(1.0::DOUBLE / (sr + 60), 0) AS score FROM merged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr NULLS LAST, sr) - 1 AS rank FROM fused)
"""


@query("hybrid_rrf", _FUSED.replace("{k}", "7")
       + "SELECT qid, chunk_id, round(score, 9) AS score, rank FROM ranked WHERE rank < 7")
def hybrid_rrf(t: Inputs):
    return hybrid.fuse(*text_hits(t)).select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("issue_postfilter", _FUSED.replace("{k}", "10") + """,
found AS (SELECT r.qid, r.chunk_id, r.rank, c.source_type, c.state FROM ranked r JOIN {v_chunks} c USING (chunk_id)
          WHERE r.rank < 10 AND c.source_type IN ('issue', 'pr') AND c.state = 'open')
SELECT qid, chunk_id, source_type, state, n - 1 AS place FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM found)""")
def issue_postfilter(t: Inputs):
    from tessera.plans.search import keep_issues

    hits = hybrid.fuse(*text_hits(t, 10), k=10)
    return keep_issues(hits, t.v_chunks, state="open").select("qid", "chunk_id", "source_type", "state", "place")
